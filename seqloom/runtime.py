"""What every plan needs from the session: shipped code, a shared work folder,
written intermediate tables and partition counts that follow the input size."""

from __future__ import annotations

import atexit
import math
import os
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors (once for each context).

    The zip is served by the driver, so no shared local folder is assumed.
    """
    sc = spark.sparkContext
    if getattr(sc, "_seqloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="seqloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "seqloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for base, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(base, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    # Long texts make wide rows: small Arrow batches bound a Python worker's memory.
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, "1000")
    sc._seqloom_shipped = True


def work_dir(spark: SparkSession) -> str:
    """A new folder in this session's own one (session_dir)."""
    return f"{session_dir(spark)}/{uuid.uuid4().hex}"


def session_dir(spark: SparkSession) -> str:
    """Where this session's intermediate tables lie: below spark.checkpoint.dir.

    Where that is unset: below the warehouse, which a cluster shares; with a local
    master, in a temporary folder that goes with the process.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_seqloom_base", None)
    if not base and sc.master.startswith("local"):
        base = sc._seqloom_base = tempfile.mkdtemp(prefix="seqloom-work-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/seqloom-{sc.applicationId}"


def drop_all(spark: SparkSession) -> None:
    """Delete every intermediate table of this session, once no DataFrame made from them is needed."""
    drop_path(spark, session_dir(spark))


def materialize(df: DataFrame, *, partition_by: str | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors cost a re-read only."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what materialize() wrote for df."""
    path = getattr(df, "_seqloom_path", None)
    if path:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of df (file sizes for a plain scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of some thousand rows of the driver. They go to the JVM as Arrow and stay there: a list of Python rows
    passes through Python workers of a kind of its own, which executors then hold beside those of mapInArrow."""
    kinds = StructType.fromDDL(schema)
    if not rows:
        return spark.createDataFrame([], kinds)
    own = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array(list(v), f.type) for v, f in zip(zip(*rows, strict=True), own, strict=True)], own), kinds)


#: Rows of one key that a task of a join takes.
HOT_ROWS = 1 << 16


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, how: str = "inner", hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner or left) with keyed, a row a key, that says in `count` how many rows have the key.

    Keys with more than hot_rows rows are few (at most rows / hot_rows): they are
    written, so their size is known, and Spark sends them to the rows where it is
    small; only the other rows are dealt out by key. rows should be a written
    table: it is read twice where there are such keys.
    """
    hot = materialize(keyed.where(F.col(count) > hot_rows))
    if hot.isEmpty():
        return rows.join(keyed, on, how)
    rest = rows.join(hot.select(*on), on, "left_anti").join(keyed.where(F.col(count) <= hot_rows), on, how)
    return rest.unionByName(rows.join(hot, on))


def running_sum(df: DataFrame, order: str, value: str, name: str, bytes_each: int = 32 << 20) -> DataFrame:
    """order, value and name: the sum of value up to and with each row, by order.

    Rows are dealt by range of `order` and summed up within a partition; the sums
    of the partitions before are added (a row a partition).
    """
    rows = df.select(order, value).repartitionByRange(partitions_for(df, bytes_each), order)
    rows = materialize(rows.withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part").agg(F.sum(value).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn(name, inside).join(base, "_part").select(order, value, (F.col(name) + F.col("_base")).alias(name))


#: Spark's estimate for data of unknown size (not read from files) is beyond this.
UNKNOWN_BYTES = 1 << 56


def partitions_for(df: DataFrame, bytes_each: int = 8 << 20, least: int = 1) -> int:
    """Partitions of about bytes_each of stored input; the session's shuffle partitions where the size is unknown."""
    size = input_bytes(df)
    if size >= UNKNOWN_BYTES:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / bytes_each))


def widen(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out evenly where it has fewer partitions than there are cores (a small file of one row group, say)."""
    return spread(df) if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism else df


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly, for kernels whose work is large against the bytes that they read."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
