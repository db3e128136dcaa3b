"""FASTA scan and the alignment sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, name, seq of the records of FASTA files, in file order.

    Whatever comes before the first `>` line is skipped. The name is the whole
    header line after `>` and spaces, a trailing carriage return removed; sequence
    lines are trimmed at both ends and joined, blank lines skipped, letters in
    upper case. A record is a line of the text source whose separator is `\\n>`,
    so files are split between tasks at record starts and nothing is shuffled.
    seq_id rises with the order of file paths and of records in a file: the number
    of the split (part of a file) from bit 33 on, the record's number in it below.
    """
    source = spark.read.option("lineSep", "\n>").text(path)
    raw = source.select(F.monotonically_increasing_id().alias("seq_id"), F.regexp_replace("value", "\r\n", "\n").alias("r"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # A split's rows are numbered one after another by the task that reads it. A row a split.
    splits = raw.groupBy("file", "block").agg(F.min("seq_id").alias("low")).withColumn("split", F.row_number().over(Window.orderBy("file", "block")).cast("bigint") - 1)
    # A file's first record still has its mark; without one it is what comes before the first record.
    rows = raw.join(splits, ["file", "block"]).where("block > 0 or seq_id > low or r like '>%'").withColumn("seq_id", F.shiftleft("split", 33) + F.col("seq_id") - F.col("low"))
    header = F.regexp_replace(F.regexp_replace(F.substring_index("r", "\n", 1), r"\r$", ""), r"^[> ]+", "")
    lines = F.slice(F.split("r", "\n"), 2, F.greatest(F.size(F.split("r", "\n")) - 1, F.lit(0)))
    seq = F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), "")
    return rows.select("seq_id", header.alias("name"), F.upper(seq).alias("seq"))


def with_dense_ids(sequences: DataFrame, name: str = "seq_id") -> DataFrame:
    """seq_id counted 0, 1, 2 ... in order: ranks within each read task's rows plus a running sum of counts over tasks."""
    part = F.shiftright(F.col(name), 33)
    rows = sequences.withColumn("_part", part).withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(name)) - 1)
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    base = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.join(base, "_part").withColumn(name, (F.col("_base") + F.col("_row")).cast("bigint")).drop("_part", "_row", "_base")


def to_tsv_lines(results: DataFrame) -> DataFrame:
    """query_id, rank, value: the twelve columns of the tabular format as one line."""

    @F.pandas_udf(StringType())
    def general(x):
        return x.map(lambda v: f"{v:.6g}")

    cells = [F.col("query"), F.col("subject"), general(F.col("identity").cast("double")), *[F.col(c).cast("string") for c in ("length", "mismatches", "gap_opens", "q_start", "q_end", "s_start", "s_end")], general(F.col("evalue").cast("double")), general(F.col("bits").cast("double"))]
    return results.select("query_id", "rank", F.concat_ws("\t", *cells).alias("value"))


def write_tsv(results: DataFrame, path: str) -> None:
    """Tabular text without header, queries in input order, alignments in rank order (files in order of their names)."""
    to_tsv_lines(results).orderBy("query_id", "rank").select("value").write.text(path)
