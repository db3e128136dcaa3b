"""Searches over a stream of queries: each micro-batch is a bounded batch of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from seqloom.operators.search import SearchOptions
from seqloom.plans import homology
from seqloom.sources.database import load

SCHEMA = "query_id bigint, name string, seq string"


def search_stream(queries: DataFrame, database_path: str, out_path: str, checkpoint: str, dna: bool = False, options: SearchOptions | None = None) -> StreamingQuery:
    """Search each micro-batch of a streaming DataFrame (query_id, name, seq); results are Parquet, a folder a batch.

    A batch that is run again after a failure overwrites its own folder, so every
    query's results are there once. query_id must be unique within a batch.
    """

    def one(batch: DataFrame, number: int) -> None:
        db = load(batch.sparkSession, database_path)
        homology.search(db, batch, dna, options).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    return queries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_queries(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of query files (Parquet with query_id, name, seq), so many to a micro-batch."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder).where(F.col("seq").isNotNull())
