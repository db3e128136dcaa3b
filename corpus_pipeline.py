"""Corpus pipeline over `documents`: each stage calls one operator of seqloom.llm.

Toxicity and language identification drop the documents that they reject, line
dedup deletes later repeated runs of lines, SimHash keeps one document of each
near-duplicate group, packing lays the rest out in sequences. A stage works on
all that the stage before it kept, read again from the written table.

An empty table passes through every stage; null texts count as empty and go
with the language stage; extra columns pass through the first four stages.
Rows are judged by doc_id and text: of rows equal in both the SimHash stage keeps
one, unlike texts of one doc_id (or of none) go or stay each for itself.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm import language_id, line_dedup, packing, simhash, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a classifier chain, trained on `labels`, calls toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents of no learned language (no letter, no language likelier than not, or none that fits better than plain bytes)."""
    return language_id.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines deleted, n_chars counted anew; documents of which nothing is left go."""
    found = line_dedup.dedup_lines(docs)
    left = found.where("removed_lines = 0 or trim(replace(text, '\\n', ' ')) <> ''")
    return left.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("packing", packing_stage),
]

#: The first two stages are learned models; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = runtime.materialize(docs)
    return docs
