"""The registered queries of this subpackage and the SQL that checks them.

Each query reads its whole table and derives the columns of its contract from
its operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm import bpe, embedding_dedup, language_id, line_dedup, lz_fingerprint, packing, simhash, token_counts, token_store, toxicity

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a token store of all documents, read it back through its indexes."""
    path = token_store.write_store(table(spark, sf_dir, "documents"), runtime.work_dir(spark), public_tokenizers.path(WORD_TOKENIZER), end_id=1)
    return token_store.positions(token_store.scan_store(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete later repeats of runs of 2 lines or more, and of lines of 50 words or more."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "removed_lines", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the own BPE."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER), keep=False)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), capacity=2048, end_id=0)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after three edits each: a replacement, an insertion in front and a deletion."""
    docs = table(spark, sf_dir, "documents")
    n = F.length(F.coalesce("text", F.lit("")))

    def edit(position, removed: int, inserted: str):
        return F.struct(position.cast("int").alias("position"), F.lit(removed).alias("removed"), F.lit(inserted).alias("inserted"))

    edits = F.array(edit(F.floor(n / 3), 20, "the quick brown fox 42"), edit(F.lit(0), 0, "Title: "), edit(F.floor(2 * n / 3), 10, ""))
    return token_counts.edit_counts(docs.withColumn("edits", edits), None, public_tokenizers.path(BYTE_TOKENIZER))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the chain on labelled documents, classify all."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.CATEGORIES))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at cosine 0.9 or more among all embeddings."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return lz_fingerprint.compare_edits(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from two thirds of the documents, identify all."""
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles, 64-bit fingerprints, links at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_token_counts": op5_token_counts,
    "op6_toxicity": op6_toxicity,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_lz_fingerprint": op8_lz_fingerprint,
    "op9_language_id": op9_language_id,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.oracle(), "op7_embedding_dedup": embedding_dedup.oracle()}
