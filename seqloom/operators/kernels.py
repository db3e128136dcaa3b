"""Single operators over tables, for use on their own: kernels, lookups, filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.functions import alignment as al
from seqloom.functions import masking
from seqloom.functions import statistics as st
from seqloom.functions.alphabet import BLOSUM62, ScoreMatrix
from seqloom.operators import search


def locate(places: DataFrame, sequences: DataFrame, block: int = 1 << 16) -> DataFrame:
    """places (with `place`, 0-based in the concatenated database) with seq_id and offset.

    A range join by equality on blocks of places: a sequence is listed for each
    block that it touches.
    """
    bounds = runtime.running_sum(sequences.select("seq_id", F.length("seq").cast("bigint").alias("n")), "seq_id", "n", "high")
    spans = bounds.where("n > 0").withColumn("low", F.col("high") - F.col("n")).withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    keyed = places.withColumn("block", F.floor(F.col("place") / block))
    return keyed.join(spans, "block").where("place >= low and place < high").withColumn("offset", F.col("place") - F.col("low")).drop("block", "low", "high", "n")


def adjacent_filter(hits: DataFrame) -> DataFrame:
    """Hits (query_id, frame, seq_id, q_pos, s_pos) without those that overlap or adjoin the one before them on their diagonal."""
    w = Window.partitionBy("query_id", "frame", "seq_id", F.col("s_pos") - F.col("q_pos")).orderBy("s_pos")
    return hits.withColumn("_before", F.lag("q_pos").over(w)).where("_before is null or q_pos > _before + 1").drop("_before")


def masked(sequences: DataFrame) -> DataFrame:
    """sequences with `masked`: low-complexity residues as x; sequences shorter than the window all x."""
    runtime.ship(sequences.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [m if (m := masking.mask(s or "")) is not None else "x" * len(s or "") for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"seq_id": batch.column(0), "masked": pa.array(out, pa.string())})

    return runtime.spread(sequences.select(F.col("seq_id").cast("bigint"), "seq")).mapInArrow(run, "seq_id bigint, masked string")


def karlin_parameters(queries: DataFrame, matrix: ScoreMatrix = BLOSUM62) -> DataFrame:
    """query_id, lambda, k, h, own: ungapped parameters of each sequence; own is false where the ideal ones stand in."""
    runtime.ship(queries.sparkSession)
    ideal = st.ideal_ungapped(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [st.query_ungapped(matrix.alphabet.encode(s or ""), matrix, ideal) for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "lambda": [p.lam for p in rows], "k": [p.k for p in rows], "h": [p.h for p in rows], "own": [p is not ideal for p in rows]})

    return queries.select(F.col("query_id").cast("bigint"), "seq").mapInArrow(run, "query_id bigint, lambda double, k double, h double, own boolean")


def length_adjustments(queries: DataFrame, total: int, sequences: int, p: st.Karlin, alpha: float, beta: float) -> DataFrame:
    """query_id, adjustment, space of each sequence."""
    runtime.ship(queries.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.column(1).to_pylist()
            a = [st.length_adjustment(x, total, sequences, p, alpha, beta) for x in m]
            yield pa.RecordBatch.from_pydict({"query_id": batch.column(0), "adjustment": pa.array(a, pa.int64()), "space": pa.array([st.search_space(total, x, sequences, y) for x, y in zip(m, a, strict=True)], pa.int64())})

    return queries.select(F.col("query_id").cast("bigint"), F.coalesce(F.length("seq"), F.lit(0)).cast("bigint")).mapInArrow(run, "query_id bigint, adjustment bigint, space bigint")


def ungapped_scores(hits: DataFrame, frames: DataFrame, sequences: DataFrame, matrix: ScoreMatrix = BLOSUM62) -> DataFrame:
    """query_id, frame, seq_id, q_pos, s_pos, score of each hit."""

    def kernel(hits: search.Hits) -> pa.RecordBatch:
        score = al.ungapped_score(hits.q, hits.s, matrix.values, hits.ux)
        q_pos, s_pos = (x + np.int32(1) for x in hits.places.values())
        return pa.RecordBatch.from_pydict({"query_id": hits.query_id, "frame": hits.frame, "seq_id": hits.seq_id, "q_pos": q_pos, "s_pos": s_pos, "score": score.astype(np.int64)})

    return search.extend_hits(hits, frames, sequences, kernel, "query_id bigint, frame int, seq_id bigint, q_pos int, s_pos int, score bigint", matrix)


def chain_filter(hits: DataFrame, frames: DataFrame, sequences: DataFrame, matrix: ScoreMatrix = BLOSUM62) -> DataFrame:
    """query_id, frame, seq_id, q_pos, s_pos of the hits that are not connected to the one before them on their diagonal."""

    def kernel(hits: search.Hits) -> pa.RecordBatch:
        kept = hits.take(search.unchained(hits, matrix.values))
        q_pos, s_pos = (x + np.int32(1) for x in kept.places.values())
        return pa.RecordBatch.from_pydict({"query_id": kept.query_id, "frame": kept.frame, "seq_id": kept.seq_id, "q_pos": q_pos, "s_pos": s_pos})

    return search.extend_hits(hits, frames, sequences, kernel, "query_id bigint, frame int, seq_id bigint, q_pos int, s_pos int", matrix)
