"""Greedy leader clustering of a database's seeds by their contexts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime


def distances(one: int, many: np.ndarray) -> np.ndarray:
    """How many of the packed four-bit classes differ."""
    x = (many ^ np.int64(one)).view(np.uint64)
    x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & np.uint64(0x1111111111111111)
    return np.bitwise_count(x)


def leaders(contexts: np.ndarray, most: int) -> np.ndarray:
    """Leader's row of each context (packed numbers, or rows of a matrix of classes), in order: the first free one leads, later free ones within `most` mismatches follow it."""
    out = np.full(len(contexts), -1, np.int64)
    free = np.arange(len(contexts))
    while len(free):
        one, many = contexts[free[0]], contexts[free]
        near = (distances(int(one), many) if contexts.ndim == 1 else (many != one).sum(axis=1)) <= most
        out[free[near]] = free[0]
        free = free[~near]
    return out


def cluster(seeds: DataFrame, most: int = 1) -> tuple[DataFrame, DataFrame]:
    """(clustered, single): seeds with rep_ctx and is_rep, and those of no cluster.

    Within a hash, seeds with a context are taken by (seq_id, pos). Seeds of one
    context always share their fate, so only distinct contexts of a hash (at most
    classes ** (context - shortest overlap)) meet in a task, pre-aggregated; a
    hash that a third of all positions have costs a row a distinct context. Seeds
    (a written table, read twice) are joined with their clusters once; contexts
    that very many seeds share are sent to the seeds instead.
    """
    spark = seeds.sparkSession
    runtime.ship(spark)
    # (seq_id, pos) as one number: a hash aggregation takes its least, where a struct would need a sort.
    place = F.col("seq_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("pos")
    distinct = seeds.where("ctx is not null").groupBy("hash", "ctx").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    pos = F.expr(f"pmod(first, cast({1 << 31} as decimal(10,0)))")
    distinct = distinct.withColumn("pos", pos.cast("int")).select("hash", "ctx", F.expr(f"(first - pos) div cast({1 << 31} as decimal(10,0))").alias("seq_id"), "pos", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solve(t: pa.Table) -> pa.RecordBatch:
            h, c = t.column("hash").to_numpy(), t.column("ctx").combine_chunks()
            if pa.types.is_string(c.type):
                shown = np.array(c.to_pylist(), object)
                c = np.frombuffer("".join(shown).encode(), np.uint8).reshape(len(h), -1)
            else:
                shown = c = c.to_numpy()
            n = t.column("n").to_numpy()
            cuts = np.flatnonzero(np.append(True, h[1:] != h[:-1])).tolist() + [len(h)]
            lead = np.empty(len(h), np.int64)
            for a, b in zip(cuts, cuts[1:], strict=False):
                lead[a:b] = a + leaders(c[a:b], most) if b - a > 1 else a
            size = np.bincount(lead, weights=n, minlength=len(h))
            keep = size[lead] > 1
            return pa.RecordBatch.from_pydict({"hash": h[keep], "n": n[keep], "ctx": shown[keep], "rep_ctx": shown[lead][keep], "rep_seq": t.column("seq_id").to_numpy()[lead][keep], "rep_pos": t.column("pos").to_numpy()[lead][keep]})

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            h = t.column("hash").to_numpy()
            if h[0] != h[-1] and len(h) >= 4096:
                cut = int(np.flatnonzero(h != h[-1])[-1]) + 1
                yield solve(t.slice(0, cut).combine_chunks())
                held = t.slice(cut).combine_chunks().to_batches()
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())

    n = runtime.partitions_for(seeds, 16 << 20)
    ordered = distinct.repartition(max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), "hash").sortWithinPartitions("hash", "seq_id", "pos")
    kind = dict(seeds.dtypes)["ctx"]
    homes = runtime.materialize(ordered.mapInArrow(run, f"hash bigint, n bigint, ctx {kind}, rep_ctx {kind}, rep_seq bigint, rep_pos int"))
    placed = runtime.join_hot(seeds, homes, ["hash", "ctx"], "n", "left")
    placed = runtime.materialize(placed.withColumn("is_rep", (F.col("seq_id") == F.col("rep_seq")) & (F.col("pos") == F.col("rep_pos"))).drop("rep_seq", "rep_pos", "n"))
    return placed.where("rep_ctx is not null"), placed.where("rep_ctx is null").select("hash", "seq_id", "pos", "seed_len", "ctx")
