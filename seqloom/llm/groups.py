"""Grouped pair search with bounded groups, and connected components.

`blocked` splits every group above a limit into blocks and deals out pairs of
blocks, so that a task holds two blocks at a time however large the group is;
no pair is lost. Links come back as stars or single edges, never as all pairs of
a group. `components` joins links into components with written intermediate
tables; no graph is ever gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.workers import map_batches

#: Rows of a block; a task compares at most two blocks at a time.
BLOCK_ROWS = 4096


def blocked(rows: DataFrame, key: str, member: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """rows with columns lo, hi, block: group (key, lo, hi) has the blocks lo and hi of a key's rows.

    Keys that occur once are left out. Keys of up to block_rows rows form a
    single group. Counting pre-aggregates; the counts of larger keys and of
    single ones are joined back by key.
    """
    counts = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key), F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_nb"))
    joined = rows.join(counts, key)
    block = F.pmod(F.xxhash64(member), F.col("_nb")).cast("int")
    withblock = joined.withColumn("block", F.when(F.col("_nb") == 1, F.lit(0)).otherwise(block))
    dealt = withblock.withColumn("_j", F.explode(F.when(F.col("_nb") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_nb") - 1))))
    return dealt.withColumn("lo", F.least("block", "_j")).withColumn("hi", F.greatest("block", "_j")).drop("_nb", "_j")


def split_hot(rows: DataFrame, keys: DataFrame, key: str, member: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """As blocked(), but rows move once: `keys` has the keys alone, and only those of more than block_rows rows are joined to rows.

    Keys that occur once stay. The table of hot keys is written first, so its size is
    known; where it is small, Spark sends it to the rows instead of dealing rows out.
    """
    hot = runtime.materialize(keys.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > block_rows).select(F.col(key), F.ceil(F.col("_n") / F.lit(block_rows)).cast("int").alias("_nb")))
    joined = rows.join(hot, key, "left").withColumn("_nb", F.coalesce("_nb", F.lit(1)))
    withblock = joined.withColumn("block", F.pmod(F.xxhash64(member), F.col("_nb")).cast("int"))
    dealt = withblock.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return dealt.withColumn("lo", F.least("block", "_j")).withColumn("hi", F.greatest("block", "_j")).drop("_nb", "_j")


def by_group(rows: DataFrame, keys: list[str], order: list[str], partitions: int, fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn(table, group starts) to whole groups; a table holds complete, adjacent groups.

    Only one group or one batch of small groups is in memory at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def starts_of(t: pa.Table) -> np.ndarray:
            change = np.zeros(t.num_rows, bool)
            change[0] = True
            for k in keys:
                v = t.column(k).to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(change)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held)
            starts = starts_of(table)
            if len(starts) > 1:  # the last group may go on in the next batch
                cut = int(starts[-1])
                yield from fn(table.slice(0, cut).combine_chunks(), starts[:-1])
                held = table.slice(cut).combine_chunks().to_batches()
        if held:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from fn(table, starts_of(table))

    return map_batches(rows.repartition(partitions, *keys).sortWithinPartitions(*keys, *order), run, schema)


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reachable.

    edges: bigint columns a, b. Large-star and small-star steps take turns until
    nothing changes (a number of steps that grows with the logarithm of the
    longest path). Each step is written, so a lost executor costs one step, and
    the step before it is deleted.
    """
    now = runtime.materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    for _ in range(limit):
        if not state[0]:
            break
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: neighbours above a node point to the least of its neighbourhood.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        # Small star: a node and its neighbours below point to the least of them.
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m").union(least.select("a", "m")).toDF("a", "b").distinct()
        new = runtime.materialize(small)
        runtime.drop(now)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def least_ids(homes: DataFrame, classes: DataFrame) -> DataFrame:
    """homes (node, component) with top, the least id (column `least` of classes) of the component's nodes, null if none has one."""
    tops = runtime.materialize(homes.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("top")))
    return homes.join(tops, "component")


def _state(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges: equal states mean that a step changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
