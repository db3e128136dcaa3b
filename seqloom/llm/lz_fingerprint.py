"""Lempel-Ziv document fingerprints (operator 8).

A text is parsed into dictionary phrases (LZ78: the longest known phrase plus
one code point is a new phrase). The set of phrases, hashed, is sketched by its
least hashes; two sketches estimate the Jaccard likeness of the phrase sets,
which behaves like a compression distance. Sets of up to SIZE phrases are
compared exactly.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.texts import chunks

#: Hashes of a sketch.
SIZE = 128
LOWEST = -(1 << 63)


def parse(text: str, known: set[str], phrase: str = "") -> str:
    """Add the phrases of text to `known`, going on from an unfinished phrase; the unfinished one at the end is returned."""
    add = known.add
    for c in text:
        phrase += c
        if phrase not in known:
            add(phrase)
            phrase = ""
    return phrase


def sketch(known: set[str]) -> np.ndarray:
    """The least SIZE hashes, ascending. (A last, unfinished phrase is in the set already.)"""
    if not known:
        return np.zeros(0, np.uint32)
    crc = zlib.crc32
    h = np.array([crc(p.encode("utf-8", "surrogatepass")) for p in known], np.uint32)
    h ^= h >> np.uint32(16)  # spread the checksum's bits (one-to-one)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    if len(h) > SIZE:
        h = np.partition(h, SIZE + 16)[: SIZE + 16] if len(h) > SIZE + 16 else h
    return np.unique(h)[:SIZE]


def fingerprint(text: str) -> np.ndarray:
    known: set[str] = set()
    parse(text, known)
    return sketch(known)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the least SIZE hashes of both sets that are in both; 1 for two empty sets."""
    if not len(a) and not len(b):
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    both = np.concatenate([a, b])
    both.sort()
    twice = both[1:] == both[:-1]
    union = both[np.concatenate([[True], ~twice])][:SIZE]
    if len(a) < SIZE and len(b) < SIZE:
        return int(twice.sum()) / (len(a) + len(b) - int(twice.sum()))
    common = np.count_nonzero(both[1:][twice] <= union[-1])
    return common / len(union)


def encode(h: np.ndarray) -> str:
    return base64.b64encode(h.astype("<u4").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u4")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every whole text (null: empty). No shuffle."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(a, b - a), "n_chars": pa.array([len(t) for t in texts], pa.int64()), "fingerprint": pa.array([encode(fingerprint(t)) for t in texts], pa.string())})

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, "doc_id bigint, n_chars bigint, fingerprint string")


#: Characters of a text by which rows of one doc_id are dealt to shards.
HEAD = 32
#: Shards at most (beyond 6 MB each they grow with the input; a task holds two documents at a time) and rows sampled a shard for their bounds.
MOST_SHARDS, SAMPLED = 1 << 16, 16


def _below(ord_: Column, head: Column, bounds: list[tuple[int, str]]) -> Column:
    """How many of the sorted bounds are at most (ord, head), by bisection in as many steps as the count has bits."""
    depth = max(1, len(bounds).bit_length())
    padded = bounds + [((1 << 63) - 1, "\U0010ffff" * (HEAD + 1))] * ((1 << depth) - 1 - len(bounds))
    numbers, heads = F.lit([x for x, _ in padded]), F.lit([x for _, x in padded])
    steps = F.lit([1 << i for i in reversed(range(depth))])

    def at_most(k: Column) -> Column:
        n = F.element_at(numbers, k)
        return (n < ord_) | ((n == ord_) & (F.element_at(heads, k) <= head))

    return F.aggregate(steps, F.lit(0), lambda acc, s: F.when(at_most(acc + s), acc + s).otherwise(acc))


def with_neighbours(docs: DataFrame, bytes_each: int = 6 << 20) -> DataFrame:
    """shard, copy, ord, doc_id, text, dealt so that a shard holds a run of documents in ascending order of doc_id, then text.

    The first document of each shard also goes to the shard before it (of the
    first shard: to the last) as copy 1: a document's successor is always at hand
    and no window spans all rows. Bounds are taken from a sample of (doc_id, start
    of the text), so the rows of one doc_id or of none are parted too; they decide
    where a row is worked on, never what comes out. The driver sees SAMPLED rows
    and a first document a shard. One shuffle of the texts, a shard a partition.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("ord"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(runtime.partitions_for(docs, bytes_each), MOST_SHARDS)
    head = F.substring("text", 1, HEAD)
    bounds: list[tuple[int, str]] = []
    if n > 1:
        share = min(1.0, SAMPLED * n / max(1, docs.count()))
        seen = sorted((r["ord"], r["head"]) for r in rows.sample(share, 1).select("ord", head.alias("head")).collect())
        bounds = sorted({seen[i * len(seen) // n] for i in range(1, n)}) if seen else []
    sharded = rows.withColumn("shard", _below(F.col("ord"), head, bounds) if bounds else F.lit(0))
    first = {r["shard"]: (r["low"]["ord"], r["low"]["head"]) for r in sharded.groupBy("shard").agg(F.min(F.struct("ord", head.alias("head"))).alias("low")).collect()}  # a row a shard
    used = sorted(first)
    before = dict(zip(used, used[-1:] + used[:-1], strict=True))
    top = (used[-1] if used else 0) + 1
    own = F.col("shard") + 1
    lows = [first.get(i, (LOWEST, "")) for i in range(top)]
    is_first = (F.col("ord") == F.element_at(F.lit([x for x, _ in lows]), own)) & (head == F.element_at(F.lit([x for _, x in lows]), own))
    previous = F.element_at(F.lit([before.get(i, 0) for i in range(top)]), own)
    here, there = F.struct(F.col("shard").alias("shard"), F.lit(0).alias("copy")), F.struct(previous.alias("shard"), F.lit(1).alias("copy"))
    dealt = sharded.select(F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"), "ord", "doc_id", "text")
    return dealt.select("to.shard", "to.copy", "ord", "doc_id", "text").repartitionById(top, F.col("shard")).sortWithinPartitions("shard", "copy", "ord", "text")


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    docs: doc_id, text; other columns are ignored. Edited: the last
    floor(n_chars / 2) code points are replaced by the first as many (or all) of
    the next document by doc_id; after the last comes the first. A null text is
    empty. Null doc_ids come first; rows of equal doc_id follow one another by
    text. A single document is its own successor. An empty table gives no rows.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # (shard, doc_id, text, phrases and rest after the kept half, sketch)

        def opened(shard: int, doc_id: int | None, text: str) -> tuple:
            keep = len(text) - len(text) // 2
            known: set[str] = set()
            rest = parse(text[:keep], known)
            half = known.copy()
            parse(text[keep:], known, rest)
            return shard, doc_id, text, half, rest, sketch(known)

        def closed(doc: tuple, nxt: str, nxt_sketch: np.ndarray) -> tuple:
            _, doc_id, text, half, rest, own = doc
            cut = len(text) // 2
            tail = nxt[:cut]
            parse(tail, half, rest)
            edited = sketch(half)
            whole = text[: len(text) - cut] + tail
            return doc_id, len(text), hashlib.sha256(whole.encode()).hexdigest(), encode(own), encode(edited), likeness(own, edited), likeness(own, nxt_sketch)

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            kinds = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
            return pa.RecordBatch.from_pydict({k: pa.array(c, t) for (k, t), c in zip(kinds, columns, strict=True)})

        for batch in batches:
            shards, copies, ids = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for a, _, texts in chunks(batch):
                for i, text in enumerate(texts, a):
                    if held and held[0] != shards[i]:
                        raise ValueError("a shard ends without its successor")
                    if copies[i]:
                        if held:
                            out.append(closed(held, text, held[5] if text == held[2] else fingerprint(text)))
                        held = None
                        continue
                    now = opened(shards[i], ids[i], text)
                    if held:
                        out.append(closed(held, text, now[5]))
                    held = now
                    if len(out) >= 500:
                        yield flush()
        if out:
            yield flush()

    return with_neighbours(docs).mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
