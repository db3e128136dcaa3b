"""Token-ID / binary output (operator 1).

A store is a folder of shard files in ascending document key order. A shard is

    raw ids (u16, or u32 for a vocabulary above 65,536), document after document,
        each with its end id: usable as one memory-mapped array
    footer
        distinct keys, i64 ascending            (for scans)
        minimal perfect hash: bit levels         (for keyed access)
        slots: fingerprint u32, first record u32, records u32
        record starts, u64 counts of ids
    trailer: fixed size, magic last

Each lookup hashes the key to a slot, compares the stored fingerprint and reads
the record's start: constant time whatever the number of documents. Spark's own
text writer puts the bytes down (a row a document; the line separator is the end
id), so any file system that Spark writes to will do, and its output committer
handles retried and lost tasks. Nothing is written outside the store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.bpe import library_words
from seqloom.llm.texts import chunks

MAGIC = b"SLTOKENS"
TRAILER = struct.Struct("<QQQQQQQ8s")
#: Bits of a level of the hash for each key that is left, and the most levels before keys are listed plainly.
GAMMA, LEVELS = 2, 48
#: Stored input bytes to a shard: its ids fit a worker's memory many times over.
SHARD_BYTES = 12 << 20


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finalizer (xor-shift-multiply), vectorized."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: bit levels with rank.

    At each level the keys that are left hash into GAMMA bits a key; those alone
    on their bit are placed, the rest go on. A key's number is the rank of its bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bool arrays
        self.ranks = []
        base = 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(base + counts - 1)
            base += int(counts[-1]) if len(counts) else 0
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        while len(left):
            if len(levels) == LEVELS:
                raise ValueError("keys are not distinct")
            size = max(64, GAMMA * len(left))
            at = (mix(left, len(levels) + 1) % np.uint64(size)).astype(np.int64)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            left = left[hits[at] != 1]
        return cls(levels)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Numbers 0..n-1; for a key outside the set any number or -1."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = (mix(keys[left], level + 1) % np.uint64(len(bits))).astype(np.int64)
            found = bits[at]
            out[left[found]] = ranks[at[found]]
            left = left[~found]
        return out

    def dump(self) -> bytes:
        return struct.pack("<I", len(self.levels)) + b"".join(struct.pack("<I", len(b)) + np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def load(cls, data: memoryview) -> PerfectHash:
        (n,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(n):
            (size,) = struct.unpack_from("<I", data, at)
            length = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at + 4), count=size).astype(bool))
            at += 4 + length
        return cls(levels)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0x51ED) >> np.uint64(32)).astype(np.uint32)


def footer(keys: list[int | None], starts: list[int], width: int, end: bytes) -> bytes:
    """Footer and trailer of a shard whose records have these keys (ascending, nulls first) and starts."""
    nulls = sum(k is None for k in keys)
    real = np.array(keys[nulls:], np.int64)
    distinct, first, counts = np.unique(real, return_index=True, return_counts=True)
    function = PerfectHash.build(distinct.view(np.uint64)) if len(distinct) else PerfectHash([])
    slots = np.zeros(len(distinct), np.dtype([("fp", "<u4"), ("first", "<u4"), ("n", "<u4")]))
    at = function.slot(distinct.view(np.uint64)) if len(distinct) else np.zeros(0, np.int64)
    slots["fp"][at], slots["first"][at], slots["n"][at] = fingerprint(distinct.view(np.uint64)), first + nulls, counts
    bits = function.dump()
    bits += b"\0" * (-len(bits) % 8)
    parts = [distinct.astype("<i8").tobytes(), bits, slots.tobytes(), np.array(starts, "<u8").tobytes()]
    body = b"".join(parts)
    # The writer puts an end id after each row, this one too; it stands after the trailer.
    return body + TRAILER.pack(len(keys), nulls, len(distinct), len(bits), starts[-1], width, len(body), MAGIC)


class Shard:
    """A shard's bytes, opened for keyed access and scans."""

    def __init__(self, data: bytes, end_width: int):
        view = memoryview(data)
        stop = len(view) - end_width
        self.n, self.nulls, n_keys, n_bits, self.ids, width, body, magic = TRAILER.unpack(view[stop - TRAILER.size : stop])
        if magic != MAGIC:
            raise ValueError("not a token shard, or cut short")
        at = stop - TRAILER.size - body
        self.keys = np.frombuffer(view, "<i8", n_keys, at)
        self.function = PerfectHash.load(view[at + 8 * n_keys : at + 8 * n_keys + n_bits])
        at += 8 * n_keys + n_bits
        self.slots = np.frombuffer(view, np.dtype([("fp", "<u4"), ("first", "<u4"), ("n", "<u4")]), n_keys, at)
        self.starts = np.frombuffer(view, "<u8", self.n + 1, at + 12 * n_keys).astype(np.int64)
        self.payload = np.frombuffer(view, f"<u{width}", self.ids)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first record or -1, number of records) of each key, by hash and fingerprint."""
        if not len(self.slots):
            return np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        raw = keys.astype(np.int64).view(np.uint64)
        slot = self.function.slot(raw)
        got = self.slots[np.maximum(slot, 0)]
        hit = (slot >= 0) & (got["fp"] == fingerprint(raw))
        return np.where(hit, got["first"].astype(np.int64), -1), np.where(hit, got["n"].astype(np.int64), 0)

    def record(self, i: int) -> np.ndarray:
        return self.payload[self.starts[i] : self.starts[i + 1]]


def end_mark(end_id: int, width: int) -> bytes:
    return end_id.to_bytes(width, "little")


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode every whole text and write a store at `path` (a folder that must not exist yet).

    docs: doc_id (integers), text; other columns are ignored. A null text is
    empty: its record is the end id alone. Null keys come first and are reached
    by scans only; repeated keys lie side by side, ordered by text, in as many shards
    as they fill (rows of one key are parted by the starts of their texts).
    An empty table writes an empty store. One shuffle, of the texts, by key range.
    """
    runtime.ship(docs.sparkSession)
    width = 2 if _vocabulary(tokenizer_path) <= 1 << 16 else 4
    end = end_mark(end_id, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = library_words(tokenizer_path)
        keys, starts = [], [0]
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in chunks(batch):
                rows = words.encode(texts)
                keys += ids.slice(a, b - a).to_pylist()
                for r in rows:
                    starts.append(starts[-1] + len(r) // width + 1)
                yield pa.RecordBatch.from_pydict({"value": pa.array(rows, pa.binary())})
        if keys:
            yield pa.RecordBatch.from_pydict({"value": pa.array([footer(keys, starts, width, end)], pa.binary())})

    n = runtime.partitions_for(docs, shard_bytes)
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "text").repartitionByRange(n, "doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    # Latin-1 turns each byte of the end id into that very byte.
    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.options(lineSep=end.decode("latin-1"), encoding="ISO-8859-1", compression="none").text(path)
    return path


def _vocabulary(path: str) -> int:
    return max(library_words(path).rules.names) + 1


def _files(spark: SparkSession, path: str, columns: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def scan_store(spark: SparkSession, path: str, end_width: int = 2) -> DataFrame:
    """Every record, found key by key through each shard's hash: shard, record, doc_id, start (in the shard), n_tokens, ids_crc32."""
    runtime.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not (data := content.as_py()):
                    continue
                shard = Shard(data, end_width)
                first, count = shard.find(shard.keys)
                if (first < 0).any():
                    raise ValueError(f"{name}: a key is not in its own index")
                of = np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]) if (count > 1).any() else first
                records = np.concatenate([np.arange(shard.nulls), of]).astype(np.int64)
                keys = pa.array([None] * shard.nulls + np.repeat(shard.keys, count).tolist(), pa.int64())
                crc = [zlib.crc32(shard.record(i).astype("<u4")) for i in records.tolist()]
                starts = shard.starts[records]
                yield pa.RecordBatch.from_pydict({"shard": pa.array([name.rpartition("/")[2][:10]] * len(records)), "record": records, "doc_id": keys, "start": starts, "n_tokens": shard.starts[records + 1] - starts, "ids_crc32": pa.array(crc, pa.int64())})

    return _files(spark, path).select("path", "content").mapInArrow(run, "shard string, record bigint, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def positions(records: DataFrame) -> DataFrame:
    """scan_store() rows with `start` counted over the whole store: shards follow one another in key order.

    The running sum is over a row a shard, not a document.
    """
    records = runtime.materialize(records)
    shards = records.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = shards.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    return records.join(base, "shard").select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard", "record")


def fetch(spark: SparkSession, path: str, keys: DataFrame, end_width: int = 2) -> DataFrame:
    """Keyed access: doc_id, ids of the wanted keys (a row a record; unknown keys give none).

    keys: a table with doc_id. Shards are told apart by their key ranges (a row a
    shard, sent to every task: some 30 bytes for each 12 MB of input) by bisection;
    in each, only the wanted keys are hashed and only their ids returned.
    """
    runtime.ship(spark)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if (data := content.as_py()) and len(k := Shard(data, end_width).keys):
                    yield pa.RecordBatch.from_pydict({"path": [name], "low": [int(k[0])], "high": [int(k[-1])]})

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard(content.as_py(), end_width)
                first, count = shard.find(np.array(wanted, np.int64))
                rows = [(k, shard.record(int(f) + i).astype("<i4")) for k, f, c in zip(wanted, first, count, strict=True) for i in range(c) if f >= 0]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "ids": pa.array([r[1] for r in rows], pa.list_(pa.int32()))})

    files = _files(spark, path).select("path", "content")
    where = sorted((r["low"], r["high"], r["path"]) for r in files.mapInArrow(ranges, "path string, low bigint, high bigint").collect())
    shared = spark.sparkContext.broadcast((np.array([x[0] for x in where], np.int64), np.array([x[1] for x in where], np.int64), [x[2] for x in where]))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, names = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy()
            # Shards are in key order: the wanted one is the last that begins at or before the key, and those before it that end with the key.
            last, begin = np.searchsorted(low, keys, side="right"), np.searchsorted(high, keys, side="left")
            n = np.maximum(last - begin, 0)
            shard = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_pydict({"path": pa.array([names[i] for i in shard], pa.string()), "doc_id": np.repeat(keys, n)})

    wanted = keys.selectExpr("cast(doc_id as bigint) doc_id").where("doc_id is not null").distinct()
    dealt = wanted.mapInArrow(deal, "path string, doc_id bigint").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    by_file = dealt.groupBy("path", "part").agg(F.collect_list("doc_id").alias("wanted"))
    return files.join(by_file, "path").select("content", "wanted").mapInArrow(look, "doc_id bigint, ids array<int>")
