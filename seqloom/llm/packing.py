"""Best-fit packing (operator 4).

Lengths are whole numbers from 1 to the capacity, so the bins follow from the
histogram of lengths alone: a table of at most `capacity` rows, however many
documents there are. The plan works on runs of equal bins:

* pieces above a third of the capacity: at most two share a bin, so they are
  matched greedily, the longest with the longest that still fits;
* the others, longest first, go where the gap is smallest that takes them.

Each plan record says which ranks of a length go to which bins at which offset.
A piece's rank among those of its length comes from counts by (task, length),
so no task ever gathers all pieces of one length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.bpe import CACHE_CHARS, SPACE, is_latin, library_tokenizer
from seqloom.llm.texts import Splitter, chunks
from seqloom.llm.workers import map_batches, memory

PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Distinct pre-tokens (most with a space in front, so twice the words) that a worker remembers before it starts afresh; changes no result.
CACHE_WORDS = 600_000
#: The same pattern where the classes are short lists: texts of Latin-1 characters.
_LETTERS, _NUMBERS = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBERS}]+| ?[^{SPACE}{_LETTERS}{_NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")


class ByteEncoder:
    """Ids of a byte-level BPE tokenizer file by the tokenizers library, added tokens in texts recognized.

    Texts are cut into pre-tokens by the file family's pattern; each distinct one
    is encoded by the library once a worker. A file with other rules than plain
    byte-level pre-tokens is given whole texts.
    """

    def __init__(self, path: str, special: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec["pre_tokenizer"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = spec["normalizer"] is None and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]
        plain &= not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"])
        self.library = library_tokenizer(path)
        self.library.encode_special_tokens = not special
        self.known: dict[str, bytes] = {}
        self.chars = 0
        self.added = {s: np.array([i], "<u4").tobytes() for s, i in added.items()} if special else {}
        # (Every added token of such a file has a "<", or the quick test below would not do.)
        plain &= all("<" in t for t in added)
        self._cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.split = Splitter(PATTERN) if plain else None
        if plain:
            from tokenizers import pre_tokenizers

            # A pre-token is one word to the library: it is not cut a second time.
            self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)

    def words(self, text: str) -> list[str]:
        """Pre-tokens in order; an added token stands among them as its own string."""
        find = LATIN.findall if is_latin(text) else self.split.findall
        if self._cut and "<" in text and len(parts := self._cut.split(text)) > 1:
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else find(part))]
        return find(text)

    def learn(self, new: set[str], split: list[list[str]]) -> None:
        """Encode new pre-tokens; where there is no room for them, forget all but those of `split`."""
        size = sum(map(len, new))
        if len(self.known) + len(new) > CACHE_WORDS or self.chars + size > CACHE_CHARS:
            self.known, new = {}, set().union(*split)
            self.chars, size = 0, sum(map(len, new))
        self.chars += size
        todo = list(new.difference(self.added))
        self.known |= {w: self.added[w] for w in new.intersection(self.added)}
        for w, e in zip(todo, self.library.encode_batch_fast(todo, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, "<u4").tobytes()

    def raw(self, texts: list[str], together: int = 100) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; new pre-tokens of `together` texts are encoded in one call."""
        if self.split is None:
            return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes] = []
        for at in range(0, len(texts), together):
            split = [self.words(t) for t in texts[at : at + together]]
            new = set().union(*split).difference(self.known)
            if new:
                self.learn(new, split)
            get = self.known.__getitem__
            out += [b"".join(map(get, words)) for words in split]
        return out

    def counts(self, words: list[str]) -> list[int]:
        """Number of ids of each pre-token, without the memory."""
        return [len(e.ids) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.raw([text])[0], "<u4")


_encoders: dict[tuple[str, bool], ByteEncoder] = memory("byte_encoders")


def byte_encoder(path: str, special: bool = True) -> ByteEncoder:
    if (path, special) not in _encoders:
        _encoders[path, special] = ByteEncoder(path, special)
    return _encoders[path, special]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, keep: bool = False) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, task and rank (among this task's pieces of that length)."""
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_encoder(tokenizer_path).raw, np.array([end_id], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in chunks(batch):
                row, piece, start, length, crc, rank, raw = [], [], [], [], [], [], []
                for i, data in enumerate(encode(texts)):
                    e = np.frombuffer(data + end, "<u4")
                    n, at, k = len(e), 0, 0
                    size = n % capacity or capacity
                    while at < n:
                        part = e[at : at + size]
                        row.append(i)
                        piece.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(part))
                        rank.append(seen[size])
                        if keep:
                            raw.append(part.astype("<i4"))
                        seen[size] += 1
                        at, k, size = at + size, k + 1, capacity
                columns = {"doc_id": ids.slice(a, b - a).take(pa.array(row, pa.int32())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(row), pa.int32()), "rank": pa.array(rank, pa.int64())}
                if keep:
                    columns["ids"] = pa.array(raw, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint" + (", ids array<int>" if keep else ""), "byte_encoders")


def plan_bins(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(records, number of bins); a record is (length, first rank, end rank, first bin, pieces of that length to a bin, offset).

    Ranks a <= r < b of a length go to bin `first bin + (r - a) // k`, at
    `offset + (r - a) % k * length`.
    """
    left = {s: n for s, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    records: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first bin, bins)
    bins = 0

    def place(size: int, first: int, count: int, each: int, offset: int) -> None:
        """count pieces into bins from `first`, `each` to a bin."""
        records.append((size, used[size], used[size] + count, first, each, offset))
        used[size] += count
        left[size] -= count

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        size = large[-1]
        n = left[size]
        if not n:
            large.pop()
            continue
        i = bisect.bisect_right(large, min(size, capacity - size)) - 1
        while i >= 0 and (not left[large[i]] or large[i] == size and n < 2):
            i -= 1
        if i < 0:  # nothing fits beside it
            place(size, bins, n, 1, 0)
            gaps.setdefault(capacity - size, []).append((bins, n))
            bins += n
        elif (mate := large[i]) == size:
            place(size, bins, n // 2 * 2, 2, 0)
            gaps.setdefault(capacity - 2 * size, []).append((bins, n // 2))
            bins += n // 2
        else:
            m = min(n, left[mate])
            place(size, bins, m, 1, 0)
            place(mate, bins, m, 1, size)
            gaps.setdefault(capacity - size - mate, []).append((bins, m))
            bins += m
    open_gaps = sorted(gaps)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            i = bisect.bisect_left(open_gaps, size)
            if i == len(open_gaps):
                each = capacity // size
                count = -(-left[size] // each)
                gaps.setdefault(capacity, []).append((bins, count))
                bisect.insort(open_gaps, capacity)
                bins += count
                continue
            gap = open_gaps[i]
            first, count = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                open_gaps.pop(i)
            each = gap // size
            full = min(count, left[size] // each)
            parts = []  # (first, count, gap left)
            if full:
                place(size, first, full * each, each, capacity - gap)
                parts.append((first, full, gap - full_used(each, size)))
            if full < count:
                rest = min(left[size], each)
                if rest:
                    place(size, first + full, rest, rest, capacity - gap)
                    parts.append((first + full, 1, gap - rest * size))
                    if full + 1 < count:
                        parts.append((first + full + 1, count - full - 1, gap))
                else:
                    parts.append((first + full, count - full, gap))
            for f, c, g in parts:
                if g:
                    if g not in gaps:
                        gaps[g] = []
                        bisect.insort(open_gaps, g)
                    gaps[g].append((f, c))
    return records, bins


def full_used(each: int, size: int) -> int:
    return each * size


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, keep: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    docs: doc_id, text; other columns are ignored. A null or empty text is the
    end id alone. Longer documents are cut into pieces of `capacity`, the first
    one shorter. Repeated rows are documents of their own. An empty table gives
    an empty result. Returns doc_id, piece, start, length, ids_crc32,
    sequence_id, offset (and ids with keep).
    """
    cut = runtime.materialize(pieces(docs, tokenizer_path, capacity, end_id, keep))
    by_task = runtime.materialize(cut.groupBy("task", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    records, _ = plan_bins(histogram, capacity)
    spark = docs.sparkSession
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["task", "length"]).withColumn("rank", F.col("base") + F.col("rank"))
    # At most some tens of records a length, whatever the input: the plan is sent to every task.
    plan = runtime.small_table(spark, records or [(0, 0, 0, 0, 1, 0)], "size bigint, low bigint, high bigint, bin bigint, each bigint, at bigint")
    place = F.col("rank") - F.col("low")
    fits = (ranked["length"] == plan["size"]) & (ranked["rank"] >= plan["low"]) & (ranked["rank"] < plan["high"])
    out = ranked.join(F.broadcast(plan), fits)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr("bin + (rank - low) div each").alias("sequence_id"), (F.col("at") + place % F.col("each") * F.col("length")).alias("offset"), *(["ids"] if keep else []))
