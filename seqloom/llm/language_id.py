"""Language identification by partial matching (operator 9).

Each language has a context tree of bytes up to three long with symbol counts.
A byte costs -log2 p under the longest context of the tree that stands before
it: count / (total + distinct) if the context has seen the byte, otherwise an
escape, distinct / (total + distinct), and the cost under the next shorter
context, down to all bytes alike. Counts are frozen after learning, so the cost
of a byte depends on (context, byte) alone. Every context and byte of the
learning texts is kept, in sorted sparse tables: a byte with its three bytes of
context is one number, looked up in the table of the longest context and, with
the escape's cost, in that of the next shorter one. Distinct numbers of a chunk
of texts are looked up once; a text's exact code length is the sum over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.workers import map_batches

UNDETERMINED = "und"
#: Stands before each text in place of context.
PAD = 10
#: Bytes scored at a time.
CHUNK_BYTES = 1 << 20
#: Bits by which a text may exceed plain bytes of 8 bits each and still be of a learned language: what a few letters exceed them by proves nothing.
RIVAL_BITS = 16
LETTER = regex.compile(r"\p{L}")
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Tree:
    """Costs in bits of one language's context tree.

    fours and threes: a byte with three and with two bytes of context, ascending,
    and their costs. triples: contexts of three bytes with the cost of their
    escape. pairs: that of each context of two bytes (0 where it was never seen).
    one: costs of (byte before, byte).
    """

    def __init__(self, grams: np.ndarray):
        byte = np.bincount(grams & np.uint32(0xFF), minlength=256)
        last = np.bincount(grams & np.uint32(0xFFFF), minlength=1 << 16).reshape(256, 256)
        one = self._blend(last, self._blend(byte[None], np.full((1, 256), 1 / 256)))
        self.one = -np.log2(one).ravel().astype(np.float32)
        self.threes, costs, contexts, escapes = self._level(grams & np.uint32(0xFFFFFF))
        self.three_cost = costs
        self.pairs = np.zeros(1 << 16, np.float32)
        self.pairs[contexts] = escapes
        self.seen = contexts
        self.fours, self.four_cost, self.triples, self.triple_escape = self._level(grams)

    @staticmethod
    def _blend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        total, distinct = counts.sum(axis=1, keepdims=True), (counts > 0).sum(axis=1, keepdims=True)
        whole = np.maximum(total + distinct, 1)
        return np.where(total == 0, shorter, np.where(counts > 0, counts / whole, distinct / whole * shorter))

    @staticmethod
    def _level(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct grams, their costs, contexts, costs of their escapes)."""
        values, counts = np.unique(grams, return_counts=True)
        contexts, at, distinct = np.unique(values >> np.uint32(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, weights=counts, minlength=len(contexts)) + distinct
        return values, -np.log2(counts / total[at]).astype(np.float32), contexts, -np.log2(distinct / total).astype(np.float32)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """Bits of each number's last byte after its first three."""
        out, known = self._find(self.fours, self.four_cost, grams)
        rest = np.flatnonzero(~known)
        g = grams[rest]
        escape, _ = self._find(self.triples, self.triple_escape, g >> np.uint32(8))
        g = g & np.uint32(0xFFFFFF)
        bits, known = self._find(self.threes, self.three_cost, g)
        shorter = self.pairs[g >> np.uint32(8)] + self.one[g & np.uint32(0xFFFF)]
        out[rest] = escape + np.where(known, bits, shorter)
        return out

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value or 0, found) of each wanted key."""
        if not len(keys):
            return np.zeros(len(wanted), np.float32), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = keys[at] == wanted
        return np.where(found, values[at], np.float32(0)), found


class Model:
    """The trees of the learned languages."""

    ORDER = 3

    def __init__(self, languages: list[str], trees: list[Tree]):
        self.languages, self.trees = languages, trees

    @classmethod
    def learn(cls, texts: dict[str, list[bytes]]) -> Model:
        """texts by language; all their contexts are kept."""
        languages = sorted(texts)
        return cls(languages, [Tree(cls.grams(np.frombuffer(b"".join(texts[x]), np.uint8), np.array([len(t) for t in texts[x]], np.int64))) for x in languages])

    @classmethod
    def grams(cls, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """For each byte of texts that lie one after another: three bytes of context (PAD before a text) and the byte, as one number."""
        full = lengths[lengths > 0]
        starts = np.cumsum(full) - full
        wide = data.astype(np.uint32)
        out = wide.copy()
        for k in range(1, cls.ORDER + 1):
            before = np.empty_like(wide)
            before[k:], before[:k] = wide[:-k], PAD
            for i in range(k):  # a text's first bytes have no others before them
                before[(starts + i)[full > i]] = PAD
            out |= before << np.uint32(8 * k)
        return out

    @property
    def pairs(self) -> np.ndarray:
        """Contexts of two bytes of any language."""
        return np.unique(np.concatenate([np.zeros(0, np.uint32), *(t.seen for t in self.trees)]))

    @property
    def triples(self) -> np.ndarray:
        """Contexts of three bytes of any language."""
        return np.unique(np.concatenate([np.zeros(0, np.uint32), *(t.triples for t in self.trees)]))

    @property
    def cost(self) -> np.ndarray:
        """(language, context, byte) costs laid out in full, for inspection of small models."""
        contexts = np.concatenate([np.arange(256, dtype=np.uint32), self.pairs, self.triples])
        grams = (contexts[:, None] << np.uint32(8) | np.arange(256, dtype=np.uint32)).ravel()
        return np.stack([t.cost(grams) for t in self.trees])

    def states(self) -> list[Tree]:
        return self.trees

    def bits(self, data: np.ndarray, lengths: np.ndarray, trees: list[Tree]) -> np.ndarray:
        """(texts, languages) code lengths in bits of texts that lie one after another in data."""
        out = np.zeros((len(lengths), len(trees)))
        full = np.flatnonzero(lengths)
        if not len(full):
            return out
        starts = np.cumsum(lengths[full]) - lengths[full]
        distinct, at = np.unique(self.grams(data, lengths), return_inverse=True)
        for i, tree in enumerate(trees):
            out[full, i] = np.add.reduceat(tree.cost(distinct)[at], starts, dtype=np.float64)
        return out


def posterior(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best column, its share of probability) for code lengths."""
    best = bits.argmin(axis=1)
    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)
    return best, 1 / np.exp2(-gap).sum(axis=1)


def learn(docs: DataFrame, per_language: int = 200, most_documents: int = 20_000, most_bytes: int = 64 << 20) -> Model:
    """A model from up to `per_language` whole documents of each language: those of the least hash of doc_id.

    Only documents that are not held out and have a text and a lang count; of
    several texts of a doc_id in a language, that of the least hash. The sample
    comes to the driver, which bounds it: at most most_documents over all languages
    (one each at least) and most_bytes, an equal share for each language; documents
    that no longer fit a share are passed over, and a language none of whose
    documents fit has its shortest. These three parameters are all that limits the fit.
    """
    spark = docs.sparkSession
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~held_out(F.col("doc_id")))
    usable = usable.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("mark"), F.octet_length("text").alias("size"))
    rows = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    k = max(1, min(per_language, most_documents // max(1, len(rows))))
    # The k least hashes lie below a bound: rows above it stay where they are. Repeated ids can leave too few; then the bound is raised.
    chosen: dict[str, list] = {}
    share = {x: min(1.0, 4 * k / n) for x, n in rows.items()}
    while share:
        bounds = runtime.small_table(spark, [(x, -(1 << 63) + min(int(f * (1 << 64)), (1 << 64) - 1)) for x, f in share.items()], "lang string, bound bigint")
        near = usable.join(F.broadcast(bounds), "lang").where("h <= bound").groupBy("lang", "doc_id", "h").agg(F.min("mark").alias("mark"), F.min_by("size", "mark").alias("size"))
        found: dict[str, list] = {x: [] for x in share}
        for r in near.collect():
            found[r["lang"]].append((r["h"], r["doc_id"], r["mark"], r["size"]))
        chosen |= {x: sorted(v)[:k] for x, v in found.items() if len(v) >= k or share[x] == 1}
        share = {x: min(1.0, 8 * f) for x, f in share.items() if x not in chosen}
    picked = []
    for x, some in chosen.items():
        room, fits = most_bytes // len(chosen), []
        for _, i, mark, size in some:
            if size <= room:
                fits.append((i, x, mark))
                room -= size
        picked += fits or [(i, x, mark) for _, i, mark, _ in sorted(some, key=lambda v: v[3])[:1]]
    wanted = runtime.small_table(spark, picked, "doc_id bigint, lang string, mark bigint")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", F.xxhash64("text").alias("mark"), "text").join(F.broadcast(wanted), ["doc_id", "lang", "mark"])
    out: dict[str, list[bytes]] = {}
    for r in texts.dropDuplicates(["doc_id", "lang", "mark"]).select("lang", "text").collect():
        out.setdefault(r["lang"], []).append(r["text"].encode())
    return Model.learn(out)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    docs: doc_id, text, and lang to learn from unless a model is given; other
    columns are ignored. score is the posterior probability of lang_pred under
    equal priors, 2^-bits normalized. Null texts, texts without a letter, and all
    texts if nothing could be learned: lang_pred `und`, score 0. Equal code
    lengths: the first language by name. Null doc_id: not held out, not learned
    from. Repeated rows give a row each. One pass over the texts, no shuffle of them.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, names, score, _ in _judged(shared.value, batch.column(1)):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(start, end - start), "held_out": batch.column(2).slice(start, end - start), "lang_pred": pa.array(names, pa.string()), "score": pa.array(score)})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(rows, run, "doc_id bigint, held_out boolean, lang_pred string, score double")


def _judged(m: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[str], np.ndarray, np.ndarray]]:
    """(first row, end row, languages, scores, bits beyond 8 a byte under the best language) of a column of texts, some megabytes at a time."""
    array = pc.fill_null(texts, "")
    sizes = np.asarray(pc.binary_length(array)).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(array):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + CHUNK_BYTES)))
        part, n = array.slice(start, end - start), sizes[start:end]
        data = np.frombuffer(b"".join(pc.cast(part, pa.binary()).to_pylist()), np.uint8)
        full = np.flatnonzero(n)
        has = np.zeros(len(n), bool)
        if len(full):
            has[full] = np.logical_or.reduceat(LETTERS[data], (np.cumsum(n) - n)[full])
        for i in np.flatnonzero(~has & (n > 0)):  # no ASCII letter
            has[i] = LETTER.search(part[int(i)].as_py()) is not None
        if m.languages:
            bits = m.bits(data, n, m.states())
            best, score = posterior(bits)
            yield start, end, [m.languages[b] if h else UNDETERMINED for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0), bits.min(axis=1) - 8 * n
        else:
            yield start, end, [UNDETERMINED] * len(n), np.zeros(len(n)), np.zeros(len(n))
        start = end


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows of no language: `und`, no language with a share of probability of `least`, or a text that plain bytes
    of 8 bits each describe better than the best language, by more than RIVAL_BITS. One pass, no shuffle.

    Where nothing can be learned (no labelled language), only texts without a letter go.
    Null texts go; repeated rows go or stay alike; other columns pass through.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(learn(docs))
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start, end, names, score, excess in _judged(m, batch.column(at)):
                if m.languages:
                    good = [x != UNDETERMINED and y >= least and z <= RIVAL_BITS for x, y, z in zip(names, score, excess, strict=True)]
                else:
                    good = [LETTER.search(x or "") is not None for x in batch.column(at).slice(start, end - start).to_pylist()]
                yield batch.slice(start, end - start).filter(pa.array(good, pa.bool_()))

    return map_batches(docs, run, docs.schema)
