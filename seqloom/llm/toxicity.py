"""Toxicity by classifier chains (operator 6).

A chain has a linear (logistic) model for each category, in order. Each model
sees the text's features and the probabilities that the models before it give.
For training those probabilities come out of fold: a document's earlier
probabilities are predicted by models that have not seen it, so later models
learn how far earlier ones can be trusted.

Features: the distinct lower-cased words of the whole text and their first 4, 5
and 6 letters (a stem with unseen endings still counts), of which those stay
whose association with a category could not be chance, and a few shares of
character kinds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.texts import chunks
from seqloom.llm.workers import map_batches, memory

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
FOLDS = 5
#: Distinct words, and characters of them, that a worker remembers.
CACHE_WORDS, CACHE_CHARS = 300_000, 8_000_000
SHAPES = ("letters", "digits", "capitals", "spaces", "marks", "repeats")


def word_features(word: str) -> list[int]:
    """63-bit hashes of the word and its prefixes."""
    parts = [f"w {word}"] + [f"{k} {word[:k]}" for k in PREFIXES if len(word) >= k]
    return [xxhash.xxh3_64_intdigest(p) >> 1 for p in parts]


_ASCII = {name: bytes(sorted(chars)) for name, chars in {"digits": b"0123456789", "capitals": bytes(range(65, 91)), "spaces": b" \t\n\r\f\v", "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 256)])}.items()}


def shapes(text: str, words: list[str], distinct: int) -> list[float]:
    raw = text.encode()
    n = max(1, len(raw))
    share = {k: (n - len(raw.translate(None, chars))) / n if raw else 0.0 for k, chars in _ASCII.items()}
    marks = max(0.0, 1 - share["letters"] - share["digits"] - share["spaces"]) if raw else 0.0
    return [share["letters"], share["digits"], share["capitals"], share["spaces"], marks, 1 - distinct / len(words) if words else 0.0]


@dataclass
class Linear:
    """A logistic model: one weight a column, on standardized columns."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 200) -> Linear:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = ((x - mean) / scale).astype(np.float32)
        n, positive = len(y), y.sum()
        if positive in (0, n):  # one class only
            return cls(mean, scale, np.zeros(x.shape[1]), 20.0 if positive else -20.0)
        w, b = np.zeros(x.shape[1], np.float32), math.log(positive / (n - positive))
        y = y.astype(np.float32)
        # Accelerated gradient steps; the step follows from the largest eigenvalue, by power iteration.
        v = np.full(x.shape[1], 1 / math.sqrt(x.shape[1]), np.float32)
        for _ in range(20):
            v = z.T @ (z @ v)
            top = np.linalg.norm(v)
            v /= max(top, 1e-12)
        step, ww, wb, t = 1 / (top / 4 + n / 4 + penalty), w.copy(), b, 1.0
        for _ in range(rounds):
            g = (1 / (1 + np.exp(-np.clip(z @ ww + wb, -30, 30))) - y).astype(np.float32)
            nw, nb = (ww - step * (z.T @ g + penalty * ww)).astype(np.float32), wb - step * float(g.sum())
            nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ww, wb = (nw + (t - 1) / nt * (nw - w)).astype(np.float32), nb + (t - 1) / nt * (nb - b)
            still = float(np.abs(nw - w).max()) < 1e-4
            w, b, t = nw, nb, nt
            if still:
                break
        return cls(mean, scale, w, float(b))

    def predict(self, x: np.ndarray) -> np.ndarray:
        m = (x - self.mean) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    features: dict[int, int] = field(default_factory=dict)  # hash -> column
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, flat: np.ndarray, sizes: np.ndarray, shape: np.ndarray, labels: np.ndarray, categories: list[str], features: int = 1024) -> Chain:
        """flat: feature hashes, document after document, `sizes` each; shape: a row a document; labels: a 0/1 column a category; features: so many words and prefixes at most. No rows: a chain that finds nothing."""
        chain = cls(list(categories))
        rows = len(sizes)
        if not rows:
            return chain
        at = np.repeat(np.arange(rows, dtype=np.int32), sizes)
        values, place = np.unique(flat, return_inverse=True)
        chosen = _select(place, at, labels, len(values), features)
        chain.features = {int(values[p]): i for i, p in enumerate(chosen)}
        column = np.full(len(values), -1, np.int32)
        column[chosen] = np.arange(len(chosen), dtype=np.int32)
        c = column[place]
        x = np.zeros((rows, len(chosen) + len(SHAPES)), np.float32)
        x[at[c >= 0], c[c >= 0]] = 1
        x[:, len(chosen) :] = shape
        del at, c, column, place
        fold = np.arange(rows) % FOLDS
        for k in range(len(categories)):
            y = labels[:, k].astype(float)
            chain.models.append(Linear.fit(x, y))
            out = np.zeros(rows, np.float32)
            for f in range(FOLDS):
                inside = fold != f
                if inside.any() and not inside.all():
                    out[~inside] = Linear.fit(x[inside], y[inside]).predict(x[~inside])
                elif not inside.any():
                    out[~inside] = y.mean()
            chain.thresholds.append(_threshold(out, y))
            x = np.column_stack([x, out])
        return chain

    def predict(self, x: np.ndarray) -> np.ndarray:
        """(documents, categories) probabilities."""
        out = np.zeros((len(x), len(self.categories)))
        for k, m in enumerate(self.models):
            out[:, k] = m.predict(x)
            x = np.column_stack([x, out[:, k]])
        return out


def _select(flat: np.ndarray, at: np.ndarray, labels: np.ndarray, number: int, most: int) -> np.ndarray:
    """The `most` strongest of `number` features, of those whose likelihood-ratio statistic with a category is hardly met by chance among so many (twice the log of their number)."""
    n, df, number = len(labels), np.bincount(flat, minlength=number), max(2, number)
    often = np.flatnonzero(df >= 2)
    total, best = df[often].astype(float), np.zeros(len(often))
    for y in labels.T:
        pos = y.sum()
        if pos in (0, n):
            continue
        both = np.bincount(flat[y[at] > 0], minlength=len(df))[often].astype(float)
        g = np.zeros(len(often))
        for seen, row, col in ((both, total, pos), (total - both, total, n - pos), (pos - both, n - total, pos), (n - total - pos + both, n - total, n - pos)):
            expected = row * col / n
            g += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
        best = np.maximum(best, 2 * g)
    order = np.lexsort((often, -best))
    return often[order[best[order] >= 2 * math.log(number)][:most]]


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that parts out-of-fold predictions best (largest F1, midway between neighbours); 1.1 if there is nothing to find."""
    if not y.sum():
        return 1.1
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    q = p[order]
    last = np.append(q[:-1] > q[1:], True)  # equal probabilities fall on one side
    i = int(np.argmax(np.where(last, f1, -1)))
    return float((q[i] + (q[i + 1] if i + 1 < len(q) else 0)) / 2)


_words: dict[tuple, dict[str, tuple[int, ...]]] = memory("toxicity")


def _vectors(chain: Chain, texts: list[str], key: tuple) -> np.ndarray:
    if key not in _words:
        _words.clear()
        _words[key] = {}
    known, get = _words[key], chain.features.get
    out = np.zeros((len(texts), len(chain.features) + len(SHAPES)))
    for i, text in enumerate(texts):
        words = WORD.findall(text.lower())
        distinct = set(words)
        new = distinct.difference(known)
        if len(known) + len(new) > CACHE_WORDS or sum(map(len, new)) > CACHE_CHARS:
            known.clear()
            new = distinct
        for w in new:
            known[w] = tuple(c for h in word_features(w) if (c := get(h)) is not None)
        on = {c for t in map(known.__getitem__, distinct) if t for c in t}
        out[i, list(on)] = 1
        out[i, len(chain.features) :] = shapes(text, words, len(distinct))
    return out


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], most: int = 6_000, features: int = 1024, most_bytes: int = 64 << 20) -> Chain:
    """A chain from at most `most` labelled documents, those of the least hash of doc_id, with texts of most_bytes in all (documents that no longer fit are passed over).

    labels: doc_id and 0/1 columns. categories: name of each category -> SQL
    condition on the label columns, in chain order. Labels with a null among
    them are left out; of several rows for a document the largest value counts,
    of several texts that of the least hash. `features` bounds the words and
    prefixes that the models weigh (the strongest; in texts to classify all
    words are looked up). These parameters are all that limits the fit. Only the
    sample's features come to the driver.
    """
    names = list(categories)
    n = len(names)
    doc_id, mark = F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")
    flags = labels.select(doc_id, *[F.expr(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())])
    flags = flags.dropna().groupBy("doc_id").agg(*[F.max(f"y{i}").alias(f"y{i}") for i in range(n)])
    sample = runtime.materialize(flags.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    # One text a document, however many rows its id has: reduced before anything moves.
    met = docs.select(doc_id, mark, size).join(F.broadcast(sample.select("doc_id")), "doc_id").groupBy("doc_id").agg(F.min("mark").alias("mark"), F.min_by("size", "mark").alias("size"))
    picked, room = [], most_bytes
    for r in met.orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if r["size"] <= room:
            picked.append((r["doc_id"], r["mark"]))
            room -= r["size"]
    wanted = runtime.small_table(docs.sparkSession, picked, "doc_id bigint, mark bigint").join(sample, "doc_id")
    rows = docs.select(doc_id, mark, F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(wanted), ["doc_id", "mark"]).dropDuplicates(["doc_id"])
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                hashes, shape = [], []
                for text in texts:
                    words = WORD.findall(text.lower())
                    distinct = set(words)
                    hashes.append(sorted({h for w in distinct for h in word_features(w)}))
                    shape.append(shapes(text, words, len(distinct)))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "hashes": pa.array(hashes, pa.list_(pa.int64())), "shape": pa.array(shape, pa.list_(pa.float64()))} | {f"y{i}": part.column(2 + i) for i in range(n)})

    kinds = "doc_id bigint, hashes array<bigint>, shape array<double>" + "".join(f", y{i} int" for i in range(n))
    got = map_batches(rows.select("doc_id", "text", *[f"y{i}" for i in range(n)]), run, kinds).toArrow()
    got = got.combine_chunks().sort_by("doc_id")  # folds do not depend on the tasks
    y = np.column_stack([got.column(f"y{i}").to_numpy() for i in range(n)]) if got.num_rows else np.zeros((0, n), int)
    hashes = got.column("hashes").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    shape = np.array(got.column("shape").to_pylist(), np.float32).reshape(got.num_rows, len(SHAPES))
    return Chain.fit(hashes.flatten().to_numpy(zero_copy_only=False), np.asarray(hashes.value_lengths()) if got.num_rows else np.zeros(0, int), shape, y, names, features)


def classify(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category> for each category in chain order, and <category> (p at or above its threshold).

    docs: doc_id, text; other columns are ignored. A null text counts as empty.
    Repeated rows give a row each; an empty table none; a chain without training
    data gives probability 0 and false. One pass, no shuffle.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    shared = spark.sparkContext.broadcast(chain)
    names = chain.categories
    key = ("all", shared._jbroadcast.id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a, b, texts in chunks(batch):
                p = c.predict(_vectors(c, texts, key))
                columns = {"doc_id": batch.column(0).slice(a, b - a)} | {f"p_{x}": pa.array(p[:, k]) for k, x in enumerate(names)}
                limits = c.thresholds or [1.1] * len(names)
                yield pa.RecordBatch.from_pydict(columns | {x: pa.array(p[:, k] >= limits[k]) for k, x in enumerate(names)})

    kinds = "doc_id bigint" + "".join(f", p_{x} double" for x in names) + "".join(f", {x} boolean" for x in names)
    return map_batches(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, kinds, "toxicity")


#: Chain order: how poor a text is, then whether it is toxic.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that the chain calls toxic. One pass, no shuffle.

    A null text counts as empty; repeated rows go or stay alike; other columns pass
    through whatever their names. Without labelled documents, or for an empty
    table, nothing goes.
    """
    spark = docs.sparkSession
    runtime.ship(spark)
    chain = train(docs, labels, CATEGORIES)
    if not chain.models:
        return docs
    shared = spark.sparkContext.broadcast(chain)
    at, key = [c.lower() for c in docs.columns].index("text"), ("drop", shared._jbroadcast.id())
    toxic = list(CATEGORIES).index("toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for a, b, texts in chunks(pa.RecordBatch.from_arrays([batch.column(at)], ["text"])):
                p = c.predict(_vectors(c, texts, key))[:, toxic]
                yield batch.slice(a, b - a).filter(pa.array(p < c.thresholds[toxic]))

    return map_batches(docs, run, docs.schema, "toxicity")
