"""SimHash near-dedup (operator 10).

Fingerprints: for each word shingle a 64-bit hash; a bit of the fingerprint is 1
if it is set in over half of the shingles. Documents of equal fingerprints form
a class. Classes are linked by the pigeonhole principle: a 64-bit fingerprint is
split into `blocks` parts; two that differ in at most d bits agree in at least
blocks - d parts, so each choice of that many parts gives a key, close pairs
share a key, and every pair in a key's group is verified by Hamming distance.

`wide` fingerprints (several hashes of each distinct shingle) serve a similarity
threshold on shingle sets instead: keys are bit samples of the fingerprint,
as many and as long as the number of fingerprints and the wanted recall ask for.
Sets of few shingles also have the set less any one shingle as keys. Pairs that
share a key and are near by a loose Hamming bound are candidates only: what they
connect is gathered with its shingle sets, and a pair links by its exact Jaccard
similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.groups import blocked, by_group, components, least_ids, split_hot
from seqloom.llm.texts import chunks
from seqloom.llm.workers import map_batches

SEED = 42
#: Groups of up to so many rows are compared by shifted arrays, all groups of a batch at once.
SMALL = 16
#: Sets of up to so many shingles have exact keys too: their ties make fingerprints less alike than large sets'.
FEW = 9
#: Candidates differ in at most so many standard deviations above the mean at the wanted similarity.
LOOSE = 6
#: Shingle sets of a block in the exact comparison; a task compares at most two blocks at a time.
SET_ROWS = 1024


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles; fewer words than `size`: of the whole sequence; none: empty.

    Words are what ASCII white space separates, A-Z in lower case.
    """
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    return np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))], np.uint64)


def spread(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit hashes of each hash; the first is h itself."""
    out = np.empty((len(h), words), np.uint64)
    out[:, 0] = h
    for i in range(1, words):
        x = h + np.uint64((0x9E3779B97F4A7C15 * i) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, i] = x ^ (x >> np.uint64(31))
    return out


def majority(h: np.ndarray) -> np.ndarray:
    """(words,) fingerprint of (n, words) hashes: bits set in over half of the rows."""
    n, words = h.shape
    if not n:
        return np.zeros(words, np.uint64)
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, n, 255):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(np.ascontiguousarray(h[at : at + 255]).view(np.uint8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > n, bitorder="little").view(np.uint64)


def few_keys(h: np.ndarray) -> list[int]:
    """Negative keys of a set of 1 to FEW distinct shingle hashes: of the set and of the set less any one. Two sets of which one has one shingle more share a key."""
    if not 0 < len(h) <= FEW:
        return []
    whole = h.sum(dtype=np.uint64)
    return (np.append(whole, whole - h) | np.uint64(1 << 63)).view(np.int64).tolist()


def text_mark(text: Column) -> Column:
    """Tells texts apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1) -> DataFrame:
    """doc_id, mark of the text and fingerprint (a bigint for one word, binary for more) of every whole text; a null text counts as empty: all zero.

    One word: every repeat of a shingle counts. More: the set of shingles counts,
    and there are content (a digest of the set) and few (its few_keys()).
    """
    runtime.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch):
                out = {"doc_id": batch.column(0).slice(a, b - a), "mark": batch.column(2).slice(a, b - a)}
                if words == 1:
                    rows = [majority(spread(shingle_hashes(t, shingle), 1))[0] for t in texts]
                    out["fingerprint"] = pa.array(np.array(rows, np.uint64).view(np.int64))
                else:
                    sets = [np.unique(shingle_hashes(t, shingle)) for t in texts]
                    out["fingerprint"] = pa.array([majority(spread(h, words)).tobytes() for h in sets], pa.binary())
                    out["content"] = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
                    out["few"] = pa.array([few_keys(h) for h in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id bigint, mark binary, fingerprint " + ("bigint" if words == 1 else "binary, content binary, few array<bigint>")
    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", text_mark(F.col("text")).alias("mark")), run, schema)


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """array<bigint>: for each choice of (blocks - distance) of the parts of a 64-bit fingerprint, the number of the choice and its bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        key, width = F.lit(number).cast("bigint"), 0
        for part in chosen:
            size = edges[part + 1] - edges[part]
            width += size
            key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(fp, edges[part]).bitwiseAND(F.lit((1 << size) - 1).cast("bigint")))
        if width + number.bit_length() > 63:
            raise ValueError("fewer bits a key, please: more blocks, or a larger distance")
        keys.append(key)
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def group_links(table: pa.Table, starts: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect, within each group, what verified pairs connect."""
    ids = table.column("node").to_numpy()
    raw = table.column("fingerprint")
    if pa.types.is_binary(raw.type):
        data = b"".join(raw.to_pylist())
        fps = np.frombuffer(data, np.uint64).reshape(len(ids), -1)
    else:
        fps = raw.to_numpy().view(np.uint64).reshape(-1, 1)
    sizes = np.diff(np.append(starts, len(ids)))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[group] <= SMALL
    out_a, out_b = [], []
    for d in range(1, min(SMALL, int(sizes.max()))):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            break
        near = popcount(fps[i] ^ fps[i + d]).sum(axis=1, dtype=np.int64) <= distance
        out_a.append(ids[i[near]])
        out_b.append(ids[i[near] + d])
    for g in np.flatnonzero(sizes > SMALL):
        s, e = starts[g], starts[g] + sizes[g]
        at = np.arange(s, e)[np.argsort(ids[s:e], kind="stable")]
        for star in stars(fps[at], distance):
            if len(star) > 1:
                out_a.append(ids[at[star[1:]]])
                out_b.append(np.full(len(star) - 1, ids[at[star[0]]]))
    if out_a and sum(map(len, out_a)):
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(out_a), "b": np.concatenate(out_b)})


def stars(fps: np.ndarray, distance: int) -> list[np.ndarray]:
    """Connected sets of a group, each with its first row in front. Reached rows leave the search, so a tight group costs little more than a pass."""
    left, found = np.arange(len(fps)), []
    while len(left):
        frontier, left = left[:1], left[1:]
        reached = [frontier]
        while len(frontier) and len(left):
            step = max(1, (1 << 21) // (len(left) * fps.shape[1]))
            now, frontier = frontier[:step], frontier[step:]
            near = (popcount(fps[now][:, None] ^ fps[left][None]).sum(axis=2, dtype=np.int32) <= distance).any(axis=0)
            new, left = left[near], left[~near]
            if len(new):
                reached.append(new)
                frontier = np.concatenate([frontier, new])
        found.append(np.concatenate(reached))
    return found


def sampled_keys(classes: DataFrame, bits: int, tables: int, length: int, alone: bool = False) -> DataFrame:
    """key, node, fingerprint (alone: key only): for each of `tables` fixed samples of `length` bit positions, its number and bits."""
    draw = np.random.default_rng(SEED)
    places = np.stack([draw.choice(bits, length, replace=False) for _ in range(tables)])
    weights = (np.uint64(1) << np.arange(length, dtype=np.uint64)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                flat = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                on = np.unpackbits(flat, axis=1, bitorder="little")
                keys = np.stack([(on[:, p].astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) | np.uint64(t << length) for t, p in enumerate(places)])
                if alone:
                    yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(np.int64)})
                    continue
                rows = np.tile(np.arange(part.num_rows), tables)
                yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1).view(np.int64), "node": part.column(0).take(pa.array(rows)), "fingerprint": part.column(1).take(pa.array(rows))})

    return map_batches(classes.select("node", "fingerprint"), run, "key bigint" + ("" if alone else ", node bigint, fingerprint binary"))


def wide_plan(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """(tables, bits a table): keys long enough that chance groups of n fingerprints stay at some tens, tables enough for the recall at the similarity."""
    length = max(16, min(40, math.ceil(math.log2(max(2, n))) - 4))
    share = (1 - flip_rate(similarity)) ** length
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - share))), length


def flip_rate(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity of equally large shingle sets (angle over pi)."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def candidate_keys(classes: DataFrame, bits: int, tables: int, length: int, alone: bool = False) -> DataFrame:
    """sampled_keys() and the exact keys of sets of few shingles."""
    exact = classes.where(F.size("few") > 0).select(F.explode("few").alias("key"), *([] if alone else ["node", "fingerprint"]))
    return sampled_keys(classes, bits, tables, length, alone).unionByName(exact)


def set_stars(sets: list[np.ndarray], similarity: float) -> list[list[int]]:
    """Connected groups of sets (distinct values each) by exact Jaccard similarity, each with its first set in front.

    Common values are counted through lists of the sets that hold a value. Reached sets leave the search and, by halves, the lists.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    local = np.split(flat, np.cumsum(sizes)[:-1])
    left, found, listed = np.ones(m, bool), [], m * 2
    held = first = count = np.zeros(0, np.int64)
    for seed in range(m):
        if not left[seed]:
            continue
        left[seed] = False
        star, at = [seed], 0
        while at < len(star):
            rows = np.flatnonzero(left)
            if not len(rows):
                break
            if 2 * len(rows) <= listed:
                listed = len(rows)
                member = np.concatenate([local[i] for i in rows])
                held = np.repeat(rows, sizes[rows])[np.argsort(member, kind="stable")]
                count = np.bincount(member, minlength=len(values))
                first = np.cumsum(count) - count
            mine = local[star[at]]
            n = count[mine]
            places = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            common = np.bincount(held[places], minlength=m)
            near = left & (common / np.maximum(sizes + len(mine) - common, 1) >= similarity)
            left[near] = False
            star += np.flatnonzero(near).tolist()
            at += 1
        found.append(star)
    return found


def set_links(table: pa.Table, starts: np.ndarray, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect, within each group, what pairs of the similarity connect."""
    nodes, raw = table.column("node").to_numpy(), table.column("shingles")
    out_a, out_b = [], []
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(nodes)], strict=True):
        own, at = np.unique(nodes[s:e], return_index=True)  # a text that several rows have comes several times
        if len(own) < 2:
            continue
        for star in set_stars([np.frombuffer(raw[s + int(i)].as_py(), np.uint64) for i in at], similarity):
            out_a += own[star[1:]].tolist()
            out_b += [int(own[star[0]])] * (len(star) - 1)
    if out_a:
        yield pa.RecordBatch.from_pydict({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})


def verified(docs: DataFrame, rows: DataFrame, classes: DataFrame, near: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) by exact similarity among the classes that candidate links `near` connect; the sets are made anew from one text a class."""
    parts = blocked(components(near), "component", "node", SET_ROWS).groupBy("node", "component").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    wanted = runtime.materialize(rows.select("content", "mark").join(classes.select("content", "node").join(parts, "node"), "content").drop("content").dropDuplicates(["node"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, texts in chunks(batch):
                out: dict[str, list] = {"component": [], "lo": [], "hi": [], "node": [], "shingles": []}
                for node, component, where, text in zip(*(batch.column(k).slice(a, b - a).to_pylist() for k in range(3)), texts, strict=True):
                    if node in seen:
                        continue
                    seen.add(node)
                    h = np.unique(shingle_hashes(text, shingle)).tobytes()
                    for part in where:
                        for k, v in zip(out, (component, part["lo"], part["hi"], node, h), strict=True):
                            out[k].append(v)
                kinds = {"lo": pa.int32(), "hi": pa.int32(), "shingles": pa.binary()}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    texts = docs.select(text_mark(F.col("text")).alias("mark"), "text").join(wanted, "mark").select("node", "component", "parts", "text")
    sets = map_batches(texts, run, "component bigint, lo int, hi int, node bigint, shingles binary")
    partitions = max(runtime.partitions_for(wanted, 1 << 17), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return by_group(sets, ["component", "lo", "hi"], [], partitions, lambda t, s: set_links(t, s, similarity), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, fingerprint, component_id of every document.

    docs: doc_id, text; other columns are ignored. Options are those of grouped().
    Default: 64-bit fingerprints, linked at `max_bits` or fewer differing bits;
    every such link is found. With `similarity`: documents whose sets of shingles
    have at least that Jaccard similarity are linked, others never. A pair at the
    similarity with the mean number of differing bits is found with probability
    `recall` (a little less over their spread), closer ones more surely, one of
    sets of up to FEW - 1 shingles at 0.8 or more always but for the Hamming bound
    of candidates (LOOSE standard deviations above the mean, so hardly ever missed).

    component_id is the smallest doc_id reachable by links, itself included.
    Null or word-free texts have fingerprint zero and link with one another.
    Rows of a null doc_id take part and get the component's smallest id (null if
    it has none); repeated rows give a row each, and unlike texts of one doc_id
    are not linked by it. An empty table gives no rows.
    """
    return grouped(docs, **options).select("doc_id", "fingerprint", "component_id")


def grouped(docs: DataFrame, shingle: int = 3, max_bits: int = 2, blocks: int = 5, similarity: float | None = None, words: int = 8, recall: float = 0.99) -> DataFrame:
    """near_duplicates() with the mark of each text and root, a number that the rows of a group alone have."""
    rows = runtime.materialize(fingerprints(docs, shingle, 1 if similarity is None else words))
    # Classes of equal fingerprints or sets: a pre-aggregated minimum, so a group of copies counts once from here on.
    # Numbers are written with them: no two classes share one, whatever ids their rows have.
    alike = ["fingerprint"] if similarity is None else ["content", "fingerprint", "few"]
    classes = runtime.materialize(rows.groupBy(*alike).agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))
    if similarity is None:
        distance = max_bits
        dealt = blocked(classes.select(F.explode(block_keys(F.col("fingerprint"), max_bits, blocks)).alias("key"), "node", "fingerprint"), "key", "node")
    else:
        bits, rate = 64 * words, flip_rate(similarity)
        distance = math.floor(bits * rate + LOOSE * math.sqrt(bits * rate * (1 - rate)))
        tables, length = wide_plan(classes.count(), similarity, recall)
        dealt = split_hot(candidate_keys(classes, bits, tables, length), candidate_keys(classes, bits, tables, length, alone=True), "key", "node")
    partitions = max(runtime.partitions_for(classes, 1 << 19), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    links = by_group(dealt, ["key", "lo", "hi"], [], partitions, lambda t, s: group_links(t, s, distance), "a bigint, b bigint")
    if similarity is not None:
        links = verified(docs, rows, classes, links, shingle, similarity)
    home = classes.join(least_ids(components(links), classes), "node", "left").select(alike[0], F.coalesce("top", "least").alias("component_id"), F.coalesce("component", "node").alias("root"))
    return rows.join(home, alike[0]).select("doc_id", "mark", "fingerprint", "component_id", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: of the smallest doc_id (null last), then of the least md5 of the text.

    A row is known by doc_id and text, so unlike texts of one doc_id go or stay
    each with its own group, and rows of a null doc_id like any others. Of rows
    equal in both, one stays: that of the least hash of all columns. A null text
    counts as empty. An empty table gives an empty one.
    """
    groups = runtime.materialize(grouped(docs, **options).select(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark").alias("row"), "root"))
    heads = groups.groupBy("root").agg(F.min("row").alias("head"), F.count("*").alias("n"))
    # Written first, so the size is known before the texts are dealt out: few rows are sent to them instead.
    many = runtime.materialize(heads.where("n > 1"))
    members = groups.join(many, "root")
    gone = runtime.materialize(members.where("row <> head").select("row").distinct())
    again = runtime.materialize(members.where("row = head").groupBy("row").count().where("count > 1").select("row"))
    own = "_keep"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    named = lambda t: t.select(F.col("row.doc_id").alias(f"{own}_id"), F.col("row.mark").alias(f"{own}_mark"))
    on = lambda t: docs.doc_id.cast("bigint").eqNullSafe(t[f"{own}_id"]) & (text_mark(docs.text) == t[f"{own}_mark"])
    gone, again = named(gone), named(again)
    kept = docs.join(gone, on(gone), "left_anti")
    if again.isEmpty():
        return kept
    # Equal rows are reduced before they move: a row a task and document.
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    least = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*[F.col(f"`{c}`") for c in hashed])).alias(own)
    one = docs.join(again, on(again)).groupBy(f"{own}_id", f"{own}_mark").agg(least).select(f"{own}.*")
    return kept.join(again, on(again), "left_anti").unionByName(one)
