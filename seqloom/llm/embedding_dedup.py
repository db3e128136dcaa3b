"""Embedding near-dedup (operator 7).

Cross-polytope hashing: a vector is rotated by rounds of random signs and a fast
Hadamard transform and hashed to the nearest of the axes and their negatives.
A table's key joins `parts` such hashes; multiprobe adds the keys with one part
at its second nearest axis. Vectors that share a key are compared by exact
cosine in double precision. Identical vectors form a class that counts once.

The number of tables follows from a simulation of the collision rate at the
threshold; `parts` from the number of vectors, so chance groups stay small.

A check of all pairs of classes, block by block, follows and adds the links
between vectors that share no key. Its work grows with the square of the classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom import runtime
from seqloom.llm.groups import blocked, by_group, components, least_ids

SEED = 20_240
ROUNDS = 3
#: plan() refuses what would need more tables.
MOST_TABLES = 64
#: Hasher.keys rotates rows of so many components at once, over all tables.
KEY_CELLS = 1 << 15
#: The check of all pairs takes blocks of at most so many vectors, and of so many bytes of doubles where they are long.
CHECK_ROWS, CHECK_BYTES = 1024, 4 << 20


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows (a power of two of columns)."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x


def width_of(dim: int) -> int:
    """Columns of a rotation: a power of two. Signs alone turn few columns to few places, so short vectors are padded too."""
    return max(16, 1 << (dim - 1).bit_length())


class Hasher:
    """Keys of unit vectors of one dimension. A table's rotations depend on its number alone; the first one's is `first`."""

    def __init__(self, dim: int, tables: int, parts: int, seed: int = SEED, first: int = 0):
        self.dim, self.tables, self.parts = dim, tables, parts
        self.width = width_of(dim)
        if dim * tables * (2 * self.width) ** parts >= 1 << 62:
            raise ValueError("keys exceed 62 bits")
        self.signs = np.stack([np.random.default_rng([seed, dim, t]).choice([-1.0, 1.0], (parts, ROUNDS, self.width)) for t in range(first, first + tables)])

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, 1 + parts): the nearest key and those with one part at its second nearest axis."""
        out = np.empty((len(x), self.tables, 1 + self.parts), np.int64)
        base, rows = 2 * self.width, max(1, KEY_CELLS // (self.tables * self.parts * self.width))
        for s in range(0, len(x), rows):
            some = x[s : s + rows]
            y = np.zeros((self.tables, self.parts, len(some), self.width))
            y[..., : self.dim] = some
            for k in range(ROUNDS):
                y = hadamard((y * self.signs[:, :, k, None]).reshape(-1, self.width)).reshape(y.shape)
            size = np.abs(y)
            codes = []
            for _ in range(2):
                axis = size.argmax(axis=-1)[..., None]
                codes.append((2 * axis + (np.take_along_axis(y, axis, -1) < 0))[..., 0])
                np.put_along_axis(size, axis, -1, -1)
            for probe in range(1 + self.parts):
                key = np.repeat(self.dim * self.tables + np.arange(self.tables)[:, None], len(some), axis=1)
                for p in range(self.parts):
                    key = key * base + codes[int(probe == p + 1)][:, p]
                out[s : s + rows, :, probe] = key.T
        return out


def plan(dim: int, n: int, cosine: float, recall: float) -> tuple[int, int]:
    """(tables, parts) for n vectors: the recall of these very tables on simulated pairs at the threshold is `recall` or more.

    Parts are what keeps chance groups small; where MOST_TABLES tables of so many
    parts do not reach the recall, there are fewer parts and larger groups.
    """
    draw = np.random.default_rng(SEED)
    a, b = draw.normal(size=(2, 2000, dim))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (b * a).sum(axis=1)[:, None] * a
    b /= np.maximum(np.linalg.norm(b, axis=1), 1e-12)[:, None]
    b = cosine * a + math.sqrt(1 - cosine * cosine) * b
    wanted = max(2, math.ceil(math.log(4 * max(n, 1)) / math.log(2 * width_of(dim))))
    for parts in range(wanted, 0, -1):
        missed = np.ones(len(a), bool)
        for tables in range(1, MOST_TABLES + 1):
            one = Hasher(dim, 1, parts, first=tables - 1)
            ka, kb = one.keys(a)[:, 0], one.keys(b)[:, 0]
            missed &= ~(ka[:, :, None] == kb[:, None, :]).any(axis=(1, 2))
            if missed.mean() <= 1 - recall:
                return tables, parts
    raise ValueError(f"{MOST_TABLES} tables do not reach a recall of {recall} at a cosine of {cosine}: this method is for closer vectors")


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a column of vectors that have a component other than zero; each is first divided by its greatest one, so that no square over- or underflows."""
    return _unit(_raw(column))


def _raw(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _whole(x: np.ndarray) -> list[int]:
    """A finite vector times a power of two, in whole numbers."""
    m, e = np.frexp(x)
    e = np.where(x == 0, 0, e - e[x != 0].min())
    return [int(a) << int(b) for a, b in zip(np.ldexp(m, 53).tolist(), e.tolist(), strict=True)]


def _reaches(x: np.ndarray, y: np.ndarray, cosine: float) -> bool:
    """Whether the cosine of two vectors, as the nearest double, is at least `cosine`: in whole numbers, without a rounding."""
    a, b = _whole(x), _whole(y)
    dot, squares = sum(map(int.__mul__, a, b)), sum(p * p for p in a) * sum(p * p for p in b)
    least = (Fraction(cosine) + Fraction(float(np.nextafter(cosine, -2.0)))) / 2  # what is below rounds to less than `cosine`
    n, d = least.as_integer_ratio()
    return dot * abs(dot) * d * d >= n * abs(n) * squares


def _settle(link: np.ndarray, cos: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float) -> None:
    """Correct link (cos >= cosine, by unit vectors) where cos is within its rounding error of the threshold; x, y: the vectors of its rows and columns."""
    for i, j in np.argwhere(np.abs(cos - cosine) <= (x.shape[1] + 8) * 2.0**-51):
        link[i, j] = _reaches(x[i], y[j], cosine)


def _by_dim(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose vectors are of one length."""
    lengths = np.asarray(pc.list_value_length(batch.column(column)))
    for d in np.unique(lengths):
        yield batch.filter(pa.array(lengths == d))


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.985) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    vectors: vec_id, embedding (array of numbers); other columns are ignored.
    Pairs with a cosine of at least `cosine`, as the double nearest to it, are
    linked, others never. Those that share a key are found by it: a pair right at
    the threshold with probability `recall` or more, closer ones more surely,
    identical vectors always. The others are found by the check of all pairs
    of distinct vectors that follows, so none is left out. Vectors that are null, empty or zero or hold a null or non-finite component link
    with nothing, as do vectors of different length; components may be of any finite
    size. A recall that MOST_TABLES tables do not reach at the cosine is an error. A null vec_id takes part
    and gets its component's smallest id (null if it has none), not kept.
    Repeated rows are vectors of their own. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    runtime.ship(spark)
    v = F.col("v")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    able = rows.where(F.coalesce(good, F.lit(False)))
    # Identical vectors: a class with its count and a number of its own, written with it; from here on a group of copies is one row.
    classes = runtime.materialize(able.groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id()))
    shape = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}  # a row a vector length
    plans = {d: plan(d, n, cosine, recall) for d, n in shape.items()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_dim(batch, "v"):
                x = _matrix(part.column(1))
                keys = Hasher(x.shape[1], *plans[x.shape[1]]).keys(x).reshape(len(x), -1)
                yield pa.RecordBatch.from_pydict({"key": keys.reshape(-1), "node": part.column(0).take(pa.array(np.repeat(np.arange(len(x)), keys.shape[1])))})

    keyed = runtime.materialize(classes.select("node", "v").mapInArrow(hashed, "key bigint, node bigint"))
    # Only members of groups of two or more need their vectors.
    members = blocked(keyed, "key", "node", 2048).join(classes.select("node", "v", "copies"), "node")

    def verify(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        nodes, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        key, lo, hi = (table.column(c).to_numpy() for c in ("key", "lo", "hi"))
        ends = np.append(starts[1:], len(nodes))
        lists = table.column("v").combine_chunks()
        a, b, n = [], [], []
        linked: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []  # (group start, rows, rows, links)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            raw = _raw(lists.slice(s, e - s))
            x = _unit(raw)
            own = nodes[s:e]
            if lo[s] != hi[s]:
                left, right = np.flatnonzero(block[s:e] == lo[s]), np.flatnonzero(block[s:e] == hi[s])
            else:
                left = right = np.arange(e - s)
            cos = x[left] @ x[right].T
            link = cos >= cosine
            _settle(link, cos, raw[left], raw[right], cosine)
            link &= own[left][:, None] != own[right][None]
            i, j = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
            if len(i):
                linked.append((s, s + left[i], s + right[j], link[np.ix_(i, j)]))
        # Keys of all linked rows at once: a pair counts under the first key that both have.
        place, keys = np.zeros(len(nodes), np.int64), {}
        rows_ = np.unique(np.concatenate([r for _, x, y, _ in linked for r in (x, y)])) if linked else np.zeros(0, np.int64)
        widths = np.asarray(pc.list_value_length(lists))[rows_] if len(rows_) else rows_
        for d in np.unique(widths):
            some = rows_[widths == d]
            place[some] = np.arange(len(some))
            keys[int(d)] = Hasher(int(d), *plans[int(d)]).keys(_matrix(lists.take(pa.array(some))))
        for s, left, right, link in linked:
            crossed = lo[s] != hi[s]
            for star in _stars(link | (nodes[left][:, None] == nodes[right]), nodes[left], nodes[right]):
                a.append(star[1:])
                b.append(np.full(len(star) - 1, star[0]))
                n.append(np.zeros(len(star) - 1, np.int64))
            own = keys[len(lists[s])]
            fresh = _first(link, own[place[left]], own[place[right]], int(key[s]))
            for one, count in ((left, fresh @ copies[right]), *([(right, copies[left] @ fresh)] if crossed else [])):
                has = count > 0
                a.append(nodes[one[has]])
                b.append(nodes[one[has]])
                n.append(count[has].astype(np.int64))
        if a:
            yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})

    partitions = max(runtime.partitions_for(keyed, 1 << 20), int(spark.conf.get("spark.sql.shuffle.partitions")))
    by_key = by_group(members, ["key", "lo", "hi"], [], partitions, verify, LINKS)
    found = runtime.materialize(by_key.unionByName(_keyless(classes, plans, cosine)))
    counts = found.where("a = b").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "node")
    homes = least_ids(components(found.where("a <> b").select("a", "b")), classes)
    known = classes.join(counts, "node", "left").join(homes, "node", "left").select(F.col("v").alias("_v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "least").alias("component_id"))
    marked = rows.withColumn("ok", F.coalesce(good, F.lit(False)))
    linked = marked.where("ok").join(known, F.col("v") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = marked.where("not ok").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: a, b: two nodes of one component; where a = b, n vectors that a is linked with.
LINKS = "a bigint, b bigint, n bigint"


def _keyless(classes: DataFrame, plans: dict[int, tuple[int, int]], cosine: float) -> DataFrame:
    """LINKS of pairs of classes that share no key: every block of vectors against every block.

    Single precision picks what may reach the threshold, with a margin beyond its
    rounding error; keys and then double precision decide on these. Blocks are
    written once and meet in a Cartesian product: nothing is dealt out or sent to the driver.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(d: int) -> pa.RecordBatch:
            nodes, copies, x = map(np.concatenate, zip(*held.pop(d), strict=True))
            with np.errstate(over="ignore"):
                single = x.astype(np.float32)
            x = single if (single == x).all() else x
            return pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "width": pa.array([x.itemsize], pa.int32()), "block": nodes[:1], "nodes": [nodes.tobytes()], "copies": [copies.tobytes()], "x": [x.tobytes()]})

        for batch in batches:
            for part in _by_dim(batch, "v"):
                nodes, copies, x = part.column(0).to_numpy(), part.column(1).to_numpy(), _raw(part.column(2))
                d = x.shape[1]
                most = min(CHECK_ROWS, max(1, CHECK_BYTES // (8 * d)))
                while len(x):
                    room = most - sum(len(h[0]) for h in held.get(d, []))
                    held.setdefault(d, []).append((nodes[:room], copies[:room], x[:room]))
                    if len(x) >= room:
                        yield block(d)
                    nodes, copies, x = nodes[room:], copies[room:], x[room:]
        for d in list(held):
            yield block(d)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = {d: Hasher(d, *p) for d, p in plans.items()}
        room = np.empty(CHECK_ROWS * CHECK_ROWS, np.float32)  # of one product: new memory for each would take longer than the product
        last, left = None, ()
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(name)[r] for name in batch.schema.names}
                d, block = row["d"].as_py(), row["block"].as_py()
                if block != last:  # a block meets many others in turn
                    last, left = block, side(row, "", d)
                yield from pair(left, left if block == row["block_"].as_py() else side(row, "_", d), hashers[d], room)

    def side(row: dict[str, pa.Scalar], name: str, d: int) -> tuple[np.ndarray, ...]:
        raw = np.frombuffer(row["x" + name].as_buffer(), f"f{row['width' + name].as_py()}").astype(np.float64).reshape(-1, d)
        x = _unit(raw)
        return *(np.frombuffer(row[c + name].as_buffer(), np.int64) for c in ("nodes", "copies")), raw, x, x.astype(np.float32)

    def pair(left: tuple, right: tuple, hasher: Hasher, room: np.ndarray) -> Iterator[pa.RecordBatch]:
        (left_nodes, left_copies, left_raw, x, single), (right_nodes, right_copies, right_raw, y, other) = left, right
        d = hasher.dim
        rough = np.matmul(single, other.T, out=room[: len(x) * len(y)].reshape(len(x), len(y)))
        least = np.float32(cosine - (d + 8) * 2.0**-23)
        some = np.flatnonzero(rough.max(axis=1) >= least)
        i, j = np.nonzero(rough[some] >= least)
        i = some[i]
        if left is right:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        rows, at = np.unique(i, return_inverse=True)
        columns, under = np.unique(j, return_inverse=True)
        keys = hasher.keys(np.concatenate([x[rows], y[columns]]))
        apart = _apart(keys[: len(rows)], keys[len(rows) :], at, under)
        i, j = i[apart], j[apart]
        near = np.zeros(len(i), bool)
        for s in range(0, len(i), most := max(1, CHECK_BYTES // (8 * d))):
            p, q = i[s : s + most], j[s : s + most]
            cos = (x[p] * y[q]).sum(axis=1)
            near[s : s + most] = cos >= cosine
            for k in np.flatnonzero(np.abs(cos - cosine) <= (d + 8) * 2.0**-51):
                near[s + k] = _reaches(left_raw[p[k]], right_raw[q[k]], cosine)
        i, j = i[near], j[near]
        if not len(i):
            return
        rows, at = np.unique(i, return_inverse=True)
        columns, under = np.unique(j, return_inverse=True)
        link = np.zeros((len(rows), len(columns)), bool)
        link[at, under] = True
        stars = _stars(link, left_nodes[rows], right_nodes[columns])
        a = [star[1:] for star in stars]
        b = [np.full(len(star) - 1, star[0]) for star in stars]
        n = [np.zeros(len(star) - 1, np.int64) for star in stars]
        for nodes, count in ((left_nodes[rows], link @ right_copies[columns]), (right_nodes[columns], left_copies[rows] @ link)):
            a.append(nodes)
            b.append(nodes)
            n.append(count)
        yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b), "n": np.concatenate(n)})

    blocks = runtime.materialize(classes.select("node", "copies", "v").mapInArrow(pack, "d int, width int, block bigint, nodes binary, copies binary, x binary"))
    others = blocks.select(*(F.col(c).alias(c + "_") for c in blocks.columns))
    # Not an equation of lengths: that would deal all blocks of a length to one task.
    met = blocks.hint("shuffle_replicate_nl").crossJoin(others).where("d - d_ = 0 and block <= block_")
    return met.mapInArrow(check, LINKS)


def _apart(ka: np.ndarray, kb: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of the pairs of rows i of ka and j of kb that have no key in common."""
    left = []
    for s in range(0, len(i), 1 << 16):
        at = np.arange(s, min(s + (1 << 16), len(i)))
        for t in range(ka.shape[1]):
            at = at[~(ka[i[at], t][:, :, None] == kb[j[at], t][:, None]).any(axis=(1, 2))]
        left.append(at)
    return np.concatenate(left)


def _stars(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The nodes of each connected part of two or more, the least first; link[i, j]: left[i] and right[j] are linked. A node may be on both sides."""
    if link.all():
        return [np.unique(np.concatenate([left, right]))]
    stars = []
    rows, columns = np.ones(len(left), bool), np.ones(len(right), bool)  # not yet in a part
    for i in range(len(left)):
        front, star = np.array([i]) if rows[i] else np.zeros(0, np.int64), []
        while len(front):
            rows[front] = False
            met = np.flatnonzero(link[front].any(axis=0) & columns)
            columns[met] = False
            star += [left[front], right[met]]
            front = np.flatnonzero(link[:, met].any(axis=1) & rows)
        if star:
            stars.append(np.unique(np.concatenate(star)))
    return [star for star in stars if len(star) > 1]


def _first(link: np.ndarray, ka: np.ndarray, kb: np.ndarray, key: int) -> np.ndarray:
    """Linked pairs whose first common key, by table and then by value, is this group's."""
    fresh = link.copy()
    for t in range(ka.shape[1]):
        here = bool((ka[:, t] == key).any())
        for p in range(ka.shape[2]):
            for q in range(kb.shape[2]):
                if not fresh.any():
                    return fresh.astype(np.int64)
                same = ka[:, t, p][:, None] == kb[:, t, q][None]
                if here:
                    same &= (ka[:, t, p] < key)[:, None]
                fresh &= ~same
        if here:
            break
    return fresh.astype(np.int64)


def oracle(cosine: float = 0.9) -> str:
    """DuckDB SQL for near_duplicates() over `embeddings`: every pair of rows compared, so it also holds the recall."""
    return f"""
with recursive rows as (select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
good as (
  select r, e, list_max(list_transform(e, lambda x: abs(x))) as m from rows
  where len(list_filter(e, lambda x: isfinite(x))) = len(e) and len(list_filter(e, lambda x: x <> 0)) > 0),
scaled as (select r, list_transform(e, lambda x: x / m) as e, len(e) as d from good),
links as (
  select a.r as a, b.r as b from scaled a join scaled b on a.d = b.d and a.r <> b.r
  where list_cosine_similarity(a.e, b.e) >= {cosine}),
reach(a, b) as (select r, r from rows union select reach.a, links.b from reach join links on reach.b = links.a),
tops as (select a, min(vec_id) as component_id from reach join rows on reach.b = rows.r group by a),
counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, component_id, coalesce(vec_id = component_id, false) as kept
from rows join tops on tops.a = rows.r left join counts on counts.a = rows.r
"""
