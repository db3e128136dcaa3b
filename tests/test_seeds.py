import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import codec
from seqloom.functions.alphabet import PROTEIN, REDUCED, parse_reduced
from seqloom.operators import clustering, kernels, seeds


def plain_hash(classes, p, rules):
    value = score = length = 0
    for length in range(rules.longest):  # noqa: B007
        if p + length >= len(classes) or classes[p + length] > rules.reduced.max_code:
            return 0, 0
        if length >= rules.shortest and score >= rules.threshold:
            return value, length
        value = (value << rules.bits) + int(classes[p + length]) + 1
        score += int(rules.scores[classes[p + length]])
    return value, rules.longest


def random_protein(n, seed, letters="ARNDCQEGHILKMFPSTWYVBX"):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


def test_variable_hash():
    rules = seeds.SeedRules()
    assert (rules.bits, rules.max_hash) == (4, 2**32 - 1)
    short = seeds.SeedRules(longest=2, threshold=14)
    value, length = seeds.hash_all(REDUCED.lookup[PROTEIN.encode("GMEHQS")], short)
    assert (value[0], length[0]) == (70, 2)
    classes = REDUCED.lookup[PROTEIN.encode(random_protein(3000, 1))]
    value, length = seeds.hash_all(classes, rules)
    assert list(zip(value.tolist(), length.tolist(), strict=True)) == [plain_hash(classes, p, rules) for p in range(len(classes))]
    assert {6, 7, 8} <= set(length.tolist())


def test_native_hash_equals_kernel(spark):
    seq = random_protein(800, 2)
    df = spark.createDataFrame([(1, seq)], "seq_id bigint, seq string").select("seq_id", codec.reduce(F.col("seq")).alias("cls"))
    rows = seeds.class_windows(df, ["seq_id"], "cls").select("pos", seeds.variable_hash([F.col(f"c{k}") for k in range(8)]).alias("s")).orderBy("pos").collect()
    value, length = seeds.hash_all(REDUCED.lookup[PROTEIN.encode(seq)], seeds.SeedRules())
    assert [(r["s"]["hash"], r["s"]["seed_len"]) if r["s"] else (0, 0) for r in rows] == list(zip(value.tolist(), length.tolist(), strict=True))


def test_fixed_hash_and_neighbours(spark):
    df = spark.createDataFrame([(1, "GMEHQS")], "id bigint, seq string").select("id", codec.reduce(F.col("seq")).alias("cls"))
    row = seeds.class_windows(df, ["id"], "cls", 2).where("pos = 1").select(seeds.fixed_hash([F.col("c0"), F.col("c1")]).alias("hash"))
    assert row.first()["hash"] == (3 << 4) + 5
    assert [seeds.shift_bits(x) for x in (1, 2, 4, 8, 16, 9)] == [1, 1, 2, 3, 4, 4]
    near = [r["neighbour"] for r in seeds.one_mismatch(row, 2, 9).collect()]
    assert len(set(near)) == 18
    assert all(((x >> 4) != 3) + ((x & 15) != 5) == 1 for x in near)


def test_nested_seeds(spark):
    seq = random_protein(2000, 3)
    _, length = seeds.hash_all(REDUCED.lookup[PROTEIN.encode(seq)], seeds.SeedRules())
    want = [p + 1 for p in range(len(seq)) if length[p] and not (p + 1 < len(seq) and length[p + 1] and length[p] - 1 >= length[p + 1])]
    df = spark.createDataFrame([(5, "n", seq)], "seq_id bigint, name string, seq string")
    assert sorted(r["pos"] for r in seeds.subject_seeds(df).collect()) == want
    rows = spark.createDataFrame([(5, p + 1, int(n)) for p, n in enumerate(length) if n], "seq_id bigint, pos int, seed_len int")
    assert sorted(r["pos"] for r in seeds.nested_elimination(rows).collect()) == want


def test_query_seeds_flag(spark):
    seq = random_protein(40, 4, "ACDEFGHIKL")
    df = spark.createDataFrame([(1, 0, seq), (2, 0, "ACDEFGHIK"), (3, 0, None)], "query_id bigint, frame int, masked string")
    rows = seeds.query_seeds(df).collect()
    assert {r["query_id"] for r in rows} == {1}
    assert all(r["checked"] == (r["q_pos"] - 1 >= 5 and r["q_pos"] - 1 < 35) for r in rows)


def plain_leaders(items, most):
    """items: (position, context); greedy over single seeds."""
    out, free = {}, sorted(items)
    while free:
        lead = free[0]
        near = [x for x in free if sum(a != b for a, b in zip(f"{lead[1]:010x}", f"{x[1]:010x}", strict=True)) <= most]
        for x in near:
            out[x[0]] = lead
        free = [x for x in free if x not in near]
    return out


def test_clusters_equal_plain_greedy(spark):
    r = np.random.default_rng(6)
    rows, pos = [], 0
    for h in (11, 12, 13):
        base = r.integers(0, 10, 10)
        for _ in range(60):
            c = base.copy()
            for _ in range(int(r.integers(0, 4))):
                c[r.integers(0, 10)] = r.integers(0, 10)
            pos += 1
            rows.append((h, 1, pos, 8, int("".join(f"{x:x}" for x in c), 16)))
    rows += [(11, 1, 1000, 8, None), (99, 1, 1001, 8, 5)]
    df = spark.createDataFrame(rows, "hash bigint, seq_id bigint, pos int, seed_len int, ctx bigint")
    clustered, single = clustering.cluster(df)
    got = {x["pos"]: (x["rep_ctx"], x["is_rep"]) for x in clustered.collect()}
    want = {}
    for h in (11, 12, 13):
        lead = plain_leaders([(p, c) for hh, _, p, _, c in rows if hh == h and c is not None], 1)
        sizes = {}
        for x in lead.values():
            sizes[x] = sizes.get(x, 0) + 1
        want |= {p: (x[1], x[0] == p) for p, x in lead.items() if sizes[x] > 1}
    assert got == want
    assert {x["pos"] for x in single.collect()} == {x[2] for x in rows} - set(want)


def test_locate_and_adjacent(spark):
    s = spark.createDataFrame([(0, "AAA"), (1, ""), (2, "CCCCC")], "seq_id bigint, seq string")
    places = spark.range(10).select(F.col("id").alias("place"))
    assert sorted((x["place"], x["seq_id"], x["offset"]) for x in kernels.locate(places, s, block=2).collect()) == [(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 2, 0), (4, 2, 1), (5, 2, 2), (6, 2, 3), (7, 2, 4)]
    hits = spark.createDataFrame([(1, 0, 1, q, q + 3) for q in (1, 2, 5)] + [(1, 0, 1, 2, 9)], "query_id int, frame int, seq_id int, q_pos int, s_pos int")
    assert sorted((x["q_pos"], x["s_pos"]) for x in kernels.adjacent_filter(hits).collect()) == [(1, 4), (2, 9), (5, 8)]


WIDE = "A R N D C Q E G H I L K M F P S T W Y V"


@pytest.mark.parametrize("reduced", [seeds.REDUCED, parse_reduced(WIDE)], ids=["10 classes", "25 classes"])
@pytest.mark.parametrize("size", [10, 15, 16, 20])
def test_contexts_of_any_length_and_alphabet(spark, reduced, size):
    rules = seeds.SeedRules(reduced, context=size)
    r = random.Random(size)
    head = "".join(r.choice(PROTEIN.regular) for _ in range(30))
    texts = [head, "W" + head[1:], head[:12] + "YY" + head[14:], head[::-1]]
    codes = [[reduced.code_of[c] for c in t] for t in texts]
    at = np.arange(30)
    got = [seeds.context_column(np.array(c, np.uint8), at, rules).to_pylist() for c in codes]
    df = spark.createDataFrame([(p, i, j, got[i][p], got[j][p]) for p in range(30) for i in range(4) for j in range(i)], f"p int, i int, j int, a {rules.ctx_type}, b {rules.ctx_type}")
    half = size // 2
    for x in df.withColumn("d", codec.context_distance(F.col("a"), F.col("b"), rules.packed)).collect():
        p = x["p"]
        inside = half <= p <= 30 - size + half
        assert (x["a"] is not None) == inside
        if inside:
            assert x["d"] == sum(u != v for u, v in zip(codes[x["i"]][p - half : p - half + size], codes[x["j"]][p - half : p - half + size], strict=True))


@pytest.mark.parametrize(("reduced", "context"), [(None, 20), (WIDE, 10), (WIDE, 17)])
def test_database_with_other_rules(spark, reduced, context):
    from seqloom.plans import homology
    from seqloom.sources import database

    r = random.Random(3)
    base = ["".join(r.choice(PROTEIN.regular) for _ in range(150)) for _ in range(5)]
    rows = [(2 * i + k, f"s{i}", s) for i, s in enumerate(base) for k in range(2)]
    table = spark.createDataFrame(rows, "seq_id bigint, name string, seq string")
    queries = spark.createDataFrame([(i, f"q{i}", s[10:120]) for i, s in enumerate(base)], "query_id bigint, name string, seq string")
    found = []
    for clustering in (True, False):
        db = database.build(table, reduced or database.REDUCED_CLASSES, context=context, clustering=clustering)
        assert (db.clustered.count() > 0) == clustering
        found.append(sorted((x["query"], x["subject"], x["score"]) for x in homology.search(db, queries).collect()))
    assert found[0] == found[1] and len(found[0]) == 10


def test_leaders_of_matrices_and_packed_numbers():
    from seqloom.operators.clustering import leaders

    r = np.random.default_rng(2)
    c = r.integers(0, 3, (200, 6)).astype(np.uint8)
    packed = np.array([int("".join(f"{x:x}" for x in row), 16) for row in c])
    plain, free = [-1] * 200, list(range(200))
    while free:
        near = [i for i in free if (c[i] != c[free[0]]).sum() <= 1]
        for i in near:
            plain[i] = free[0]
        free = [i for i in free if i not in near]
    assert leaders(c, 1).tolist() == plain == leaders(packed, 1).tolist()


def test_running_sum_and_hot_join(spark):
    from seqloom import runtime

    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "o bigint, v bigint")
    got = runtime.running_sum(df.repartition(7), "o", "v", "s", bytes_each=200).orderBy("o").collect()
    assert [x["s"] for x in got] == np.cumsum([i % 5 for i in range(100)]).tolist()
    rows = runtime.materialize(spark.createDataFrame([(i % 3 if i < 90 else i, i) for i in range(100)], "k int, x int"))
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        some = keyed.where("k < 97")
        a = runtime.join_hot(rows, some, ["k"], "n", how, hot_rows=20)
        assert sorted(map(str, a.collect())) == sorted(map(str, rows.join(some, "k", how).collect()))
