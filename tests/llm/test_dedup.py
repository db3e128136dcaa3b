"""Operators 2, 7, 8 and 10 against brute force."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from conftest_helpers import prose
from seqloom.llm import embedding_dedup, groups, line_dedup, lz_fingerprint, simhash


def joined(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in pairs:
        a, b = find(i), find(j)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {x["node"]: x["component"] for x in groups.components(df).collect()}
    want = joined(1100, edges)
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {i: want[i] for i in nodes}
    assert groups.components(df.limit(0)).count() == 0


def plain_fingerprint(text, size):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies(seed, n):
    base, r, out = prose(seed, 120).split(), random.Random(seed), []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    return out


def test_simhash_equals_brute_force(spark, odd_docs, no_docs):
    rows = [(100 + i, t) for i, t in enumerate(near_copies(1, 60) + near_copies(2, 40) + [prose(i, 30) for i in range(50)])]
    docs = odd_docs.select("doc_id", "text", "node", "key").union(spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id bigint, text string, node string, key string"))
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    items = docs.collect()
    fp = [plain_fingerprint(r["text"], 3) for r in items]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2]
    home = joined(len(fp), links)
    least = {}
    for i, r in enumerate(items):
        if r["doc_id"] is not None:
            least[home[i]] = min(least.get(home[i], 1 << 60), r["doc_id"])
    key = lambda t: tuple(-1 if x is None else x for x in t)
    want = [(r["doc_id"], fp[i], least.get(home[i])) for i, r in enumerate(items)]
    assert sorted(map(key, want)) == sorted(key((r["doc_id"], r["fingerprint"] % 2**64, r["component_id"])) for r in got)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_block_keys_meet_for_close_fingerprints(spark):
    r = np.random.default_rng(3)
    a = r.integers(-(2**63), 2**63, 200)
    flips = [np.int64(np.bitwise_xor.reduce(np.array([1 << int(b) for b in r.choice(63, 2, replace=False)]))) for _ in a]
    df = spark.createDataFrame([(int(x), int(x ^ f)) for x, f in zip(a, flips, strict=True)], "a bigint, b bigint")
    k = lambda c: simhash.block_keys(F.col(c), 2, 5)
    assert df.select(F.arrays_overlap(k("a"), k("b")).alias("meet")).where("not meet").count() == 0


@pytest.mark.parametrize("limit", [8, 4096])
def test_blocked_groups_lose_no_pair(spark, limit):
    rows = spark.range(50).select(F.lit(1).alias("key"), F.col("id").alias("node")).union(spark.createDataFrame([(2, 100), (2, 101), (3, 200)], "key int, node bigint"))
    for dealt in (groups.blocked(rows, "key", "node", limit), groups.split_hot(rows, rows.select("key"), "key", "node", limit)):
        seen = {}
        for r in dealt.collect():
            seen.setdefault((r["key"], r["lo"], r["hi"]), set()).add(r["node"])
        met = {(a, b) for g in seen.values() for a in g for b in g if a < b}
        assert met == {(a, b) for a in range(50) for b in range(50) if a < b} | {(100, 101)}
        assert max(map(len, seen.values())) <= max(50 if limit > 50 else 4 * limit, 2)


def test_stars_connect_what_brute_force_connects():
    r = np.random.default_rng(9)
    base = r.integers(0, 2**63, (3, 1)).astype(np.uint64)
    fps = np.concatenate([base[[i % 3]] ^ np.array([[1 << int(r.integers(0, 8))]], np.uint64) for i in range(60)])
    want = joined(60, [(i, j) for i in range(60) for j in range(i) if int(np.bitwise_count(fps[i] ^ fps[j]).sum()) <= 2])
    for star in simhash.stars(fps, 2):
        assert {want[i] for i in star.tolist()} == {want[int(star[0])]}
    assert len(simhash.stars(fps, 2)) == len(set(want))


def test_wide_fingerprints_find_similar_documents(spark):
    r, rows, pairs = random.Random(5), [], []
    for g in range(60):
        w = prose(500 + g, 300).split()
        v = list(w)
        for _ in range(4):
            v[r.randrange(len(v))] = "other"
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(v))]
        s = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
        pairs.append(len(s(w) & s(v)) / len(s(w) | s(v)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    found = [got[2 * g + 1] == 2 * g for g in range(60)]
    assert min(pairs) > 0.8 and sum(found) >= 57
    assert len(set(got.values())) >= 60


def test_keep_one(spark, odd_docs, no_docs):
    kept = simhash.keep_one(odd_docs, shingle=5, similarity=0.8)
    assert kept.columns == odd_docs.columns
    ids = sorted(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    assert ids == [1, 3, 6, 7, 7, 9, 10]  # the unlike text of id 7 is a group of its own
    assert simhash.keep_one(no_docs).count() == 0


def similar_pair(seed, words, swapped):
    """Two texts of `words` words that differ in the last `swapped` words, and the Jaccard similarity of their five-word shingle sets."""
    w = prose(seed, words).split()
    v = w[: len(w) - swapped] + prose(seed + 10**6, swapped).split()
    s = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    return " ".join(w), " ".join(v), len(s(w) & s(v)) / len(s(w) | s(v))


def test_similarity_links_by_exact_similarity(spark):
    rows, want = [], []
    for g in range(80):
        a, b, j = similar_pair(900 + g, 304, 33 if g % 2 else 36)  # 0.802 and 0.786
        rows += [(2 * g, a), (2 * g + 1, b)]
        want.append(j >= 0.8)
    short = [prose(50_000 + g, 8) for g in range(40)]
    rows += [(1000 + g, t) for g, t in enumerate(short)] + [(2000 + g, t + " more") for g, t in enumerate(short)]  # 4 of 5 shingles
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()}
    found = [got[2 * g + 1] == 2 * g for g in range(80)]
    assert sum(want) == 40 and not any(f and not w for f, w in zip(found, want, strict=True))
    assert sum(found) >= 38
    assert all(got[2000 + g] == 1000 + g for g in range(40))


def test_set_stars_equal_brute_force():
    r = np.random.default_rng(4)
    base = r.choice(10**6, (4, 40), replace=False)
    sets = [np.unique(np.where(r.random(40) < 0.08, r.integers(10**6, 10**7, 40), base[i % 4])) for i in range(80)] + [np.zeros(0, np.int64)]
    near = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b)) >= 0.8
    want = joined(81, [(i, j) for i in range(81) for j in range(i) if near(sets[i], sets[j])])
    got = simhash.set_stars(sets, 0.8)
    assert sorted(map(sorted, got)) == sorted([i for i in range(81) if want[i] == h] for h in set(want))


def test_repeats_do_not_outvote_the_set(spark):
    own = [prose(70_000 + i, 300) for i in range(3)]
    sentence = prose(80_000, 20)
    rows = [(1, own[0] + " ha" * 60), (2, own[1] + " ha" * 60), (3, f"{own[2]} {sentence}"), (4, own[2] + f" {sentence}" * 15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


def test_keep_one_drops_rows_of_the_group_only(spark, odd_docs):
    null = simhash.keep_one(odd_docs, shingle=5, similarity=0.8).where("doc_id is null").collect()
    assert [r["text"] for r in null] == [prose(8, 60)]
    a, b, c, d = (prose(60_000 + i, 50) for i in range(4))
    rows = [(1, a), (5, a + " more"), (5, b), (None, a), (None, c), (7, c + " more"), (None, d)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, similarity=0.8).collect()
    assert sorted(map(str, kept)) == sorted(map(str, spark.createDataFrame([(1, a), (5, b), (7, c + " more"), (None, d)], "doc_id bigint, text string").collect()))
    # id 3 is the smallest of two groups: it stays for both.
    rows = [(3, a), (3, b), (4, a + " more"), (6, b + " more")]
    kept = sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, similarity=0.8).collect())
    assert kept == sorted([(3, a), (3, b)])


def test_keep_one_knows_rows_by_id_and_text(spark):
    a, b, c = (prose(62_000 + i, 50) for i in range(3))
    keep = lambda rows: sorted(tuple(r) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=5, similarity=0.8).collect())
    assert keep([(3, a), (5, a), (5, b), (6, b), (7, c), (7, c)]) == sorted([(3, a), (5, b), (7, c)])
    assert keep([(1, a), (2, b), (2, c)]) == sorted([(1, a), (2, b), (2, c)])
    df = spark.createDataFrame([(None, a, 1), (None, a + " more", 2), (4, b, 3), (4, b, 2)], "doc_id bigint, text string, _keep_id int")
    kept = simhash.keep_one(df, shingle=5, similarity=0.8).collect()
    assert len(kept) == 2 and {r["doc_id"] for r in kept} == {None, 4}
    assert sorted(map(str, kept)) == sorted(map(str, simhash.keep_one(df.orderBy(F.desc("_keep_id")), shingle=5, similarity=0.8).collect()))


def test_groups_with_null_and_repeated_ids(spark):
    a, b = prose(61_000, 60), prose(61_001, 60)
    docs = spark.createDataFrame([(4, a), (None, a + " more"), (6, a + " more words"), (9, b), (9, prose(61_002, 60)), (12, b + " more")], "doc_id bigint, text string")
    got = sorted(((x["doc_id"] or 0, x["component_id"]) for x in simhash.near_duplicates(docs, shingle=5, similarity=0.8).collect()))
    assert got == [(0, 4), (4, 4), (6, 4), (9, 9), (9, 9), (12, 9)]
    texts = near_copies(1, 60)
    ids = [None if i % 2 else i for i in range(60)]
    fp = [plain_fingerprint(t, 3) for t in texts]
    home = joined(60, [(i, j) for i in range(60) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 2])
    least = {h: min((i for i in range(60) if home[i] == h and ids[i] is not None), default=None) for h in home}
    got = simhash.near_duplicates(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id bigint, text string")).collect()
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(key((x["doc_id"], x["component_id"])) for x in got) == sorted(key((ids[i], least[home[i]])) for i in range(60))
    x = np.random.default_rng(6).normal(size=(3, 24))
    vectors = [(3, x[0]), (None, x[0] + 0.01), (5, x[1]), (5, x[2]), (8, x[2] + 0.01), (7, x[1] + 0.01)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors], "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["component_id"], r["kept"], r["n_links"]) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == [(0, 3, False, 1), (3, 3, True, 1), (5, 5, True, 1), (5, 5, True, 1), (7, 5, False, 1), (8, 5, False, 1)]


LINES = ["alpha beta", "gamma", "delta epsilon zeta", "", "eta theta", "  gamma ", "word " * 60, "lone"]


@pytest.mark.parametrize("window", [2, 3])
def test_line_dedup_equals_sql(spark, window):
    r = random.Random(window)
    rows = [(i, "\n".join(r.choice(LINES) for _ in range(r.randint(0, 9)))) for i in range(120)] + [(500, None), (501, ""), (502, "\n\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = line_dedup.dedup_lines(docs, window=window)
    got = found.select("doc_id", "n_lines", "removed_lines", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5")).collect()
    con = duckdb.connect()
    con.register("frame", docs.toPandas())
    con.sql("create table documents as select doc_id, text from frame")
    con.sql("update documents set text = null where doc_id = 500")
    assert sorted(map(tuple, got)) == sorted(con.sql(line_dedup.oracle(window=window)).fetchall())
    assert sum(x["removed_lines"] for x in got) > 50


def test_line_dedup_odd_rows(odd_docs, no_docs):
    found = line_dedup.dedup_lines(odd_docs)
    assert found.columns == [*odd_docs.columns, "n_lines", "removed_lines"]
    rows = found.collect()
    assert len(rows) == 13
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert by[1] == [prose(1, 200)] and by[2] == [""] and by[3] == [None] and by[6] == [prose(99, 30_000)]
    assert by[7].count(prose(7, 50)) == 2  # one document given twice
    assert line_dedup.dedup_lines(no_docs).count() == 0


def test_line_dedup_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", "x", "y", "z"), (2, "a\nb\nc", "x", "y", "z")], "doc_id bigint, text string, _ld0 string, _ld_5 string, gone string")
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "removed_lines"]
    assert sorted(map(tuple, found.collect())) == [(1, "a\nb", "x", "y", "z", 2, 0), (2, "c", "x", "y", "z", 3, 2)]


def test_line_dedup_is_native(odd_docs):
    plan = line_dedup.dedup_lines(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan


def test_line_dedup_long_passage(spark):
    passage = " ".join(f"w{i}" for i in range(55))
    docs = spark.createDataFrame([(1, f"a\n{passage}\nb"), (2, f"c\n{passage}\nd"), (3, "a short\nline\nelse"), (4, "other\nline\nmore")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()} == {1: f"a\n{passage}\nb", 2: "c\nd", 3: "a short\nline\nelse", 4: "other\nline\nmore"}


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(400, 24))
    x[50:90] = x[10] + 0.05 * r.normal(size=(40, 24))
    x[90:100] = x[20]
    x[100:110] = 3 * x[30] + 0.2 * r.normal(size=(10, 24))
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [(1000, None, "x"), (1001, [0.0] * 24, "x"), (1002, [float("nan")] * 24, "x"), (1003, [1.0, None] * 12, "x"), (1004, [], "x"), (1005, [float("inf")] * 24, "x"), (1006, [1.0, 2.0, 3.0], "x"), (1007, [2.0, 4.0, 6.0], "x"), (7, x[7].tolist(), "x")]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, key string")
    got = embedding_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows) + len(odd)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    home = joined(400, list(zip(*np.nonzero(near), strict=True)))
    for g in got:
        i = g["vec_id"]
        if i < 400:
            assert g["n_links"] == near[i].sum() + (i == 7)
            assert g["component_id"] == home[i] and g["kept"] == (home[i] == i)
        elif i in (1006, 1007):
            assert (g["n_links"], g["component_id"]) == (1, 1006)
        else:
            assert (g["n_links"], g["component_id"], g["kept"]) == (0, i, True)
    con = duckdb.connect()
    con.sql("create table embeddings (vec_id bigint, embedding double[])")
    con.executemany("insert into embeddings values (?, ?)", [r[:2] for r in rows + odd])
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got) == sorted(con.sql(embedding_dedup.oracle()).fetchall())
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def found_and_wanted(spark, x, **options):
    """What near_duplicates() says of the rows of x, and what a comparison of all pairs says."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(df, **options).collect())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    home = np.arange(len(x))
    while True:
        least = np.minimum(home, np.where(near, home[None], len(x)).min(axis=1))
        if (least == home).all():
            return got, list(zip(range(len(x)), near.sum(axis=1).tolist(), home.tolist(), strict=True))
        home = least


@pytest.mark.parametrize("recall", [0.3, 0.985])
def test_embeddings_without_a_common_key(spark, recall):
    r = np.random.default_rng(12)
    a, b = r.normal(size=(2, 1200, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * b / np.linalg.norm(b, axis=1)[:, None]
    got, wanted = found_and_wanted(spark, np.concatenate([a, 3 * b, a[:50]]), recall=recall)
    assert got == wanted


@pytest.mark.parametrize(("dim", "n"), [(1, 20), (2, 300), (3, 2200)])
def test_short_vectors_lose_no_link(spark, dim, n):
    got, wanted = found_and_wanted(spark, np.random.default_rng(dim).normal(size=(n, dim)))
    assert got == wanted


def test_cosine_of_the_threshold_itself_links(spark):
    ten = [[1.0] * 10 + [0.0], [7.0] * 9 + [0.0, 7.0], [0.1] * 8 + [0.0] + [0.1] * 2]
    less = [1.0] * 9 + [0.0, 1.0 + 2.0**-40]
    rows = [(i, v) for i, v in enumerate([*ten, [0.0] * 11 + [1.0] * 10, [0.0] * 11 + less])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted((g["vec_id"], g["n_links"], g["component_id"]) for g in got) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (3, 0, 3), (4, 0, 4)]
    assert embedding_dedup._reaches(np.array(ten[0]) * 2.0**900, np.array(ten[1]) * 2.0**-1000, 0.9)
    assert not embedding_dedup._reaches(np.array(ten[0]), np.array(less), 0.9)


def test_embedding_stars_keep_every_link():
    r = np.random.default_rng(3)
    path = np.zeros((4, 4), bool)
    for i, j in ((0, 2), (2, 3), (3, 1)):  # the least neighbours alone would part 2 from 3
        path[i, j] = path[j, i] = True
    assert {tuple(s.tolist()) for s in embedding_dedup._stars(path | np.eye(4, dtype=bool), np.arange(4), np.arange(4))} == {(0, 1, 2, 3)}
    for _ in range(50):
        link = r.random((12, 9)) < 0.12
        left, right = r.permutation(21)[:12], np.arange(100, 109)
        pairs = [(i, 12 + j) for i, j in np.argwhere(link)]
        home = joined(21, pairs)
        nodes = np.concatenate([left, right])
        wanted = {tuple(sorted(nodes[i] for i in range(21) if home[i] == h)) for h in set(home[i] for p in pairs for i in p)}
        assert {tuple(s.tolist()) for s in embedding_dedup._stars(link, left, right)} == wanted


def test_embedding_plan_reaches_its_recall():
    tables, parts = embedding_dedup.plan(32, 100_000, 0.9, 0.985)
    r = np.random.default_rng(77)
    a, b = r.normal(size=(2, 1000, 32))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(axis=1)[:, None] * a
    b = 0.9 * a + np.sqrt(0.19) * b / np.linalg.norm(b, axis=1)[:, None]
    h = embedding_dedup.Hasher(32, tables, parts)
    ka, kb = h.keys(a), h.keys(b)
    assert (ka[:, :, :, None] == kb[:, :, None, :]).any(axis=(1, 2, 3)).mean() > 0.95


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    y = embedding_dedup.hadamard(x)
    assert np.allclose(embedding_dedup.hadamard(y), 16 * x)
    assert np.allclose((y**2).sum(axis=1), 16 * (x**2).sum(axis=1))


def plain_phrases(text):
    known, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            phrase = ""
    return known


def test_lz_fingerprints(spark, odd_docs, no_docs):
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect()))
    got = lz_fingerprint.compare_edits(odd_docs).collect()
    want = []
    for k, (has, i, text) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][2]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        a, b, c = (lz_fingerprint.fingerprint(t) for t in (text, edited, nxt))
        want.append((i if has else -1, len(text), hashlib.sha256(edited.encode()).hexdigest(), lz_fingerprint.encode(a), lz_fingerprint.encode(b), lz_fingerprint.likeness(a, b), lz_fingerprint.likeness(a, c)))
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == sorted(want)
    assert lz_fingerprint.compare_edits(no_docs).count() == 0
    assert {r["doc_id"] for r in lz_fingerprint.fingerprints(odd_docs).where("n_chars > 0").collect()} >= {1, 2, 6}


def test_lz_over_many_shards(spark):
    docs = spark.createDataFrame([(i * 7 % 1000, prose(i, 5)) for i in range(1000)], "doc_id bigint, text string")
    spread = lz_fingerprint.with_neighbours(docs, bytes_each=1).collect()
    shards = {r["shard"] for r in spread}
    assert len(spread) == 1000 + len(shards) and len(shards) > 2
    got = {r["doc_id"]: r["near_next"] for r in lz_fingerprint.compare_edits(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in (0, 1, 499, 998, 999):
        assert got[i] == lz_fingerprint.likeness(lz_fingerprint.fingerprint(texts[i]), lz_fingerprint.fingerprint(texts[(i + 1) % 1000]))


def test_likeness_is_jaccard_for_small_sets_and_near_it_for_large():
    a, b = prose(1, 20), prose(2, 20)
    f = lz_fingerprint.fingerprint
    A, B = plain_phrases(a), plain_phrases(b)
    if len(A) < 128 and len(B) < 128:
        assert lz_fingerprint.likeness(f(a), f(b)) == pytest.approx(len(A & B) / len(A | B))
    a = prose(3, 4000)
    b = a[: len(a) // 2] + prose(4, 2000)
    A, B = plain_phrases(a), plain_phrases(b)
    assert abs(lz_fingerprint.likeness(f(a), f(b)) - len(A & B) / len(A | B)) < 0.15
    assert lz_fingerprint.likeness(f(""), f("")) == 1 and lz_fingerprint.likeness(f(""), f("a")) == 0
    assert (lz_fingerprint.decode(lz_fingerprint.encode(f(a))) == f(a)).all()


def test_vectors_of_extreme_size(spark):
    rows = [(1, [1e200, 1e200]), (2, [2e200, 2e200]), (3, [1e-200, 2e-200]), (4, [2e-200, 1e-200]), (5, [1e308, -1e308]), (6, [-5e-324, 5e-324]), (7, [1e-320, 1e-320]), (8, [0.0, 5e-324]), (9, [1e300, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()}
    x = np.array([v for _, v in rows])
    x = x / np.abs(x).max(axis=1)[:, None]
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    home = joined(len(x), [(i, j) for i, j in np.argwhere(near)])
    least = {h: min(i for i in range(len(x)) if home[i] == h) + 1 for h in home}
    assert got == {i + 1: (int(near[i].sum()), least[home[i]]) for i in range(len(x))}


def test_plan_refuses_what_it_cannot_find():
    with pytest.raises(ValueError, match="recall"):
        embedding_dedup.plan(64, 10**6, 0.0, 0.9999)
