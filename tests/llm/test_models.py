"""Operators 6 and 9: fixed values, plain versions, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest_helpers import prose
from seqloom.llm import language_id, toxicity

SOUNDS = {"aa": ["the", "and", "thing", "wher"], "bb": ["der", "und", "schaft", "keit"], "cc": ["que", "les", "eaux", "tion"]}


def speech(lang, seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def plain_costs(texts, order=3):
    """Escape-coded costs by walking contexts, one byte after another."""
    counts = {}
    for t in texts:
        b = bytes([language_id.PAD]) * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                seen = counts.setdefault(b[i - k : i], {})
                seen[b[i]] = seen.get(b[i], 0) + 1

    def cost(text, keep):
        b, bits = bytes([language_id.PAD]) * order + text, 0.0
        for i in range(order, len(b)):
            p = 1.0
            for k in range(order, -1, -1):
                context = b[i - k : i]
                if k >= 2 and context not in keep:
                    continue
                seen = counts.get(context)
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    p *= seen[b[i]] / total
                    break
                p *= len(seen) / total
            else:
                p /= 256
            bits -= math.log2(p)
        return bits

    return cost


def test_code_lengths_equal_plain_partial_matching():
    texts = {x: [speech(x, i).encode() for i in range(5)] for x in SOUNDS}
    model = language_id.Model.learn(texts)
    keep = {int(c).to_bytes(2, "big") for c in model.pairs} | {int(c).to_bytes(3, "big") for c in model.triples}
    probe = [b"", "the undque zéx".encode(), speech("bb", 77).encode(), b"\x00\xff!!"]
    data, n = np.frombuffer(b"".join(probe), np.uint8), np.array([len(t) for t in probe])
    bits = model.bits(data, n, model.states())
    for i, x in enumerate(model.languages):
        cost = plain_costs(texts[x])
        assert bits[:, i] == pytest.approx([cost(t, keep) for t in probe], rel=1e-5)


def test_probabilities_of_a_context_sum_to_at_most_one():
    model = language_id.Model.learn({"aa": [speech("aa", 1).encode()]})
    p = np.exp2(-model.cost.reshape(-1, 256).astype(float)).sum(axis=1)
    assert p.max() <= 1 + 1e-5


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(i, speech(x, i), x if i % 5 else None) for i, x in ((i, list(SOUNDS)[i % 3]) for i in range(300))]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_held_out_accuracy(spoken):
    rows = language_id.identify(spoken).collect()
    truth = {i: list(SOUNDS)[i % 3] for i in range(300)}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert 60 < len(held) < 140
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_a_document_is_not_read(spark, spoken):
    model = language_id.learn(spoken)
    other = spoken.withColumn("lang", F.lit("zz"))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(spoken, model).collect()}
    b = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(other, model).collect()}
    assert a == b


def test_language_stage_drops_foreign_and_random_texts(spark, spoken):
    r = random.Random(1)
    foreign = [
        "Suomen kieli on yksi maailman vaikeimmista kielistä, ja sitä puhuu noin viisi miljoonaa ihmistä.",
        "Język polski należy do grupy zachodniosłowiańskiej i jest językiem urzędowym w Polsce.",
        "Русский язык является одним из восточнославянских языков.",
        "汉语是世界上使用人数最多的语言之一。",
        *("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (20, 70)),
    ]
    planted = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(foreign)], "doc_id bigint, text string, lang string")
    kept = language_id.keep_identified(spoken.union(planted))
    assert sorted(x["doc_id"] for x in kept.collect()) == list(range(300))


def test_language_odd_rows(odd_docs, no_docs):
    rows = language_id.identify(odd_docs).collect()
    assert len(rows) == 13
    for r in rows:
        if r["doc_id"] in (3, 4, 5, 10):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert (r["lang_pred"], r["score"]) == ("en", 1.0)
        else:
            assert not r["held_out"]
    kept = language_id.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 6, 7, 7, 7, 9]
    assert language_id.identify(no_docs).count() == 0 and language_id.keep_identified(no_docs).count() == 0
    nothing = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify(nothing).collect()} == {"und"}
    assert language_id.keep_identified(nothing).count() == 8


@pytest.fixture(scope="module")
def labelled(spark):
    r, rows, labels = random.Random(3), [], []
    for i in range(900):
        words = prose(i, 60).split()
        toxic, poor = r.random() < 0.15, r.random() < 0.1
        if toxic:
            words[r.randrange(60)] = "nastigo" + r.choice(["a", "os", "ern", "ly"])
            words[r.randrange(60)] = r.choice(["vilebrute", "scorndog"])
        if poor:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if poor else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_unseen_documents(labelled):
    docs, labels = labelled
    chain = toxicity.train(docs, labels.where("doc_id % 3 <> 0"), toxicity.CATEGORIES)
    truth = {r["doc_id"]: r for r in labels.collect()}
    rows = [r for r in toxicity.classify(docs, chain).collect() if r["doc_id"] % 3 == 0]
    assert np.mean([r["toxic"] == bool(truth[r["doc_id"]]["toxic"]) for r in rows]) > 0.97
    assert np.mean([r["low_quality"] == (truth[r["doc_id"]]["quality"] == 0) for r in rows]) > 0.97
    assert all(0 <= r["p_toxic"] <= 1 for r in rows)


def test_later_models_see_earlier_probabilities(labelled):
    chain = toxicity.train(*labelled, toxicity.CATEGORIES)
    n = len(chain.features) + len(toxicity.SHAPES)
    assert [len(m.weight) for m in chain.models] == [n, n + 1]


def test_sample_bound(labelled):
    chain = toxicity.train(*labelled, toxicity.CATEGORIES, most=0)
    assert chain.models == []
    docs = labelled[0]
    assert toxicity.classify(docs, chain).where("toxic or p_toxic > 0").count() == 0


def test_toxicity_odd_rows(spark, odd_docs, no_docs, labelled):
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, None), (None, 1, 1), (7, 0, 1), (7, 1, 1), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(odd_docs, labels, toxicity.CATEGORIES)
    assert toxicity.classify(odd_docs, chain).count() == 13
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= 13
    assert toxicity.drop_toxic(no_docs, labels).count() == 0
    assert toxicity.drop_toxic(odd_docs, labels.limit(0)).count() == 13
    docs, many = labelled
    bad = {r["doc_id"] for r in many.where("toxic = 1").collect()}
    left = {r["doc_id"] for r in toxicity.drop_toxic(docs, many).collect()}
    assert len(left & bad) <= 0.03 * len(bad) and len(set(range(900)) - bad - left) <= 5


def test_linear_model_separates():
    r = np.random.default_rng(1)
    x = r.normal(size=(500, 5))
    y = (x @ np.array([2.0, -1, 0, 0, 1]) > 0).astype(float)
    m = toxicity.Linear.fit(x, y)
    assert ((m.predict(x) > 0.5) == y).mean() > 0.97
    assert (toxicity.Linear.fit(x, np.zeros(500)).predict(x) < 1e-6).all()


def plain_fit(x, y, penalty=1.0):
    """Newton's method for the penalized logistic loss on standardized columns; predictions for other rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    return lambda v: 1 / (1 + np.exp(-(np.column_stack([(v - mean) / scale, np.ones(len(v))]) @ w)))


def plain_chain(texts, labels, folds=5):
    """The chain by loops over words and Newton's method: probabilities of its own training texts and thresholds."""
    words = [[w for w in toxicity.WORD.findall(t.lower())] for t in texts]
    sets = [{("w", w) for w in ws} | {(k, w[:k]) for w in ws for k in (4, 5, 6) if len(w) >= k} for ws in words]
    every = sorted(set().union(*sets), key=str)
    n, strong = len(texts), {}
    for f in every:
        has = np.array([f in s for s in sets])
        if has.sum() < 2:
            continue
        best = 0.0
        for y in labels.T:
            g = 0.0
            for a in (has, ~has):
                for b in (y == 1, y == 0):
                    seen, expected = (a & b).sum(), a.sum() * b.sum() / n
                    g += seen * math.log(seen / expected) if seen else 0
            best = max(best, 2 * g)
        if best >= 2 * math.log(len(every)):
            strong[f] = best
    x = np.array([[f in s for f in strong] for s in sets], float)
    x = np.column_stack([x, [toxicity.shapes(t, w, len(set(w))) for t, w in zip(texts, words, strict=True)]])
    known, out = x, []
    for y in labels.T.astype(float):
        outside = np.zeros(n)
        for f in range(folds):
            held = np.arange(n) % folds == f
            outside[held] = plain_fit(x[~held], y[~held])(x[held])
        model = plain_fit(x, y)
        p = model(known)
        out.append(p)
        x, known = np.column_stack([x, outside]), np.column_stack([known, p])
    return np.column_stack(out), len(strong)


def test_chain_equals_plain_chain(spark):
    r = random.Random(4)
    texts, labels = [], []
    for i in range(60):
        bad, poor = i % 4 == 0, i % 3 == 0
        ws = [r.choice(["river", "stone", "lantern", "meadow", "harbor", "garden", "window"]) for _ in range(12)]
        ws += [r.choice(["vileword", "nastyterm"])] * (bad or r.random() < 0.1) + ["CLICK", "buy!!"] * (poor and r.random() < 0.9)
        r.shuffle(ws)
        texts.append(" ".join(ws))
        labels.append((int(not poor), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    flags = spark.createDataFrame([(i, *y) for i, y in enumerate(labels)], "doc_id bigint, quality int, toxic int")
    chain = toxicity.train(docs, flags, toxicity.CATEGORIES)
    got = sorted(toxicity.classify(docs, chain).collect(), key=lambda x: x["doc_id"])
    want, strong = plain_chain(texts, np.array([(1 - q, t) for q, t in labels]))
    assert len(chain.features) == strong > 0
    assert np.abs(np.array([(x["p_low_quality"], x["p_toxic"]) for x in got]) - want).max() < 0.02
    assert [x["toxic"] for x in got] == [p >= chain.thresholds[1] for p in want[:, 1]]


def test_repeated_ids_and_many_languages_are_bounded(spark, spoken):
    texts = {i: speech("aa", i) for i in range(30)}
    rows = [(i, t, "aa") for i, t in texts.items()] + [(3, speech("aa", 1000 + k), "aa") for k in range(200)]
    once = language_id.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), per_language=5)
    again = language_id.learn(spark.createDataFrame(rows * 3, "doc_id bigint, text string, lang string"), per_language=5)
    assert once.trees[0].fours.tolist() == again.trees[0].fours.tolist()
    dirty = spark.createDataFrame([(i, speech("bb", i), f"l{i % 90}") for i in range(900)], "doc_id bigint, text string, lang string")
    model = language_id.learn(dirty, most_documents=90, most_bytes=90 * 100)
    assert len(model.languages) == 90
    assert max(int(t.four_cost.size) for t in model.trees) < 2000
    docs = spark.createDataFrame([(i % 4, f"word{i} stone river") for i in range(400)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(4)], "doc_id bigint, quality int, toxic int")
    assert len(toxicity.train(docs, labels, toxicity.CATEGORIES).models) == 2
    assert not toxicity.train(docs, labels, toxicity.CATEGORIES, most_bytes=0).models
