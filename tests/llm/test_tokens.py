"""Operators 1, 3, 4 and 5 against the tokenizers library and plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seqloom import runtime
from seqloom.llm import bpe, packing, token_counts, token_store

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aAbBzZ 'stréeêΣσßİ1２½\n\t\x1c\x85 　<|>字́"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_own_bpe_equals_the_library(text):
    t = Tokenizer.from_file(WORD) if not hasattr(test_own_bpe_equals_the_library, "t") else test_own_bpe_equals_the_library.t
    test_own_bpe_equals_the_library.t = t
    ids = t.encode(text, add_special_tokens=False).ids
    assert bpe.encode_ids(text, WORD).tolist() == ids
    assert bpe.decode_ids(ids, WORD) == t.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(bpe.library_words(WORD).encode([text])[0], "<u2").tolist() == ids


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_byte_encoder_equals_the_library(text):
    t = Tokenizer.from_file(BYTE) if not hasattr(test_byte_encoder_equals_the_library, "t") else test_byte_encoder_equals_the_library.t
    test_byte_encoder_equals_the_library.t = t
    assert packing.byte_encoder(BYTE).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_special_tokens_in_texts(word):
    text = "a <|endoftext|>b<|startoftext|>"
    assert bpe.encode_ids(text, WORD).tolist() == word.encode(text, add_special_tokens=False).ids


def test_round_trip(odd_docs, no_docs, word):
    rows = bpe.round_trip(odd_docs, WORD).collect()
    assert len(rows) == 13
    texts = sorted(((r["doc_id"] or -1), r["text"] or "") for r in odd_docs.collect())
    want = []
    for i, t in texts:
        ids = word.encode(t, add_special_tokens=False).ids
        back = word.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids, back))
    got = [((r["doc_id"] or -1), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["ids"], r["decoded"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert bpe.round_trip(no_docs, WORD).count() == 0


def test_unknown_tokenizer_file_is_refused():
    with pytest.raises(ValueError, match="not a word BPE"):
        bpe.Rules(BYTE)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 20_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(1 << 40, n, replace=False).astype(np.uint64)
    f = token_store.PerfectHash.build(keys)
    assert sorted(f.slot(keys).tolist()) == list(range(n))
    again = token_store.PerfectHash.load(memoryview(f.dump()))
    assert (again.slot(keys) == f.slot(keys)).all()


def test_perfect_hash_needs_distinct_keys():
    with pytest.raises(ValueError, match="distinct"):
        token_store.PerfectHash.build(np.array([5, 5], np.uint64))


def test_token_store(spark, odd_docs, no_docs, word):
    path = token_store.write_store(odd_docs, runtime.work_dir(spark), WORD)
    rows = sorted(token_store.positions(token_store.scan_store(spark, path)).collect(), key=lambda r: r["start"])
    texts = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "") for r in odd_docs.collect()))
    at = 0
    for (has, i, _, t), r in zip(texts, rows, strict=True):
        ids = np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i if has else None, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    wanted = spark.createDataFrame([(7,), (9,), (12345,), (None,)], "doc_id bigint")
    got = token_store.fetch(spark, path, wanted).collect()
    assert sorted(r["doc_id"] for r in got) == [7, 7, 7, 9]
    assert next(r["ids"] for r in got if r["doc_id"] == 9) == [*word.encode("é ß Σ 字 <|endoftext|> x", add_special_tokens=False).ids, 1]
    empty = token_store.write_store(no_docs, runtime.work_dir(spark), WORD)
    assert token_store.positions(token_store.scan_store(spark, empty)).count() == 0


def test_fingerprints_reject_unknown_keys():
    data = b"\1\0" * 1000 + token_store.footer(list(range(0, 2000, 2)), list(range(1001)), 2, b"\1\0") + b"\1\0"
    shard = token_store.Shard(data, 2)
    first, _ = shard.find(np.arange(0, 2000, 2))
    assert first.tolist() == list(range(1000))
    assert (shard.find(np.arange(1, 200_001, 2))[0] >= 0).sum() <= 1
    with pytest.raises(ValueError, match="cut short"):
        token_store.Shard(data[:-4], 2)


def check_plan(histogram, capacity):
    records, bins = packing.plan_bins(histogram, capacity)
    fill, counts = {}, {}
    for size, low, high, first, each, at in records:
        for r in range(low, high):
            fill.setdefault(first + (r - low) // each, []).append((at + (r - low) % each * size, size))
            counts[size] = counts.get(size, 0) + 1
    assert counts == {s: n for s, n in histogram.items() if n}
    assert len(fill) == bins
    for places in fill.values():
        end = 0
        for at, size in sorted(places):
            assert at == end
            end += size
        assert end <= capacity
    return bins


def best_fit_decreasing(histogram, capacity):
    bins = []
    for size in sorted((s for s, n in histogram.items() for _ in range(n)), reverse=True):
        fit = [b for b in range(len(bins)) if bins[b] >= size]
        if fit:
            b = min(fit, key=lambda i: bins[i])
            bins[b] -= size
        else:
            bins.append(capacity - size)
    return len(bins)


def test_plan_is_valid_and_near_best_fit():
    r = random.Random(4)
    for _ in range(150):
        capacity = r.choice([10, 30, 64, 300])
        h = {r.randint(1, capacity): r.randint(1, 12) for _ in range(r.randint(0, 20))}
        bins = check_plan(h, capacity)
        assert bins <= max(best_fit_decreasing(h, capacity) * 1.1 + 1, 1)
        assert bins >= math.ceil(sum(s * n for s, n in h.items()) / capacity)
    assert packing.plan_bins({}, 10) == ([], 0)
    assert check_plan({7: 3, 3: 3, 5: 4}, 10) == 5


def test_pack(odd_docs, no_docs):
    t = Tokenizer.from_file(BYTE)
    rows = packing.pack(odd_docs, BYTE, capacity=64, end_id=0, keep=True).collect()
    want = []
    for r in odd_docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        at, size, k = 0, len(ids) % 64 or 64, 0
        while at < len(ids):
            part = ids[at : at + size]
            want.append((r["doc_id"] or -1, k, at, size, zlib.crc32(np.array(part, "<u4")), part))
            at, size, k = at + size, 64, k + 1
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 64
    assert packing.pack(no_docs, BYTE).count() == 0


SPANS = st.lists(st.sampled_from(["a", "b", " ", "  ", "\n", "1", "'s", "'", "é", "!", "\t", "Z", "don't ", " x"]), max_size=60).map("".join)


@settings(max_examples=300, deadline=None)
@given(SPANS, st.lists(st.tuples(st.integers(0, 90), st.integers(0, 40), SPANS), max_size=4), st.sampled_from([2, 3, 32]))
def test_edits_equal_counting_anew(text, edits, leaf):
    token_counts.LEAF, before = leaf, token_counts.LEAF
    try:
        counter = token_counts.Counter(BYTE)
        tree = token_counts.Tree(text, counter)
        for position, removed, inserted in edits:
            tree.replace(position, removed, inserted)
            p = min(position, len(text))
            text = text[:p] + inserted + text[p + removed :]
            assert tree.text() == text
            assert [w for x in tree.leaves for w in x] == token_counts.SPLIT.findall(text)
        plain = Tokenizer.from_file(BYTE) if not hasattr(test_edits_equal_counting_anew, "t") else test_edits_equal_counting_anew.t
        test_edits_equal_counting_anew.t = plain
        plain.encode_special_tokens = True
        assert tree.count == len(plain.encode(text, add_special_tokens=False).ids)
        assert tree.tokens_before(tree.chars) == tree.count
    finally:
        token_counts.LEAF = before


def test_edits_touch_little():
    counter = token_counts.Counter(BYTE)
    text = "many words stand here " * 2000
    tree = token_counts.Tree(text, counter)
    tree.replace(20_000, 5, "new")
    assert tree.encoded - len(text) < 100


def test_edit_counts(spark, odd_docs, no_docs):
    edits = spark.createDataFrame([(1, [(0, 3, "Zed"), (10**6, 5, " end")]), (3, [(0, 0, "born")]), (6, [(None, None, None)]), (77, [(0, 1, "")])], "doc_id bigint, edits array<struct<position:int,removed:int,inserted:string>>")
    plain = Tokenizer.from_file(BYTE)
    plain.encode_special_tokens = True
    n = lambda x: len(plain.encode(x, add_special_tokens=False).ids)
    rows = token_counts.edit_counts(odd_docs, edits, BYTE, keep_text=True).collect()
    assert len(rows) == 13
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect() if r["doc_id"] not in (None, 7)}
    for r in rows:
        assert r["edited_tokens"] == n(r["edited_text"]) and r["edited_chars"] == len(r["edited_text"])
        if r["doc_id"] in texts:
            assert (r["n_tokens"], r["n_chars"]) == (n(texts[r["doc_id"]]), len(texts[r["doc_id"]]))
    by = {r["doc_id"]: r["edited_text"] for r in rows}
    assert by[1] == "Zed" + texts[1][3:] + " end" and by[3] == "born" and by[6] == texts[6]
    assert token_counts.edit_counts(no_docs, edits, BYTE).count() == 0


LONG_RUNS = [" " * 1_000_000, "\n" * 1_200_000, "\t" * 1_000_000 + "a", " \n" * 600_000 + "end", "x" * 100_000, "-" * 100_000, "7" * 100_000, "　" * 100_000 + "b"]


@pytest.mark.parametrize("text", LONG_RUNS, ids=lambda t: repr(t[:2]) + repr(t[-1]))
def test_long_runs_of_one_kind(text, word):
    byte = Tokenizer.from_file(BYTE)
    ids = byte.encode(text, add_special_tokens=False).ids
    assert packing.byte_encoder(BYTE).ids(text).tolist() == ids
    assert token_counts.Tree(text, token_counts.Counter(BYTE)).count == len(ids)
    ids = word.encode(text, add_special_tokens=False).ids
    assert bpe.encode_ids(text, WORD).tolist() == ids
    assert np.frombuffer(bpe.library_words(WORD).encode([text])[0], "<u2").tolist() == ids


def test_long_white_space_in_plans(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000)], "doc_id bigint, text string")
    byte = Tokenizer.from_file(BYTE)
    n = {r["doc_id"]: len(byte.encode(r["text"], add_special_tokens=False).ids) for r in docs.collect()}
    packed = packing.pack(docs, BYTE).groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in packed} == {k: v + 1 for k, v in n.items()}
    edits = spark.createDataFrame([(1, [(5, 3, "x")])], "doc_id bigint, edits array<struct<position:int,removed:int,inserted:string>>")
    counted = {r["doc_id"]: r for r in token_counts.edit_counts(docs, edits, BYTE).collect()}
    assert {k: r["n_tokens"] for k, r in counted.items()} == n
    assert counted[1]["edited_tokens"] == len(byte.encode("a" + " " * 4 + "x" + " " * 999_993 + "b", add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["İ̤", "aİ̤̣b", "İ́ ᲉꟋ", "\U00010d50x"])
def test_words_are_normalized_once(text, word):
    ids = word.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(bpe.library_words(WORD).encode([text])[0], "<u2").tolist() == ids
    assert bpe.encode_ids(text, WORD).tolist() == ids
