import random

import pytest
from pyspark.sql import functions as F

from seqloom.functions import codec
from seqloom.functions.alphabet import BLOSUM62, DNA, PROTEIN, REDUCED, parse_matrix, parse_reduced


def one(spark, seq, expression):
    return spark.createDataFrame([(seq,)], "seq string").select(expression.alias("x")).first()["x"]


def test_reduced_codes_are_equal_within_groups_only():
    groups = "A KR EDNQ C G H ILVM FYW P ST".split()
    of = {x: g for g in groups for x in g}
    for a in PROTEIN.regular:
        for b in PROTEIN.regular:
            assert (REDUCED.code_of[a] == REDUCED.code_of[b]) == (of[a] == of[b])
    assert [REDUCED.code_of[x] for x in "ACEGHIKFPSBJZ*X"] == [*range(13), 13, 14]


def test_class_scores():
    assert dict(zip("ACEGHIKFPS", BLOSUM62.class_scores(REDUCED).tolist(), strict=True)) == {"A": 4, "C": 9, "E": 6, "G": 6, "H": 8, "I": 5, "K": 5, "F": 11, "P": 7, "S": 5}


def test_parse_reduced_takes_the_first_line():
    assert parse_reduced("A KR\nignored").classes == ("A", "KR")


def test_parse_matrix():
    m = parse_matrix("# dna\n\n  A C G T\nA 1 -3 -3 -3\nC -3 1 -3 -3\nG -3 -3 1 -3\nT -3 -3 -3 1\n", DNA)
    assert m.values.shape == (5, 5)
    assert (m.highest, m.lowest) == (1, -3)
    assert m.values[4].tolist() == [0] * 5
    assert (BLOSUM62.values == BLOSUM62.values.T).all()
    assert BLOSUM62.values[PROTEIN.letters.index("J")].tolist() == [0] * 25


@pytest.mark.parametrize("seq", ["ARNDcqEG*x", "", "OU?"])
def test_encode_native_equals_lookup(spark, seq):
    codes = one(spark, seq, codec.encode(F.col("seq")))
    assert codes == PROTEIN.encode(seq).tolist()
    assert one(spark, seq, codec.decode(codec.encode(F.col("seq")))) == PROTEIN.decode(PROTEIN.encode(seq))


def test_unknown():
    assert PROTEIN.encode("x")[0] == 24 and PROTEIN.encode("O")[0] == 24


@pytest.mark.parametrize(
    ("dna", "frames"),
    [("GCCCGCCACCT", "ARH PAT PPP RWR GGG VAG"), ("GCCCGCCACC", "ARH PAT PP GGG VAG WR"), ("AC", ""), ("", "")],
)
def test_six_frames(spark, dna, frames):
    found = one(spark, dna, codec.six_frames(F.col("seq")))
    assert [f["seq"] for f in found] == frames.split()
    assert [f["frame"] for f in found] == list(range(len(frames.split())))


def test_unknown_codon_and_stop(spark):
    assert one(spark, "TAAACNTGA", codec.translate_frame(F.col("seq"), 0)) == "*X*"


def test_reverse_complement(spark):
    query3 = "GCT" * 15 + "ATGAAAGGTGCTTATTGTCCTCTGAATGAT"
    assert one(spark, query3, codec.reverse_complement(F.col("seq"))) == "ATCATTCAGAGGACAATAAGCACCTTTCATAGC" + "AGC" * 14
    dna = "".join(random.Random(1).choice("ACGT") for _ in range(50))
    assert one(spark, dna, codec.reverse_complement(codec.reverse_complement(F.col("seq")))) == dna
    assert one(spark, "AXG", codec.reverse_complement(F.col("seq"))) == "CNT"


def test_coordinates_back_to_dna(spark):
    dna = "GCCCGCCACCTA"
    at = lambda e: one(spark, dna, e)
    n = F.length("seq")
    assert (at(codec.dna_start(F.lit(1), F.lit(0), n)), at(codec.dna_end(F.lit(1), F.lit(0), n))) == (1, 3)
    assert (at(codec.dna_start(F.lit(2), F.lit(2), n)), at(codec.dna_end(F.lit(2), F.lit(2), n))) == (6, 8)
    assert (at(codec.dna_start(F.lit(1), F.lit(3), n)), at(codec.dna_end(F.lit(1), F.lit(3), n))) == (12, 10)
    assert (at(codec.dna_start(F.lit(1), F.lit(5), n)), at(codec.dna_end(F.lit(1), F.lit(5), n))) == (10, 8)


@pytest.mark.parametrize(("a", "b", "d"), [("GMEHQS", "GMEHQS", 0), ("IMEHQS", "LMEHQA", 1)])
def test_distances(spark, a, b, d):
    df = spark.createDataFrame([(a + "AAAA", b + "AAAA")], "a string, b string")
    ra, rb = codec.reduce(F.col("a")), codec.reduce(F.col("b"))
    packed = codec.nibble_distance(codec.context(ra, F.lit(6)), codec.context(rb, F.lit(6)))
    row = df.select(codec.string_distance(ra, rb).alias("s"), packed.alias("n")).first()
    assert (row["s"], row["n"]) == (d, d)


def test_context_leaves_the_sequence(spark):
    seq = "ARNDCQEGHILK"
    inside = [one(spark, seq, codec.context(codec.reduce(F.col("seq")), F.lit(p))) is not None for p in range(1, 13)]
    assert inside == [p - 1 >= 5 and p - 1 + 5 <= 12 for p in range(1, 13)]
