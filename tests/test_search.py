import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import ranking
from seqloom.operators.search import SearchOptions
from seqloom.plans import homology
from seqloom.sources import database, fasta

# A small database, queries and their expected alignments.
SUBJECTS = ["SESEWWAKKPILQNFMKGAYCPLND", "TLFVTTSNMFMIQSMATNQLGLRPL", "MKTPQALSQLDRWEQLLESQYSFMF", "CVDQPQIQRCNFEWYHRMQVWGRCD", "ENLVSSSEYRADNWWYVLWIIQLFD", "A" * 25, "AAAAAAAAAAAAAAAMKGAYCPLND"]
QUERIES = ["AGCGAGAGCGAGTGGTGGGCAAAAAAACCTATACTGCAAAATTTTATGAAAGGTGCTTATTGTCCTCTGAATGAT", "AAGCGAGAGCGAGTGGTGGGCAAAAAAACCTATACTGCAAAATTTTATGAAAGGTGCTTATTGTCCTCTGAATGA", "GCT" * 25, "GCT" * 15 + "ATGAAAGGTGCTTATTGTCCTCTGAATGAT"]
QUERIES.append(QUERIES[3][::-1].translate(str.maketrans("ACGT", "TGCA")))
GOLDEN = """query0 subject0 100 25 0 0 1 75 1 25 2.75456e-15 60.4622
query0 subject6 100 10 0 0 46 75 16 25 2.58417e-05 27.335
query1 subject0 100 24 0 0 2 73 1 24 1.36707e-14 58.151
query1 subject6 100 9 0 0 47 73 16 24 0.000128251 25.0238
query3 subject6 100 14 0 0 34 75 12 25 3.60591e-07 33.4982
query3 subject0 100 10 0 0 46 75 16 25 2.58417e-05 27.335
query4 subject6 100 14 0 0 42 1 12 25 3.60591e-07 33.4982
query4 subject0 100 10 0 0 30 1 16 25 2.58417e-05 27.335""".split("\n")


@pytest.fixture(scope="module")
def sources(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("fasta")
    (folder / "db.fa").write_text("junk before\n" + "".join(f">subject{i}\n{s[:10].lower()}\n\n  {s[10:]} \r\n" for i, s in enumerate(SUBJECTS)))
    (folder / "q.fa").write_text("".join(f"> query{i}\n{s}  \n" for i, s in enumerate(QUERIES)))
    subjects = fasta.with_dense_ids(fasta.read_fasta(spark, str(folder / "db.fa")))
    queries = fasta.with_dense_ids(fasta.read_fasta(spark, str(folder / "q.fa"))).withColumnRenamed("seq_id", "query_id")
    return subjects, queries


def test_fasta(sources, spark, tmp_path):
    subjects, queries = sources
    rows = subjects.orderBy("seq_id").collect()
    assert [(r["seq_id"], r["name"], r["seq"]) for r in rows] == [(i, f"subject{i}", s) for i, s in enumerate(SUBJECTS)]
    assert [r["name"] for r in queries.orderBy("query_id").collect()] == [f"query{i}" for i in range(5)]
    (tmp_path / "crlf.fa").write_bytes(b">a b \r\nAC\r\nGT\r\n>\r\n>c\r\n")
    assert [(r["name"], r["seq"]) for r in fasta.read_fasta(spark, str(tmp_path / "crlf.fa")).orderBy("seq_id").collect()] == [("a b ", "ACGT"), ("", ""), ("c", "")]


@pytest.mark.parametrize("clustering", [True, False])
def test_golden_search(sources, clustering):
    db = database.build(sources[0], clustering=clustering)
    lines = fasta.to_tsv_lines(homology.search(db, sources[1], dna=True)).orderBy("query_id", "rank").collect()
    assert [r["value"].replace("\t", " ") for r in lines] == GOLDEN


def test_stored_database_and_caps(sources, spark, tmp_path):
    built = database.build(sources[0])
    database.save(built, str(tmp_path / "db"))
    loaded = database.load(spark, str(tmp_path / "db"))
    assert loaded.settings == built.settings
    assert (built.settings.total_length, built.settings.sequences, built.settings.max_length) == (175, 7, 25)
    found = homology.search(loaded, sources[1], dna=True, options=SearchOptions(results=1, per_subject=3)).collect()
    assert sorted((r["query"], r["subject"]) for r in found) == [("query0", "subject0"), ("query1", "subject0"), ("query3", "subject6"), ("query4", "subject6")]


def test_proteins_with_mutations_and_gaps(spark):
    r = random.Random(7)
    base = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(150)) for _ in range(6)]
    db = database.build(spark.createDataFrame([(i, f"s{i}", s) for i, s in enumerate([*base, "", None])], "seq_id bigint, name string, seq string"))
    mutated = [s[:70] + "WW" + s[70:100] + "".join(r.choice("ACDEF") if r.random() < 0.1 else c for c in s[100:]) for s in base]
    queries = spark.createDataFrame([(i, f"q{i}", s) for i, s in enumerate([*mutated, "", None])], "query_id bigint, name string, seq string")
    found = homology.search(db, queries).where("rank = 1").orderBy("query_id").collect()
    assert [(x["query"], x["subject"]) for x in found] == [(f"q{i}", f"s{i}") for i in range(6)]
    assert all(x["gap_opens"] >= 1 and x["identity"] > 80 and "I" not in x["cigar"] for x in found)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "seq_id bigint, name string, seq string")
    db = database.build(none)
    queries = spark.createDataFrame([(0, "q", "SESEWWAKKPILQNFMKGAYCPLND")], "query_id bigint, name string, seq string")
    assert homology.search(db, queries).count() == 0
    full = database.build(spark.createDataFrame([(0, "s", SUBJECTS[0])], "seq_id bigint, name string, seq string"))
    assert homology.search(full, queries.limit(0)).count() == 0


def candidates(spark, rows):
    return spark.createDataFrame(rows, "query_id bigint, frame int, seq_id bigint, score int, q_start int, q_end int, s_start int, s_end int")


def test_ranking(spark):
    df = candidates(spark, [(1, 0, 1, 50, 0, 9, 0, 9), (1, 0, 1, 50, 0, 19, 0, 19), (1, 0, 2, 60, 0, 9, 0, 9), (1, 0, 3, 50, 0, 19, 0, 19)])
    assert [r["seq_id"] for r in ranking.top_k(ranking.best_per_subject(df), 2).orderBy("rank").collect()] == [2, 1]
    assert ranking.best_per_subject(df).where("seq_id = 1").first()["q_end"] == 19


def test_cap_with_containment(spark):
    df = candidates(spark, [(1, 0, 1, 90, 0, 50, 0, 50), (1, 0, 1, 80, 10, 20, 10, 20), (1, 0, 1, 70, 60, 80, 60, 80), (1, 0, 1, 60, 100, 120, 100, 120)])
    assert sorted(r["score"] for r in ranking.cap_per_subject(df, 2).collect()) == [70, 90]
    a = df.where("score = 90").alias("a")
    b = df.where("score < 90").alias("b")
    assert [r["score"] for r in a.crossJoin(b).where(ranking.contains("a", "b")).select(F.col("b.score").alias("score")).collect()] == [80]


def test_chunks(spark):
    s = spark.createDataFrame([(i, "A" * n) for i, n in enumerate([25, 25, 25, 10])], "seq_id bigint, seq string")
    assert [r["chunk_id"] for r in database.chunks(s, 50).orderBy("seq_id").collect()] == [0, 0, 1, 1]


def test_order_of_several_files(spark, tmp_path):
    r = random.Random(5)
    names = []
    for f in range(6):  # the first file in order of paths is the smallest
        records = [(f"f{f}r{i}", "".join(r.choice("ACDEFGHIKL") for _ in range(40))) for i in range(1 + 300 * f)]
        (tmp_path / f"part{f}.fa").write_text("junk\n" * (f % 2) + "".join(f">{n}\n{s}\n" for n, s in records))
        names += [n for n, _ in records]
    got = fasta.read_fasta(spark, str(tmp_path))
    assert [x["name"] for x in got.orderBy("seq_id").collect()] == names
    dense = fasta.with_dense_ids(got).orderBy("seq_id").collect()
    assert [(x["seq_id"], x["name"]) for x in dense] == list(enumerate(names))


def test_low_complexity_database(spark):
    rows = [(i, f"s{i}", "A" * 400) for i in range(40)] + [(100, "other", SUBJECTS[0] * 3)]
    db = database.build(spark.createDataFrame(rows, "seq_id bigint, name string, seq string"))
    queries = spark.createDataFrame([(0, "q", SUBJECTS[0] * 2), (1, "poly", "A" * 60)], "query_id bigint, name string, seq string")
    assert {x["subject"] for x in homology.search(db, queries).collect()} == {"other"}
    unmasked = homology.search(db, queries, options=SearchOptions(mask=False, results=50)).where("query_id = 1").collect()
    assert len(unmasked) == 40 and {x["length"] for x in unmasked} == {60}


def test_hot_subjects_and_blocks_of_queries_change_nothing(spark, monkeypatch):
    from seqloom.operators import search

    r = random.Random(9)
    base = ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(200)) for _ in range(5)]
    db = database.build(spark.createDataFrame([(i, f"s{i}", s + base[0]) for i, s in enumerate(base)], "seq_id bigint, name string, seq string"))
    queries = spark.createDataFrame([(i, f"q{i}", s[20:150]) for i, s in enumerate(base)], "query_id bigint, name string, seq string")
    want = sorted(map(tuple, homology.search(db, queries).collect()))
    monkeypatch.setattr(search, "SUBJECT_HITS", 50)
    monkeypatch.setattr(search, "FRAME_BYTES", 300)
    monkeypatch.setattr(search, "BLOCK_HITS", 40)
    assert sorted(map(tuple, homology.search(db, queries).collect())) == want and len(want) >= 9
