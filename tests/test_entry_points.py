"""Command line, stream of queries, and the driver contract."""

from pathlib import Path

from seqloom import cli
from seqloom.sources import database
from seqloom.streaming import batches

from test_search import GOLDEN, QUERIES, SUBJECTS


def test_command_line(spark, tmp_path):
    (tmp_path / "db.fa").write_text("".join(f">subject{i}\n{s}\n" for i, s in enumerate(SUBJECTS)))
    (tmp_path / "q.fa").write_text("".join(f">query{i}\n{s}\n" for i, s in enumerate(QUERIES)))
    cli.main(["db", "-i", str(tmp_path / "db.fa"), "-o", str(tmp_path / "db")])
    cli.main(["aln", "-d", str(tmp_path / "db"), "-i", str(tmp_path / "q.fa"), "-q", "d", "-o", str(tmp_path / "out")])
    lines = [x for p in sorted(Path(tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x.replace("\t", " ") for x in lines] == GOLDEN


def test_stream(spark, tmp_path):
    rows = [(i, f"subject{i}", s) for i, s in enumerate(SUBJECTS)]
    database.save(database.build(spark.createDataFrame(rows, "seq_id bigint, name string, seq string")), str(tmp_path / "db"))
    for i, s in enumerate(QUERIES[:2]):
        spark.createDataFrame([(i, f"query{i}", s)], batches.SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = batches.search_stream(batches.read_queries(spark, str(tmp_path / "in")), str(tmp_path / "db"), str(tmp_path / "out"), str(tmp_path / "state"), dna=True)
    stream.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r["query"], r["subject"]) for r in found.collect()) == [tuple(x.split()[:2]) for x in GOLDEN[:4]]
    assert found.select("batch").distinct().count() == 2


def test_contract():
    import __spark_entry__ as entry

    assert {"homology_search", "seed_join", "seg_mask"} <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
