"""The corpus pipeline: each stage on its own input, odd rows, planted documents."""

import random

import pytest

import corpus_pipeline
from conftest_helpers import prose


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path, r = str(tmp_path_factory.mktemp("sf")), random.Random(8)
    rows, labels = [], []
    for i in range(400):
        text = "\n".join(prose(1000 * i + k, 25) for k in range(4))
        toxic = i % 8 == 0
        if toxic:
            text = text.replace(" ", " vilebrute ", 1) + " scorndog" + r.choice(["a", "o"])
        rows.append((i, text))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    passage = "\n".join(prose(7_000_000 + k, 30) for k in range(2))
    near = rows[11][1].split(" ")
    near[10] = "altered"
    rows += [(1000, rows[11][1]), (1001, " ".join(near)), (1002, rows[13][1] + "\n" + passage), (1003, rows[15][1].replace("a", "e") + "\n" + passage), (1004, "12345 !!"), (1005, None), (1006, ""), (None, prose(5_000_000, 80))]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids, texts = docs.columns, {}, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
            rows = docs.collect()
            ids[name] = {r["doc_id"] for r in rows}
            texts[name] = {r["doc_id"]: r["text"] for r in rows}
            assert name not in ("line_dedup", "simhash") or all(r["n_chars"] == len(r["text"]) for r in rows)
    toxic = {i for i in range(400) if i % 8 == 0}
    assert not ids["toxicity"] & toxic and {i for i in range(400) if i % 8} <= ids["toxicity"]
    assert ids["toxicity"] - ids["language_id"] == {1004, 1005, 1006}
    assert 1000 not in ids["line_dedup"]  # an exact copy: no line is left
    kept = texts["line_dedup"]
    assert prose(7_000_000, 30) in kept[1002] and 1003 in kept and prose(7_000_000, 30) not in kept[1003]
    assert {i for i in range(400) if i % 8} <= ids["simhash"]
    packed = docs.collect()
    assert {r["doc_id"] for r in packed} == ids["simhash"]
    assert max(r["offset"] + r["length"] for r in packed) <= 2048


def test_near_copies_leave_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (11, 12, 1000, 1001)")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, sf_dir).collect()) == [11, 12]


def test_run_and_registration(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in entry.queries() if k.startswith("op")}
    assert corpus_pipeline.run(spark, sf_dir).count() > 300


def test_stages_on_empty_and_odd_tables(spark, sf_dir, odd_docs, no_docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
        stage(spark, odd_docs, sf_dir).collect()


def test_a_worker_remembers_one_operator_at_a_time(spark, odd_docs, monkeypatch):
    """Memories of words add up beside the executor's heap: a later stage's task empties those of the stages before it."""
    import public_tokenizers
    import pyarrow as pa

    from seqloom.llm import packing, simhash, toxicity, workers

    tasks = []
    monkeypatch.setattr(type(odd_docs), "mapInArrow", lambda self, run, schema: tasks.append(run) or self)
    simhash.fingerprints(odd_docs)
    workers.map_batches(odd_docs, lambda batches: batches, odd_docs.schema, "byte_encoders")
    marked, packed = tasks
    packing.byte_encoder(public_tokenizers.path("byte_bpe_50k.json")).raw([prose(1, 100)])
    toxicity._words["drop", 0] = {"word": (1,)}
    list(packed(iter([])))
    assert packing._encoders and not toxicity._words  # its own stays
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": pa.array(["some text", None]), "mark": pa.array([b"a", b"b"])})
    (out,) = marked(iter([batch]))
    assert out.num_rows == 2 and not packing._encoders


def test_small_tables_need_no_python_worker(spark):
    from seqloom import runtime

    rows = [(1, "a", None), (-(1 << 63), "é\0", 2), (None, None, 3)]
    made = runtime.small_table(spark, rows, "i bigint, s string, n int")
    assert sorted(map(tuple, made.collect()), key=str) == sorted(rows, key=str) and made.dtypes == [("i", "bigint"), ("s", "string"), ("n", "int")]
    assert "LocalRelation" in made._jdf.queryExecution().optimizedPlan().toString()
    assert runtime.small_table(spark, [], "i bigint").collect() == []
