"""The pipeline's stages, each written and read again as the driver does, on a small table with hard rows."""

import pytest

import corpus_pipeline
from spindrift.llm import neardup, secrets

DDL = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    text = docs.where("doc_id = 3").first().text
    hard = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "12 34", "en", None, 5), (9003, text, None, "s", None), (9004, text + "\nsecret = abcdef123456", "en", "s", 1), (None, text, "en", "s", 1), (3, text, "en", "s", 1), (9005, "the and of " * 20_000, "en", "s", 1)]
    docs.unionByName(spark.createDataFrame(hard, DDL)).write.parquet(f"{base}/documents.parquet")
    return base


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before, kept = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept[name] = docs.collect()
    assert len(kept["language"]) == before - 3
    ids = [r.doc_id for r in kept["near_dedup"]]
    by = {r.doc_id: r for r in neardup.groups(spark.read.parquet(f"{folder}/language")).collect() if r.doc_id is not None}
    assert sorted(i for i in ids if i is not None) == sorted(i for i, r in by.items() if r.component_id == i)
    assert ids.count(None) == 1 and 9003 not in ids and 9004 not in ids
    assert len(kept["secrets"]) == len(ids)
    assert all(not secrets.base_spans(r.text) for r in kept["secrets"])
    assert {r.doc_id for r in kept["packing"]} == set(ids)
    run = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, docs.drop("sequence_id", "offset").collect()))


def test_empty(spark, tmp_path):
    docs = spark.createDataFrame([], DDL)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0
