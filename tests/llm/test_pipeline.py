"""The corpus pipeline on small rows, against what each stage should do."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxspark.llm import op05_bpe

EN = "the cat and the dog of the house with that who was not in there for a long time and then it came back to the river and the hill behind the old mill where nobody had been since the war"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pipeline"))
    rows = [(i, f"{EN} number {i} " + " ".join(f"word{(i * 37 + k * 101) % 997}" for k in range(120)), "en", "s", 9) for i in range(40)]
    rows += [(50, rows[3][1], "en", "s", 9), (51, rows[4][1] + " end", "en", "s", 9), (52, "$$$ 123", "en", "s", 7), (53, None, None, None, None)]
    rows += [(54, "something else " + " ".join(f"test{k}" for k in range(12)) + " tail " * 5, "en", "s", 9), (55, "call 415-555-1234 or mail jo.doe@corp.example about the house and the old river mill", "en", "s", 84)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([("b", " ".join(f"test{k}" for k in range(12)))], "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "tokens":
            assert docs.columns == columns
        if name == "pseudonyms":
            r = docs.where("doc_id = 55").first()
            assert "415-555-1234" not in r.text and "jo.doe" not in r.text and r.n_chars == len(r.text)
            texts = {r.doc_id: r.text for r in docs.collect()}
    assert ids["language"] == set(range(40)) | {50, 51, 54, 55}
    assert ids["near_copies"] == set(range(40)) | {54, 55}
    assert ids["benchmarks"] == ids["pseudonyms"] == ids["tokens"] == set(range(40)) | {55}
    coder = op05_bpe.encoder(open(op05_bpe.default_path(), encoding="utf-8").read())
    for r in docs.collect():
        assert r.ids == np.frombuffer(coder.encode(texts[r.doc_id]), "<i4").tolist() and r.n_tokens == len(r.ids)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == 41
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()} == set(range(40)) | {55}


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
