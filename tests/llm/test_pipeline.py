"""The pipeline's stages on the smallest tables: each decision against plain Python."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name in ("toxicity", "near_copies"):
            assert out.join(docs, "doc_id", "left_anti").count() == 0 and out.count() <= docs.count()
        if name == "near_copies":
            texts = [r.text for r in out.collect()]
            assert len(texts) == len(set(texts))
        if name == "pii":
            assert out.count() == docs.count() and out.filter("text like '%@%.example.com%'").count() == 0
        docs = out
    assert docs.filter("not round_trip").count() == 0


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
