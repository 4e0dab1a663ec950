"""The pipeline's stages keep what they should, at the smallest scale of the given tables."""

import os

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash", "pii", "mixing", "sentencepiece"]
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "sentencepiece":
            assert out.columns == docs.columns
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert ids <= seen and len(ids) >= 0.6 * len(seen)
        docs, seen = out, ids
    assert docs.where("not round_trip").count() == 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()
