"""The pipeline's stages one by one against their operators' decisions, and run() against the stages."""

import os

import pytest

import corpus_pipeline

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    counts = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts[name] = docs.count()
        if name != "pack":
            assert docs.columns == columns
        if name == "exact":
            texts = ["".join(r["text"].split()) for r in docs.select("text").collect()]
            assert len(texts) == len(set(texts))
    assert 0 < counts["near"] <= counts["exact"] <= counts["quality"] <= before
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    again = corpus_pipeline.run(spark, DIR)
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, docs.select(key).collect()))
    places = {}
    for r in again.collect():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= 1024
