import os

import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_each_stage_keeps_the_schema_and_works_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        if name == "shard":
            assert set(columns) < set(docs.columns)
        else:
            assert docs.columns == columns
        if name in ("quality", "near-duplicates", "decontaminate"):
            assert 0.5 * n < docs.count() <= n
            assert docs.select("doc_id").distinct().count() == docs.count()
    shards = docs.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in shards)
