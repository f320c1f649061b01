"""The corpus pipeline, stage by stage."""

from __future__ import annotations

import corpus_pipeline
from quarrylog.llm.mixing import word_count
from pyspark.sql import functions as F


def test_stages(spark, make, odd_rows):
    docs = make(odd_rows)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "mixing sources to target weights", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, "")
        if k < 3:
            assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), docs.schema)
            assert docs.count() > 0
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert all(f(spark, make([]).limit(0), "").count() == 0 for _, f in corpus_pipeline.STAGES)


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    rows = corpus_pipeline.run(spark, sf).collect()
    ids = {r.doc_id for r in rows}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    total = docs.select(F.sum(word_count(F.col("text")))).first()[0]
    assert ids <= {r.doc_id for r in docs.collect()} and sum(r.length for r in rows) > total
