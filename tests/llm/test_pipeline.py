import corpus_pipeline


def test_stages_feed_each_other(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "pii", "best-fit packing"]
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        docs = step(spark, docs, d)
        if k < 4:
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            assert docs.columns == columns and 0 < docs.count() <= seen
            seen = docs.count()
    ids = {r["doc_id"] for r in docs.collect()}
    assert len(ids) == seen
