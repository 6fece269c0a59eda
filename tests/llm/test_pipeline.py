import corpus_pipeline


def test_pipeline(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {r[0] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.stored(stage(spark, docs, d), name)
        assert docs.columns == columns
        left = {r[0] for r in docs.select("doc_id").collect()}
        assert left <= ids
        ids = left
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r[0] for r in packed.select("doc_id").collect()} == ids
