import corpus_pipeline
from starlode.llm import queries


def test_stages_keep_columns_and_odd_rows(spark, tmp_path, odd_docs, no_docs):
    spark.createDataFrame([(5, 0, 0), (3, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == odd_docs.columns
                docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert len(corpus_pipeline.STAGES) == 4


def test_every_operator_is_registered():
    assert [sum(q.startswith(f"op{n}_") for q in queries.QUERIES) for n in range(1, 11)] == [1] * 10
