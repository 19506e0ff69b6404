import cases
import corpus_pipeline as P


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        docs = after
    assert P.run(spark, data).count() > 0


def test_cases_pass_every_stage(spark, data):
    docs = cases.documents(spark)
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, data)
        assert after.columns == docs.columns and after.count() > 0, name
        none = stage(spark, docs.limit(0), data)
        assert none.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, data).count() > 0


def test_clean_documents_stay(spark, data):
    """Of the labelled clean documents that stand alone, the filters keep all that the base rules pass."""
    from tidemark.llm import quality, simhash

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = spark.read.parquet(f"{data}/labels.parquet").where("quality = 1").select("doc_id")
    base = quality.judge(docs, quality.fit(docs, clean.selectExpr("doc_id", "1 AS quality", "0 AS toxic")))
    due = {r.doc_id for r in base.where("NOT base_failed").join(clean, "doc_id").collect()}
    first = {r.doc_id for r in simhash.near_duplicates(docs).where("doc_id = component_id").collect()}
    stay = P.one_of_each_group(spark, P.good_documents(spark, docs, data), data)
    assert due & first <= {r.doc_id for r in stay.collect()}
