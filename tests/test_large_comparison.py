"""What the retriever comparison sends round."""

from matchloom.plans import retrieval, tables


def test_texts_are_matched_once_and_prototypes_are_sent_to_the_vectors(spark):
    folder = "/root/testdata/sf0.001"
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        embeddings, texts, chosen, asks = retrieval._example_side(spark, folder)
        for df in (texts, asks, tables.prototypes(embeddings), retrieval.label_qrels(spark, folder, chosen).select("query_id")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert plan.count("SortMergeJoin") <= (2 if df.columns == ["query_id"] else 0)  # the languages of all vectors, for both sides
        found = {r["resume_id"] for r in texts.collect()}
        documents = {r["doc_id"] for r in tables.table(spark, folder, "documents").select("doc_id").collect()}
        assert found == documents & {r["vec_id"] for r in embeddings.select("vec_id").collect()}
        assert {r["job_id"] for r in asks.collect()} == documents & {r["vec_id"] for r in chosen.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
