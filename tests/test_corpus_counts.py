"""Document frequencies make the tokens of a text once."""

from matchloom.operators import channels as ch


def test_tokens_are_made_once_and_empty_texts_have_none(spark):
    rows = [(1, "Spark and spark, SQL"), (2, ""), (3, None), (4, "1 2 3"), (5, "sql sql java")]
    corpus = ch.tokenised(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    found = ch.document_frequencies(corpus)
    assert {tuple(r) for r in found.collect()} == {("spark", 1), ("and", 1), ("sql", 2), ("java", 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
