"""Words that a bound leaves out of the sampling change no fingerprint, and a reach that is too short is noticed."""

import random

from matchloom.llm.fingerprints import fingerprint_documents, fingerprint_pairs


def test_words_beyond_the_reach_change_no_sample(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(500)]
    texts = [" ".join(rng.choices(words, weights=range(500, 0, -1), k=rng.choice((1, 3, 30, 400, 3000)))) for _ in range(40)]
    rows = list(enumerate([*texts, "", None, " \n ", " one one ", "in " * 300]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda df: sorted(tuple(r) for r in df.drop("sure").collect())
    full, near, short = (fingerprint_pairs(docs, reach=reach) for reach in (float("inf"), 28.0, 0.2))
    assert told(near) == told(full) and near.filter("sure").count() == len(rows)
    assert short.count() == len(rows) and short.filter("not sure").count() > 10
    assert told(fingerprint_documents(docs, reach=0.2)) == told(fingerprint_documents(docs))


def test_word_codes_are_made_once(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    plan = fingerprint_pairs(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(split(") == 2
