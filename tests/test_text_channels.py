"""Tokens, counts and scores of texts that are cut in numpy equal those cut by the pattern; the pairs run each channel once."""

import random
import re

from pyspark.sql import functions as F

from matchloom.functions import vocab as V
from matchloom.functions.tokens import BYTES, token_parts
from matchloom.operators import channels as ch
from matchloom.plans import modelling


def some_texts(n):
    rng = random.Random(8)
    parts = ["Data", "c++", "3d", "-x", ".net", "9", "é", "K", "İz", "A", " ", "\n", "#", "ab-", "日本", "z.Z"]
    return [None, ""] + ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["a b " * (BYTES // 4 + 1)]


def test_tokens_are_those_of_the_pattern():
    texts = some_texts(3000)
    found = [[] for _ in texts]
    for rows, tokens, row in token_parts(texts):
        for token, place in zip(tokens.to_pylist(), row.tolist(), strict=True):
            found[rows.start + place].append(token)
    assert found == [[t.lower() for t in re.findall(V.TOKEN_PATTERN, text or "")] for text in texts]


def test_counts_take_one_pass_and_equal_those_of_the_token_lists(spark):
    texts = some_texts(500)
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    plain = ch.tokenised(rows, "id", "text")
    counts = {r["tok"]: (r["df"], r["size"]) for r in ch.text_counts(rows.select("text")).collect()}
    assert counts.pop(None) == (len(texts), plain.agg(F.sum(F.size("toks"))).first()[0])
    assert {t: n for t, (n, _) in counts.items()} == {r["tok"]: r["df"] for r in ch.document_frequencies(plain).collect()}


def test_texts_score_as_their_vectors_do(spark):
    rows = spark.createDataFrame(list(enumerate(some_texts(300))), "id long, text string")
    asks = rows.filter("id between 5 and 9").select(F.col("id").alias("job"), "text")
    apart = ch.dense_topk(ch.encode(rows, "text", keep_text=False), ch.encode(asks, "text", keep_text=False), 7)
    for limit in (None, 2):
        assert sorted(ch.text_dense_topk(rows, asks, 7, max_query_rows=limit).collect()) == sorted(apart.collect())


def test_pairs_run_each_channel_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def counted(df):
        def go(batches):
            runs.add(1)
            yield from batches
        return df.coalesce(1).mapInArrow(go, df.schema)

    dense = modelling.dense_channel
    monkeypatch.setattr(modelling, "dense_channel", lambda *args: counted(dense(*args)))
    modelling.labelled_pairs(spark, "/root/testdata/sf0.001").count()
    assert runs.value == 1
