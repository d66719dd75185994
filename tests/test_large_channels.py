"""Channels hold some texts and scores at once, however long a batch is."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.operators import block_topk as bt, channels as ch


def test_texts_are_encoded_some_at_a_time_and_not_sent_back(spark):
    class Watched(ch.TokenHashEncoder):
        KNOWN = 50

        def __call__(self, texts):
            assert len(texts) <= 512 and len(self.slots) < 80
            return super().__call__(texts)

    rows = spark.range(0, 2000, 1, 1).select("id", F.concat(F.lit("word"), F.col("id") % 97, F.lit(" other")).alias("text"))
    got = ch.encode(rows, "text", Watched(), keep_text=False)
    assert got.columns == ["id", "vector"]
    plain = ch.TokenHashEncoder()
    raw = plain([r["text"] for r in rows.orderBy("id").collect()])
    due = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))
    assert np.array_equal(np.array([r["vector"] for r in got.orderBy("id").collect()], dtype=np.float32), due.astype(np.float32))


def test_long_lists_are_scored_in_smaller_parts():
    sizes = []

    def score(_, part):
        sizes.append(part.num_rows)
        return np.arange(part.num_rows, dtype=float)[:, None]

    table = pa.table({"id": pa.array(range(4000)), "toks": pa.array([["a"] * 500] * 4000)})
    best = bt._Best(1, 3)
    bt._feed(best, None, score, table, 1)
    assert sum(sizes) == 4000 and max(sizes) * 500 <= 500_000
