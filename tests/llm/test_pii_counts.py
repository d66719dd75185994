"""Thresholds of personal data come from all candidates, counted by steps of their score."""

from matchloom.llm.pii import SCORE_STEPS, score_counts, thresholds
from pyspark.sql import functions as F


def test_every_candidate_is_counted_and_junk_beyond_any_sample_lifts_the_threshold(spark):
    def counted(junk_high):
        n = 40_000
        rows = spark.range(n).select(F.lit("phone").alias("kind"), F.lit(1.0).alias("label"), (0.6 + F.col("id") % 1000 / 2600).alias("p"))
        junk = spark.range(n).select(F.lit("phone").alias("kind"), F.lit(0.0).alias("label"), F.when(F.col("id") < junk_high, 0.7).otherwise(0.01).alias("p"))
        loose = spark.range(n).select(F.lit("phone").alias("kind"), F.lit(None).cast("double").alias("label"), F.when(F.col("id") % 2 == 0, 0.95).otherwise(0.02).alias("p"))
        return score_counts(rows.union(junk).union(loose)).toPandas()

    clean, dirty = counted(0), counted(2_000)
    assert dirty["n"].sum() == 120_000 and len(dirty) <= 3 * (SCORE_STEPS + 1)
    assert thresholds(clean, 0.995)["phone"] <= 0.6 and thresholds(dirty, 0.995)["phone"] > 0.7
