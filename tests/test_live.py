"""The closed stream equals the batch query."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import decisions as dc, vocab as V
from matchloom.operators.sessions import session_features
from matchloom.plans import tables as t
from matchloom.streaming import live

SMALL = "/root/testdata/sf0.001"
FIELDS = len(V.FORM_FIELDS)


def scorer(df):
    fixed = {"skill_gap": F.lit(0.5), "yoe_gap": F.lit(0.0), "job_posting_age_days": F.lit(3), "job_has_remote_option": F.lit(False)}
    return df.withColumns(fixed).withColumn("p", dc.sigmoid(dc.dropoff_logit()))


def test_last_snapshots_equal_the_batch_features(spark, tmp_path):
    events = t.form_events(spark, SMALL).filter("ts is not null")
    cuts = events.select(F.unix_micros("ts").alias("us")).approxQuantile("us", [0.3, 0.7], 0.0)
    third = F.when(F.unix_micros("ts") < cuts[0], 0).when(F.unix_micros("ts") < cuts[1], 1).otherwise(2)
    for n in range(3):
        events.filter(third == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.watch(stream, FIELDS, scorer, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(120) and query.exception() is None
    history = spark.read.parquet(str(tmp_path / "out"))
    assert history.count() == events.count() and history.select("batch").distinct().count() >= 3
    last = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("seq"))
    got = history.withColumn("n", F.row_number().over(last)).filter("n = 1").select("session_id", "elapsed", F.round("p", 9).alias("p"))
    due = scorer(session_features(events, FIELDS)).select("session_id", F.col("session_time_on_page_secs").alias("elapsed"), F.round("p", 9).alias("p"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, due.collect()))
