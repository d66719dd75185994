"""Exact calibration, labels of a stream, and small reports against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import vocab as V
from matchloom.functions.trajectory import with_criteria, with_trajectory
from matchloom.operators.calibration import isotonic_blocks
from matchloom.operators.sessions import abandonment_labels
from matchloom.plans import reading, retrieval, tables as t
from matchloom.streaming import live

SMALL = "/root/testdata/sf0.001"


def brute_isotonic(rows):
    """Mean label of each score under the best rising curve."""
    sums = {}
    for p, y in rows:
        a, n = sums.get(p, (0, 0))
        sums[p] = (a + y, n + 1)
    blocks = []
    for p in sorted(sums):
        blocks.append([[p], *sums[p]])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            points, total, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + points, blocks[-1][1] + total, blocks[-1][2] + n]
    return {p: total / n for points, total, n in blocks for p in points}


@pytest.mark.parametrize("kind", ["noise", "falling", "ties", "one"])
def test_blocks_equal_a_whole_isotonic_fit(spark, kind):
    rng = random.Random(kind)
    size = {"one": 1}.get(kind, 10_000)
    p = [{"noise": rng.random(), "falling": rng.random(), "ties": rng.randrange(30) / 30, "one": 0.3}[kind] for _ in range(size)]
    rows = [(x, int(rng.random() < (1 - x if kind == "falling" else x))) for x in p]
    df = spark.createDataFrame([*rows, (None, 1), (0.5, None)], "p double, y int").repartition(3)
    got = isotonic_blocks(df, "p", "y", ranges=9).collect()
    want = brute_isotonic(rows)
    for low, high, total, n in got:
        assert all(v == pytest.approx(total / n, abs=1e-12) for x, v in want.items() if low <= x <= high)
    assert sum(n for *_, n in got) == size and len(got) == len({round(v, 12) for v in want.values()})


def test_no_rows_give_no_blocks(spark):
    assert isotonic_blocks(spark.createDataFrame([], "p double, y int"), "p", "y").count() == 0


@pytest.mark.parametrize("within", [1, 7])
def test_closed_label_stream_equals_the_batch(spark, tmp_path, within):
    events = t.form_events(spark, SMALL).filter("ts is not null").select("session_id", "ts", "seq", "action", "field", "is_mobile")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    share = F.floor((F.unix_micros("ts") - F.lit(int(first.timestamp() * 1e6))) / F.lit(max(1.0, (last - first).total_seconds() * 1e6 / 4))).cast("int")
    for n in range(5):
        events.filter(share == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for days in (30, 60):  # what comes later moves the watermark past all timers
        late = events.limit(1).select(F.lit(-1).cast("long").alias("session_id"), F.timestamp_micros(F.lit(int(last.timestamp() * 1e6) + days * 86_400_000_000)).alias("ts"), "seq", F.lit("submit").alias("action"), "field", "is_mobile")
        late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = live.abandonment_stream(stream, within).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    columns = ["session_id", "label", "started_at", "submitted_at"]
    got = spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()
    want = abandonment_labels(events, within).select(*columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)
    assert within > 1 or {r.label for r in want} == {0, 1}


def test_career_reports_equal_the_profiles(spark):
    rows = with_trajectory(t.resumes(spark, SMALL)).select("resume_id", "years_experience", "company_tier").collect()
    years = sorted(r.years_experience for r in rows if r.years_experience is not None)
    assert tuple(reading.years_spread(spark, SMALL).first()) == (len(years), *((years[0], years[len(years) // 2], years[-1]) if years else (None,) * 3))
    high = {r.resume_id for r in rows if r.years_experience is not None and r.years_experience >= 8 and r.company_tier == 1}
    assert {r.resume_id for r in reading.high_careers(spark, SMALL).collect()} == high


def test_postings_go_by_skills_and_one_is_the_case_study(spark):
    listed = [tuple(r) for r in reading.postings_by_skills(spark, SMALL).collect()]
    assert listed == sorted(listed, key=lambda r: (-r[1], r[0])) and len(listed) == t.jobs(spark, SMALL).count()
    _, _, chosen, asks = retrieval._example_side(spark, SMALL)
    labels = {}
    for r in retrieval.label_qrels(spark, SMALL, chosen).collect():
        labels[r.query_id] = labels.get(r.query_id, 0) + 1
    jobs = sorted((r.job_id, r.target_seniority, labels.get(r.job_id, 0)) for r in with_criteria(asks).collect())
    fit = [j for j in jobs if j[1] >= V.SENIOR and j[2] >= 5]
    assert tuple(reading.case_study_posting(spark, SMALL).first()) == (*(fit or jobs)[0], bool(fit))
