"""Field states of sessions: nothing grows with the number of tasks, and a crowded field is spread."""

import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import sessions as se


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = []
    for seq in range(3000):
        session = 1 if rng.random() < 0.4 else rng.randrange(2, 40)
        rows.append((session, rng.randrange(900), seq, rng.choice(["fill", "skip", "fill", "clear", "back"]), rng.choice(["name", "mail"])))
    rows.append((77, 1, 9001, "clear", "name"))
    rows.append((78, 1, 9002, "fill", "name"))
    columns = ["session_id", F.timestamp_seconds("t").alias("ts"), "seq", "action", F.when(F.col("action") != "back", F.col("field")).alias("field"), F.lit(None).cast("boolean").alias("is_mobile")]
    return rows, spark.createDataFrame(rows, "session_id long, t long, seq long, action string, field string").select(*columns)


def replayed(rows):
    state = {}
    for session, _, _, action, field in sorted(rows, key=lambda r: (r[1], r[2])):
        if action == "clear":
            state.pop((session, field), None)
        elif action in ("fill", "skip"):
            state.setdefault((session, field), "filled" if action == "fill" else "skipped")
    return state


@pytest.mark.parametrize("at_once", [100_000, 50, 1])
def test_states_equal_a_replay_however_crowded_fields_are_spread(events, at_once):
    rows, df = events
    assert {(r[0], r[1]): r[2] for r in se.field_states(df, at_once).collect()} == replayed(rows)


def test_a_state_is_not_copied_for_each_task(events, spark):
    _, df = events
    sizes = {}
    for parts in ("4", "400"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        plan = se.field_states(df)._jdf.queryExecution().toString()
        sizes[parts] = plan.count("sequence(0, 399") + plan.count("sequence(0, 3,")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes == {"4": 0, "400": 0}
