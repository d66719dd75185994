"""Application sessions from raw form events: state per field, then one feature row.

A filled field cannot be skipped and a skipped one cannot be filled until it is
cleared, so a field's state is its first fill or skip after its last clear. That
is two aggregations, with no replay of a session in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EVENT_SCHEMA = "session_id string, ts timestamp, action string, field string, is_mobile boolean"


def _order() -> Column:
    return F.struct("ts", "seq")


#: Acts of one field of a session that a task takes at most; only a field with more is spread by salts.
ACTS = 100_000


def field_states(events: DataFrame, acts_at_once: int = ACTS) -> DataFrame:
    """(session_id, field, status) for fields touched; ``seq`` orders equal times."""
    typed = events.filter(F.col("field").isNotNull() & F.col("action").isin("fill", "skip", "clear"))
    keys = ["session_id", "field"]
    is_clear = F.col("action") == "clear"
    known = typed.groupBy(*keys).agg(F.max(F.when(is_clear, _order())).alias("cleared_at"), F.count_if(~is_clear).alias("n"))
    # One session may hold a third of the events: salts spread its rows. Such fields are few, a row for each 100,000 acts at most.
    salts = F.ceil(F.col("n") / acts_at_once).cast("int")
    crowded = known.filter(F.col("cleared_at").isNotNull() & (F.col("n") > acts_at_once)).select(*keys, salts.alias("salts"))
    cleared = known.filter(F.col("cleared_at").isNotNull() & (F.col("n") > 0)).select(
        *keys, "cleared_at", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    acts = typed.filter(~is_clear).join(F.broadcast(crowded), keys, "left").withColumn(
        "salt", F.coalesce(F.pmod(F.xxhash64("seq"), F.col("salts")).cast("int"), F.lit(0))).drop("salts", "is_mobile")
    open_acts = acts.join(cleared, [*keys, "salt"], "left").filter(
        F.col("cleared_at").isNull() | (_order() > F.col("cleared_at"))
    )
    first = F.min_by("action", _order())
    return open_acts.groupBy(*keys).agg(
        F.when(first == "fill", "filled").otherwise("skipped").alias("status")
    )


def session_features(events: DataFrame, n_required: int) -> DataFrame:
    """The session features of every session, as of its last event."""
    states = field_states(events).groupBy("session_id").agg(
        F.count_if(F.col("status") == "filled").alias("session_n_fields_completed"),
        F.count_if(F.col("status") == "skipped").alias("session_n_fields_skipped"),
    )
    started = F.min(F.when(F.col("action").isin("fill", "skip"), F.col("ts")))
    last = F.max("ts")
    device = F.max_by("is_mobile", F.when(F.col("action") == "device", _order()))
    whole = events.groupBy("session_id").agg(
        F.coalesce(F.unix_timestamp(last) - F.unix_timestamp(started), F.lit(0)).cast("int").alias("session_time_on_page_secs"),
        F.hour(last).alias("session_hour_of_day"),
        (F.weekday(last) >= 5).alias("session_is_weekend"),
        F.coalesce(device, F.lit(False)).alias("session_device_mobile"),
        F.count_if(F.col("action") == "back").cast("int").alias("session_navigation_back_count"),
    )
    filled = whole.join(states, "session_id", "left")
    counts = ["session_n_fields_completed", "session_n_fields_skipped"]
    return filled.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in counts}
    ).withColumns({
        "session_field_completion_rate": F.col("session_n_fields_completed") / n_required,
        "job_n_required_fields": F.lit(n_required),
    })


def abandonment_labels(events: DataFrame, days: int = 7) -> DataFrame:
    """1 where an application was started and not submitted within the days after.

    Sessions that only looked around are left out.
    """
    begun = F.min(F.when(F.col("action").isin("fill", "skip"), F.col("ts")))
    starts = events.groupBy("session_id").agg(begun.alias("started_at")).filter(F.col("started_at").isNotNull())
    window_end = F.col("started_at") + F.make_dt_interval(days=F.lit(days))
    # Submits are few next to the other events; any one inside the window counts.
    submits = events.filter(F.col("action") == "submit").select("session_id", "ts").distinct()
    inside = (
        submits.join(starts, "session_id")
        .filter((F.col("ts") >= F.col("started_at")) & (F.col("ts") <= window_end))
        .groupBy("session_id").agg(F.min("ts").alias("submitted_at"))
    )
    return starts.join(inside, "session_id", "left").withColumn(
        "label", F.col("submitted_at").isNull().cast("int")
    )
