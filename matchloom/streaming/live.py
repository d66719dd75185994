"""Live application sessions: keyed state of a form, a feature snapshot for each event, and a new score for each snapshot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from matchloom.functions import decisions as dc

HOUR_MS = 3_600_000
OPEN, FILLED, SKIPPED = "", "filled", "skipped"
_STATE = "started long, back int, mobile boolean, fields array<string>, statuses array<string>, last long"
_SNAPSHOT = "session_id long, seq long, us long, started long, n_filled int, n_skipped int, back int, mobile boolean"


def _advance(known: dict, event) -> None:
    """A filled field is not skipped, nor a skipped one filled, until it is cleared. The clock starts with the first of either."""
    if event.action in ("fill", "skip"):
        if known["started"] is None:
            known["started"] = int(event.us)
        if known["status"].get(event.field, OPEN) == OPEN:
            known["status"][event.field] = FILLED if event.action == "fill" else SKIPPED
    elif event.action == "clear":
        known["status"][event.field] = OPEN
    elif event.action == "back":
        known["back"] += 1
    elif event.action == "device":
        known["mobile"] = bool(event.is_mobile)


def snapshots(events: DataFrame, n_required: int, late: str = "1 hour", idle_days: int = 7) -> DataFrame:
    """One row of session features for each event, as of that event.

    ``events`` is a stream of (session_id, ts, seq, action, field, is_mobile). Events of a session are taken by time within a
    micro-batch and as they come from one to the next. The state of a session goes ``idle_days`` after its last event, by
    event time, so the store holds open sessions only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = {"started": None, "back": 0, "mobile": False, "status": {}, "last": 0}
        if state.exists:
            started, back, mobile, fields, statuses, last = state.get
            known = {"started": started, "back": back, "mobile": mobile, "status": dict(zip(fields, statuses)), "last": last}
        out = []
        for event in pd.concat(list(batches)).sort_values(["us", "seq"], kind="stable").itertuples():
            _advance(known, event)
            known["last"] = max(known["last"], int(event.us))
            values = list(known["status"].values())
            out.append((key[0], event.seq, event.us, known["started"], values.count(FILLED), values.count(SKIPPED), known["back"], known["mobile"]))
        state.update((known["started"], known["back"], known["mobile"], list(known["status"]), list(known["status"].values()), known["last"]))
        state.setTimeoutTimestamp(max(known["last"] // 1000 + idle_days * 24 * HOUR_MS, state.getCurrentWatermarkMs() + 1))
        rows = pd.DataFrame(out, columns=["session_id", "seq", "us", "started", "n_filled", "n_skipped", "back", "mobile"])
        rows["started"] = rows["started"].astype("Int64")
        yield rows

    typed = events.withWatermark("ts", late).select(
        F.col("session_id").cast("long").alias("session_id"), "ts", F.unix_micros("ts").alias("us"), "seq", "action", "field", "is_mobile")
    found = typed.groupBy("session_id").applyInPandasWithState(step, _SNAPSHOT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    ts = F.timestamp_micros("us")
    elapsed = F.floor(F.col("us") / 1_000_000) - F.floor(F.col("started") / 1_000_000)
    return found.select(
        "session_id", "seq", ts.alias("ts"), F.coalesce(elapsed, F.lit(0)).cast("int").alias("session_time_on_page_secs"),
        F.hour(ts).alias("session_hour_of_day"), (F.weekday(ts) >= 5).alias("session_is_weekend"), F.col("mobile").alias("session_device_mobile"),
        F.col("n_filled").alias("session_n_fields_completed"), F.col("n_skipped").alias("session_n_fields_skipped"),
        (F.col("n_filled") / n_required).alias("session_field_completion_rate"), F.col("back").alias("session_navigation_back_count"),
        F.lit(n_required).alias("job_n_required_fields"),
    )


_LABEL = "session_id long, started_us long, submitted_us long, label int"
_PENDING = "started long, submits array<long>, told boolean"


def abandonment_stream(events: DataFrame, days: int = 7, late: str = "1 hour") -> DataFrame:
    """(session_id, started_at, submitted_at, label) of each application begun: 0 when it is submitted within the days, 1 when
    an event-time timer ends them without.

    ``events`` is a stream of (session_id, ts, action). Sessions that never filled or skipped a field give no row. A submit
    may come before the event that began the session, as long as neither is later than ``late``; the timer waits for the
    watermark, so no event in time is missed. State is kept until the days are over and holds a few times of each session.
    """
    window_us = days * 24 * HOUR_MS * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, submits, told = state.get if state.exists else (None, [], False)
        submits = list(submits)
        out = []
        if state.hasTimedOut:
            if started is not None and not told:
                out.append((key[0], started, None, 1))
            state.remove()
        else:
            for batch in batches:
                begun = batch.loc[batch["action"].isin(["fill", "skip"]), "us"]
                if len(begun):
                    started = min(int(begun.min()), started if started is not None else int(begun.min()))
                submits += [int(us) for us in batch.loc[batch["action"] == "submit", "us"].unique()]
            if started is not None:
                inside = [us for us in submits if started <= us <= started + window_us]
                if inside and not told:
                    out.append((key[0], started, min(inside), 0))
                    told = True
                submits = [us for us in submits if us < started] if not told else []  # an earlier start may come late
            submits = sorted(set(submits))
            due = (started if started is not None else max(submits, default=0)) + window_us
            state.update((started, submits, told))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        rows = pd.DataFrame(out, columns=["session_id", "started_us", "submitted_us", "label"])
        rows["submitted_us"] = rows["submitted_us"].astype("Int64")
        yield rows

    typed = events.withWatermark("ts", late).filter(F.col("action").isin("fill", "skip", "submit")).select(
        F.col("session_id").cast("long").alias("session_id"), "ts", F.unix_micros("ts").alias("us"), "action")
    found = typed.groupBy("session_id").applyInPandasWithState(step, _LABEL, _PENDING, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select("session_id", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("submitted_us").alias("submitted_at"), "label")


def rescored(rows: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(session_id, seq, ts, elapsed, p, alert) of snapshots; the alert needs p of 0.5 and more and a model that does not abstain."""
    band = dc.abstention_band(F.round(dc.confidence(F.col("p")), 9))
    return scorer(rows).select(
        "session_id", "seq", "ts", F.col("session_time_on_page_secs").alias("elapsed"), "p", dc.reach_out(F.col("p"), band).alias("alert"))


def watch(events: DataFrame, n_required: int, scorer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Scores each snapshot as it comes and keeps the history in ``path``. A batch that is run again replaces its own folder."""

    def keep(batch: DataFrame, number: int) -> None:
        rescored(batch, scorer).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return snapshots(events, n_required).writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
