"""Counterfactual changes to a session, their uplift, and the smallest set that helps.

A scorer adds column ``p`` to a table of feature rows; it may be a closed-form
expression or a fitted model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.decisions import uplift_verdict

Scorer = Callable[[DataFrame], DataFrame]
Change = Callable[[], dict[str, Column]]


def _fewer(column: str, n: int) -> Column:
    return F.greatest(F.lit(0), F.col(column) - n)


def _rate(done: Column, required: Column) -> Column:
    return F.least(F.lit(1.0), done / F.greatest(F.lit(1), required))


def _prefill() -> dict[str, Column]:
    required = F.greatest(F.lit(1), F.col("job_n_required_fields"))
    done = F.least(required, F.col("session_n_fields_completed") + 3)
    return {
        "session_n_fields_skipped": _fewer("session_n_fields_skipped", 3),
        "session_n_fields_completed": done,
        "session_field_completion_rate": _rate(done, required),
    }


def _shorten() -> dict[str, Column]:
    required = F.greatest(F.lit(4), F.col("job_n_required_fields") - 3)
    return {
        "job_n_required_fields": required,
        "session_field_completion_rate": _rate(F.col("session_n_fields_completed"), required),
    }


def _save_and_resume() -> dict[str, Column]:
    return {
        "session_navigation_back_count": _fewer("session_navigation_back_count", 2),
        "session_time_on_page_secs": F.greatest(F.lit(60), F.col("session_time_on_page_secs")),
    }


def _auto_save() -> dict[str, Column]:
    return {
        "session_n_fields_skipped": _fewer("session_n_fields_skipped", 2),
        "session_navigation_back_count": _fewer("session_navigation_back_count", 1),
    }


# Catalogue order settles equal uplifts.
CATALOGUE: dict[str, Change] = {
    "prefill_work_history": _prefill,
    "shorten_form": _shorten,
    "save_and_resume": _save_and_resume,
    "mobile_optimize": lambda: {"session_device_mobile": F.lit(False)},
    "field_auto_save": _auto_save,
    "reveal_salary_early": lambda: {"session_n_fields_skipped": _fewer("session_n_fields_skipped", 1)},
}


def _row(features: list[str], schema, change: dict[str, Column]) -> Column:
    return F.struct(*[
        change.get(f, F.col(f)).cast(schema[f].dataType).alias(f) for f in features
    ])


def _variants(df: DataFrame, features: list[str], offered: Callable[[str], Column | None], catalogue) -> Column:
    """The row itself (order -1) and each offered change, as an array."""
    rows = [F.struct(F.lit(-1).alias("order"), F.lit(None).cast("string").alias("change"),
                     _row(features, df.schema, {}).alias("features"))]
    for order, (name, change) in enumerate(catalogue.items()):
        made = F.struct(F.lit(order).alias("order"), F.lit(name).alias("change"),
                        _row(features, df.schema, change()).alias("features"))
        wanted = offered(name)
        rows.append(made if wanted is None else F.when(wanted, made))
    return F.array_compact(F.array(*rows))


def rank_interventions(
    df: DataFrame, key: str, features: list[str], scorer: Scorer, catalogue: dict[str, Change] = CATALOGUE,
) -> DataFrame:
    """(key, intervention, baseline, counterfactual, uplift...) ranked per row by uplift.

    Every row becomes 1 + 6 rows for one scoring pass; the rows of a key are as
    many as the catalogue, so its window is small.
    """
    exploded = df.select(key, F.inline(_variants(df, features, lambda _: None, catalogue)))
    scored = scorer(exploded.select(key, "order", "change", "features.*")).select(key, "order", "change", "p")
    of_row = Window.partitionBy(key)
    base = F.max(F.when(F.col("order") == -1, F.col("p"))).over(of_row)
    uplift = F.col("baseline_prob") - F.col("p")
    order = of_row.orderBy(F.desc("uplift_absolute"), F.asc("order"))
    return (
        scored.withColumn("baseline_prob", base).filter(F.col("order") >= 0)
        .withColumn("uplift_absolute", uplift)
        .withColumn("rank", F.row_number().over(order))
        .select(
            key, F.col("change").alias("intervention"), "baseline_prob",
            F.col("p").alias("counterfactual_prob"), "uplift_absolute",
            F.when(F.col("baseline_prob") > 0, F.col("uplift_absolute") / F.col("baseline_prob"))
            .otherwise(0.0).alias("uplift_relative"),
            uplift_verdict(F.col("uplift_absolute")).alias("verdict"), "rank",
        )
    )


def minimum_counterfactual(
    df: DataFrame, key: str, features: list[str], scorer: Scorer,
    target: float = 0.30, max_changes: int = 3, catalogue: dict[str, Change] = CATALOGUE,
) -> DataFrame:
    """Greedy smallest set of changes that brings each row to the target.

    All rows advance together, one round per allowed change. Rounds share the
    partitioning of the key, so only the first one shuffles.
    """
    state = scorer(df.select(key, *features)).select(
        key, F.struct(*features).alias("features"), F.col("p").alias("baseline_prob"), "p",
        F.array().cast("array<string>").alias("applied"),
    )
    for _ in range(max_changes):
        flat = state.select(key, "baseline_prob", F.col("p").alias("now"), "applied", "features.*")
        open_row = F.col("now") > target
        tried = flat.select(
            key, "baseline_prob", "applied",
            F.inline(_variants(flat, features, lambda n: open_row & ~F.array_contains("applied", n), catalogue)),
        )
        scored = scorer(tried.select(key, "baseline_prob", "applied", "order", "change", "features.*"))
        # Keeping the row comes first, so a change must lower the risk to win.
        best = F.min_by(
            F.struct("baseline_prob", "applied", "change", "p", F.struct(*features).alias("features")),
            F.struct("p", "order"),
        )
        chosen = scored.groupBy(key).agg(best.alias("b"))
        state = chosen.select(
            key, "b.features", "b.baseline_prob", "b.p",
            F.when(F.col("b.change").isNull(), F.col("b.applied"))
            .otherwise(F.array_append("b.applied", F.col("b.change"))).alias("applied"),
        )
    return state.select(
        key, "applied", "baseline_prob", F.col("p").alias("final_prob"),
        (F.col("p") <= target).alias("reached_target"),
    )
