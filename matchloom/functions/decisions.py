"""From features to logits, probabilities, bands and verdicts."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions import vocab as V


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def dropoff_terms() -> dict[str, Column]:
    """The inputs of the drop-off rule, by the name of their weight."""
    gap, required = F.col("yoe_gap"), F.col("job_n_required_fields")
    zero = F.lit(0.0)
    return {
        "skill_gap": F.col("skill_gap"),
        "under_qualification": F.greatest(zero, -gap),
        "over_qualification": F.least(F.greatest(zero, gap), F.lit(V.OVER_QUALIFICATION_CAP)),
        "stale_posting": (F.col("job_posting_age_days") > V.STALE_AFTER_DAYS).cast("double"),
        "form_length": required / 10.0,
        "remote": F.col("job_has_remote_option").cast("double"),
        "mobile": F.col("session_device_mobile").cast("double"),
        "time_on_page": F.col("session_time_on_page_secs") / 600.0,
        "skipped_share": F.col("session_n_fields_skipped") / F.greatest(F.lit(1), required),
    }


def dropoff_logit(intercept: float = V.DROPOFF_INTERCEPT, weights: dict[str, float] = V.DROPOFF_WEIGHTS) -> Column:
    total = F.lit(float(intercept))
    for name, term in dropoff_terms().items():
        total = total + F.lit(float(weights[name])) * term
    return total


def decline_terms() -> dict[str, Column]:
    """Each offer feature centred and scaled the way the decline rule takes it."""
    terms = {}
    for name, (_, centre, scale, floor) in V.DECLINE_TERMS.items():
        value = F.col(name) - centre
        if floor is not None:
            value = F.greatest(F.lit(floor), value)
        terms[name] = value / scale
    return terms


def decline_logit(intercept: float = 0.0) -> Column:
    total = F.lit(float(intercept))
    for name, term in decline_terms().items():
        total = total + F.lit(V.DECLINE_TERMS[name][0]) * term
    return total


def risk_band(p: Column) -> Column:
    return F.when(p < 0.30, "low").when(p < 0.60, "moderate").otherwise("high")


def confidence(p: Column) -> Column:
    """One less the entropy of the prediction, as a share of the largest entropy."""
    q = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0 - 1e-9))
    entropy = -q * F.log(q) - (1.0 - q) * F.log(1.0 - q)
    return 1.0 - entropy / math.log(2.0)


def abstention_band(conf: Column) -> Column:
    return F.when(conf >= 0.12, "confident").when(conf >= 0.03, "uncertain").otherwise("abstain")


def reach_out(p: Column, band: Column) -> Column:
    """Live alert: likely to leave, and the model does not abstain."""
    return (p >= 0.5) & (band != "abstain")


def health_score(mean_p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - mean_p))


def health_band(score: Column) -> Column:
    return F.when(score >= 0.65, "healthy").when(score >= 0.45, "moderate").otherwise("concerning")


def uplift_verdict(uplift: Column) -> Column:
    points = uplift * 100
    return (
        F.when(points >= 15, "strongly_recommended").when(points >= 5, "consider")
        .when(points >= -1, "minor_effect").otherwise("may_worsen")
    )


def similarity_band(cos: Column) -> Column:
    return F.when(cos >= 0.75, "strong").when(cos >= 0.55, "moderate").otherwise("weak")


def trajectory_line() -> Column:
    """The one-line summary of the trajectory columns of a row."""
    years = F.bround("years_experience").cast("long").cast("string")
    recent = F.bround("recent_yoe").cast("long").cast("string")
    level = F.create_map(*[x for k, v in V.SENIORITY_NAMES.items() for x in (F.lit(k), F.lit(v.lower()))])
    parts = F.array(
        F.when(F.col("years_experience").isNotNull(), F.concat(years, F.lit(" YOE"))),
        F.when(F.col("seniority") != V.UNKNOWN, level[F.col("seniority")]),
        F.when(F.col("domain") != V.GENERAL_DOMAIN, F.col("domain")),
        F.when(F.col("company_tier") == 1, F.lit("Tier-1")),
        F.when((F.col("n_recent_roles") > 0) & (F.col("recent_yoe") > 0), F.concat(recent, F.lit("y recent"))),
    )
    line = F.array_join(F.array_compact(parts), "  ·  ")
    return F.when(line == "", "trajectory features unavailable").otherwise(line)
