"""Seeded draws and the two label simulators, entirely as Columns.

A draw is a function of (seed, row key, name): the same on any number of
partitions, in any branch and after a lost executor, which ``rand()`` is not.
One MD5 digest gives four 32-bit uniforms; normals, gammas and betas of
half-integer shape are exact transforms of uniforms.
"""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import decisions, vocab as V
from matchloom.operators.ordered import shuffled_positions


class Draws:
    """Independent uniforms in (0, 1) for a row key."""

    def __init__(self, seed: int, *key: Column) -> None:
        self._key = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
        self._taken = 0

    def uniform(self) -> Column:
        digest, slot = divmod(self._taken, 4)
        self._taken += 1
        hex8 = F.substring(F.md5(F.concat(self._key, F.lit(f"#{digest}"))), 1 + 8 * slot, 8)
        return (F.conv(hex8, 16, 10).cast("double") + 0.5) / 2.0**32

    def bernoulli(self, p: float) -> Column:
        return self.uniform() < p

    def choice(self, values: list, weights: list[float]) -> Column:
        u, total = self.uniform(), sum(weights)
        cuts = [c / total for c in accumulate(weights)][:-1]
        picked = F.lit(values[-1])
        for value, cut in reversed(list(zip(values, cuts))):
            picked = F.when(u < cut, value).otherwise(picked)
        return picked

    def exponential(self, scale: float = 1.0) -> Column:
        return -F.log(self.uniform()) * scale

    def normal(self, mean: float = 0.0, sd: float = 1.0) -> Column:
        radius, angle = F.sqrt(-2.0 * F.log(self.uniform())), 2.0 * math.pi * self.uniform()
        return radius * F.cos(angle) * sd + mean

    def gamma(self, shape: float, scale: float = 1.0) -> Column:
        """Whole shape: a sum of exponentials; half a shape more: half a squared normal."""
        whole, half = divmod(shape, 1.0)
        if half not in (0.0, 0.5):
            raise ValueError("shape must be a multiple of one half")
        total = F.lit(0.0)
        for _ in range(int(whole)):
            total = total + self.exponential()
        if half:
            z = self.normal()
            total = total + z * z / 2.0
        return total * scale

    def beta(self, a: float, b: float) -> Column:
        x, y = self.gamma(a), self.gamma(b)
        return x / (x + y)

    def poisson(self, lam: float) -> Column:
        """Inverse of the cumulative distribution, whose table ends where 32 bits do."""
        u = self.uniform()
        cdf, term, n = [], math.exp(-lam), 0
        total = term
        while total < 1.0 - 2.0**-33 and n < 20 * (lam + 10):
            cdf.append(total)
            n += 1
            term *= lam / n
            total += term
        return F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c <= u))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def session_draws(d: Draws) -> dict[str, Column]:
    mobile = d.bernoulli(0.45)
    noise = d.normal(0.0, 0.6)
    seconds = F.exp(F.when(mobile, 5.0).otherwise(5.5) + noise)
    required = d.choice(*V.REQUIRED_FIELDS)
    return {
        "session_device_mobile": mobile,
        "session_time_on_page_secs": F.floor(clip(seconds, 5.0, 3600.0)).cast("int"),
        "session_hour_of_day": d.choice(list(range(24)), V.HOUR_WEIGHTS),
        "session_is_weekend": d.bernoulli(2 / 7),
        "job_n_required_fields": required,
        "session_n_fields_completed": F.bround(d.beta(2.5, 1.5) * required).cast("int"),
        "session_navigation_back_count": F.when(mobile, d.poisson(0.6)).otherwise(d.poisson(1.2)),
    }


def job_draws(d: Draws) -> dict[str, Column]:
    return {
        "job_posting_age_days": d.poisson(18),
        "job_has_remote_option": d.bernoulli(0.55),
        "job_n_applicants_so_far": d.poisson(80),
        "job_salary_band": d.choice(*V.SALARY_BANDS),
    }


def with_derived_session(df: DataFrame) -> DataFrame:
    required, done = F.col("job_n_required_fields"), F.col("session_n_fields_completed")
    return df.withColumns({
        "session_n_fields_skipped": F.greatest(F.lit(0), required - done),
        "session_field_completion_rate": done / required,
    })


def match_features() -> dict[str, Column]:
    """From (cand_skills, job_skills, cand_yoe, job_min_yoe)."""
    shared = F.size(F.array_intersect("cand_skills", "job_skills"))
    overlap = F.when(F.size("job_skills") > 0, shared / F.size(F.array_distinct("job_skills"))).otherwise(0.0)
    gap = F.col("cand_yoe") - F.col("job_min_yoe")
    return {
        "skill_overlap": overlap, "skill_gap": 1.0 - overlap,
        "yoe_gap": gap, "under_qualified": gap < 0, "education_match": F.lit(True),
    }


def calibrated_intercept(logits: DataFrame, target: float, steps: int = 100) -> float:
    """Bisects the intercept that gives all intercept-free logits the wanted mean rate.

    One aggregate over every row leaves, for each slot of 1/steps, a count and a mean logit; logits beyond
    +-30 share the outer slots, so the driver holds at most 60 * steps + 1 rows whatever the table holds.
    """
    held = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit")))
    slots = logits.filter(F.col("logit").isNotNull()).select(held.alias("x")).groupBy(F.round(F.col("x") * steps).cast("int").alias("slot")).agg(
        F.count("*").alias("n"), F.avg("x").alias("x")).orderBy("slot").select("n", "x").toPandas()
    if not len(slots):
        return 0.0
    low, high = -10.0, 5.0
    for _ in range(40):
        mid = (low + high) / 2
        rate = float((slots["n"] / (1.0 + (-(slots["x"] + mid)).map(math.exp))).sum() / slots["n"].sum())
        low, high = (mid, high) if rate < target else (low, mid)
    return (low + high) / 2


def generate_dropoff(pairs: DataFrame, n_rows: int, seed: int = 42, target_rate: float | None = None) -> DataFrame:
    """Drop-off samples: ``n_rows`` draws with replacement from (candidate, posting) pairs.

    Pairs are numbered by a seeded shuffle, which is distributed; a drawn number
    then finds its pair by an equi-join.
    """
    numbered = shuffled_positions(
        pairs.withColumn("_pair", F.concat_ws("::", "job_id", "resume_id")), "_pair", seed
    ).drop("_pair")
    n_pairs = pairs.count()
    if not n_pairs:
        raise ValueError("pairs must not be empty")
    spark = pairs.sparkSession
    picks = spark.range(n_rows).select(
        F.col("id").alias("sample_key"),
        F.floor(Draws(seed, F.lit("pair"), F.col("id")).uniform() * n_pairs).cast("long").alias("position"),
    )
    rows = picks.join(numbered.drop("size"), "position").drop("position")
    return label_sessions(rows, seed, target_rate)


def label_sessions(rows: DataFrame, seed: int = 42, target_rate: float | None = None) -> DataFrame:
    """Draws a session and a posting state per ``sample_key`` and labels it by the rule."""
    d = Draws(seed, F.lit("dropoff"), F.col("sample_key"))
    drawn = with_derived_session(rows.withColumns({**session_draws(d), **job_draws(d)}))
    drawn = drawn.withColumns(match_features()).withColumn(
        "cand_avg_tenure_yrs", F.col("cand_yoe") / F.greatest(F.lit(1), F.col("cand_n_past_roles"))
    )
    intercept = V.DROPOFF_INTERCEPT
    if target_rate is not None:
        bare = drawn.select("sample_key", decisions.dropoff_logit(0.0).alias("logit"))
        intercept = calibrated_intercept(bare, target_rate)
    p = decisions.sigmoid(decisions.dropoff_logit(intercept) + d.normal(0.0, V.DROPOFF_NOISE_SD))
    return (
        drawn.withColumn("p_dropoff_true", p)
        .withColumn("label", (d.uniform() < F.col("p_dropoff_true")).cast("int"))
        .withColumn("sample_id", F.format_string("s%06d", F.col("sample_key").cast("long")))
        .drop("cand_skills", "job_skills", "job_min_yoe")
    )


def offer_draws(d: Draws) -> dict[str, Column]:
    quick, fast, slow = d.bernoulli(0.6), d.exponential(6.0), d.exponential(60.0) + 24
    return {
        "offer_salary_gap_pct": clip(d.normal(-0.03, 0.10), -0.5, 0.5),
        "days_interview_to_offer": clip(d.gamma(2.0, 3.5), 0.0, 90.0),
        "interview_rounds": d.choice(*V.INTERVIEW_ROUNDS),
        "candidate_response_hours": clip(F.when(quick, fast).otherwise(slow), 0.0, 720.0),
        "negotiation_rounds": d.choice(*V.NEGOTIATION_ROUNDS),
        "competing_offer_signal": d.bernoulli(0.20).cast("int"),
        "commute_minutes": clip(d.gamma(1.5, 25.0), 0.0, 180.0),
        "remote_option": d.bernoulli(0.35).cast("int"),
        "cand_yoe": clip(d.gamma(2.5, 3.5), 0.0, 40.0),
        "cand_seniority_tier": d.choice(*V.SENIORITY_TIERS),
        "cand_currently_employed": d.bernoulli(0.72).cast("int"),
        "company_brand_tier": d.bernoulli(0.15).cast("int"),
    }


def solve_base_logit(logits: DataFrame, target: float, tolerance: float = 0.005, rounds: int = 40) -> float:
    """Bisects the base logit over the whole table; each round is one aggregate.

    The logits are first counted into steps of 1/1000, so the rounds after the
    first pass only read that histogram.
    """
    steps = logits.groupBy(F.round("logit", 3).alias("logit")).agg(F.count("*").alias("n"))
    # Bounded: logits span a few dozen units, so at most some 10^5 steps exist.
    table = steps.toPandas()
    x, n = table["logit"].to_numpy(float), table["n"].to_numpy(float)
    low, high = -10.0, 10.0
    import numpy as np

    for _ in range(rounds):
        mid = (low + high) / 2
        rate = float((n / (1.0 + np.exp(-(x + mid)))).sum() / n.sum())
        if abs(rate - target) < tolerance:
            return mid
        low, high = (low, mid) if rate > target else (mid, high)
    return (low + high) / 2


def generate_offers(keys: DataFrame, seed: int = 42, target_rate: float = 0.18) -> DataFrame:
    """Offer samples, one per ``sample_key``, labelled by the decline rule."""
    d = Draws(seed, F.lit("offer"), F.col("sample_key"))
    drawn = keys.select("sample_key", *[c.alias(n) for n, c in offer_draws(d).items()])
    base = solve_base_logit(drawn.select(decisions.decline_logit().alias("logit")), target_rate)
    p = decisions.sigmoid(decisions.decline_logit(base))
    return (
        drawn.withColumn("declined_offer", (d.uniform() < p).cast("int"))
        .withColumn("sample_id", F.format_string("po-%05d", F.col("sample_key").cast("long")))
    )


def split_rows(
    df: DataFrame, id_col: str, train: float = 0.70, val: float = 0.15, seed: int = 42,
    stratify: str | None = None,
) -> DataFrame:
    """Adds ``split`` with exact counts: int(train*n) and int(val*n), the rest is test."""
    placed = shuffled_positions(df, id_col, seed, [stratify] if stratify else None)
    n_train = F.floor(F.col("size") * train)
    n_val = F.floor(F.col("size") * val)
    split = F.when(F.col("position") < n_train, "train").when(F.col("position") < n_train + n_val, "val")
    return placed.withColumn("split", split.otherwise("test")).drop("position", "size")
