"""The feature row of a (candidate, posting) pair, and the pairs themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.functions import text as T, vocab as V
from matchloom.functions.trajectory import with_trajectory
from matchloom.operators import simulate as sim

UNKNOWN_YEARS, UNKNOWN_WANTED = 3.0, 2.0


def candidate_features(resumes: DataFrame) -> DataFrame:
    """What a candidate brings to every pair, by resume_id."""
    own = with_trajectory(resumes)
    years, roles = F.coalesce("years_experience", F.lit(UNKNOWN_YEARS)), F.greatest(F.lit(1), F.col("role_count"))
    return own.select(
        "resume_id", T.skills_or_text(F.col("skills"), T.blank_if_null(F.col("text"))).alias("cand_skills"),
        years.alias("cand_yoe"), roles.cast("int").alias("cand_n_past_roles"), (years / roles).alias("cand_avg_tenure_yrs"),
        F.col("seniority").cast("int").alias("cand_seniority_level"), F.col("domain").alias("cand_domain"),
        T.country(F.col("location"), V.COUNTRY_NEEDLES_SERVING).alias("cand_location_country"),
    )


def posting_features(jobs: DataFrame) -> DataFrame:
    """What a posting brings to every pair, by job_id. No years asked for, or none, count as two."""
    body = T.blank_if_null(F.col("description"))
    heading = F.concat(T.blank_if_null(F.col("title")), F.lit(" "), body)
    wanted = F.when(F.col("min_years_experience") != 0, F.col("min_years_experience"))
    return jobs.select(
        "job_id", T.skills_or_text(F.col("required_skills"), body).alias("job_skills"),
        F.coalesce(wanted, F.lit(UNKNOWN_WANTED)).alias("job_min_yoe"),
        T.coarse_seniority(heading).cast("int").alias("job_seniority_level"), F.lower(heading).contains("remote").alias("says_remote"),
    )


def candidate_pairs(dense: DataFrame, bm25: DataFrame) -> DataFrame:
    """(job_id, resume_id, sem_similarity, bm25_score): the dense hits of each posting; a pair outside the lexical hits scores 0."""
    lexical = bm25.select("query_id", "doc_id", F.col("score").alias("bm25_score"))
    return dense.select("query_id", "doc_id", F.col("score").alias("sem_similarity")).join(lexical, ["query_id", "doc_id"], "left").select(
        F.col("query_id").alias("job_id"), F.col("doc_id").alias("resume_id"), "sem_similarity",
        F.coalesce("bm25_score", F.lit(0.0)).alias("bm25_score"))


def pair_rows(pairs: DataFrame, resumes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pairs with both sides. Only candidates that occur in a pair are parsed."""
    paired = resumes.join(pairs.select("resume_id").distinct(), "resume_id", "left_semi")
    return pairs.join(candidate_features(paired), "resume_id").join(posting_features(jobs), "job_id")


def feature_rows(rows: DataFrame, seed: int = 42, overrides: dict[str, Column] | None = None) -> DataFrame:
    """(job_id, resume_id) and the model's features. A drawn session and posting state stand in for what ``overrides`` leaves open or null.

    As with a caller that pins single values, an override does not change the values that were derived from the draw.
    """
    d = sim.Draws(seed, F.lit("features"), F.col("job_id"), F.col("resume_id"))
    drawn = sim.with_derived_session(rows.withColumns({**sim.session_draws(d), **sim.job_draws(d)}))
    drawn = drawn.withColumn("job_has_remote_option", F.col("says_remote")).withColumns(sim.match_features())
    pinned = {n: F.coalesce(c, F.col(n)) for n, c in (overrides or {}).items()}
    return drawn.select("job_id", "resume_id", *[pinned.get(n, F.col(n)).alias(n) for n in schemas.DROPOFF_FEATURES])
