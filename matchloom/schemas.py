"""Table schemas, feature lists and the declared bounds of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESUME_CSV = (
    "resume_id string, candidate_name string, text string, skills string, "
    "years_experience double, location string, education string, target_role string"
)
JOB_CSV = (
    "job_id string, title string, company string, description string, required_skills string, "
    "min_years_experience double, location string, required_certifications string"
)
CATEGORY_RESUME_CSV = "ID long, Resume_str string, Resume_html string, Category string"
POSTING_CSV = (
    "job_id long, company_name string, title string, description string, location string, "
    "formatted_experience_level string, skills_desc string"
)
HR_CSV = (
    "enrollee_id long, city string, city_development_index string, gender string, "
    "relevent_experience string, enrolled_university string, education_level string, "
    "major_discipline string, experience string, company_size string, company_type string, "
    "last_new_job string, training_hours string, target double"
)
FIT_PAIR = "row_no long, resume_text string, job_description_text string, label string"

DROPOFF_FEATURES = [
    "sem_similarity", "bm25_score", "skill_overlap", "skill_gap", "yoe_gap", "under_qualified",
    "education_match", "cand_yoe", "cand_n_past_roles", "cand_avg_tenure_yrs",
    "cand_seniority_level", "cand_domain", "cand_location_country", "job_posting_age_days",
    "job_n_required_fields", "job_has_remote_option", "job_seniority_level",
    "job_n_applicants_so_far", "job_salary_band", "session_time_on_page_secs",
    "session_hour_of_day", "session_is_weekend", "session_device_mobile",
    "session_n_fields_completed", "session_n_fields_skipped", "session_field_completion_rate",
    "session_navigation_back_count",
]
DROPOFF_CATEGORICAL = ["cand_domain", "cand_location_country"]
DROPOFF_LABEL = "label"
MONITORED_FEATURES = [
    "session_time_on_page_secs", "session_n_fields_completed", "session_n_fields_skipped",
    "session_field_completion_rate", "session_navigation_back_count", "session_hour_of_day",
]

OFFER_FEATURES = [
    "offer_salary_gap_pct", "days_interview_to_offer", "interview_rounds",
    "candidate_response_hours", "negotiation_rounds", "competing_offer_signal",
    "commute_minutes", "remote_option", "cand_yoe", "cand_seniority_tier",
    "cand_currently_employed", "company_brand_tier",
]
OFFER_CATEGORICAL = [
    "competing_offer_signal", "remote_option", "cand_currently_employed", "company_brand_tier",
]
OFFER_LABEL = "declined_offer"

HR_NUMERIC = ["city_development_index", "training_hours"]
HR_CATEGORICAL = [
    "city", "relevent_experience", "enrolled_university", "education_level", "major_discipline",
    "experience", "company_size", "company_type", "last_new_job",
]
HR_GENDERS = ["Male", "Female", "Other"]

# column: (lower bound, upper bound), either may be missing
Bounds = dict[str, tuple[float | None, float | None]]

DROPOFF_BOUNDS: Bounds = {
    "sem_similarity": (-1, 1), "bm25_score": (0, None), "skill_overlap": (0, 1),
    "skill_gap": (0, 1), "cand_yoe": (0, None), "cand_n_past_roles": (0, None),
    "cand_avg_tenure_yrs": (0, None), "cand_seniority_level": (0, 5),
    "job_posting_age_days": (0, None), "job_n_required_fields": (1, None),
    "job_seniority_level": (0, 5), "job_n_applicants_so_far": (0, None),
    "job_salary_band": (1, 4), "session_time_on_page_secs": (0, None),
    "session_hour_of_day": (0, 23), "session_n_fields_completed": (0, None),
    "session_n_fields_skipped": (0, None), "session_field_completion_rate": (0, 1),
    "session_navigation_back_count": (0, None), "p_dropoff_true": (0, 1), "label": (0, 1),
}
OFFER_BOUNDS: Bounds = {
    "offer_salary_gap_pct": (-0.5, 0.5), "days_interview_to_offer": (0, 90),
    "interview_rounds": (1, 8), "candidate_response_hours": (0, 720),
    "negotiation_rounds": (0, 6), "competing_offer_signal": (0, 1), "commute_minutes": (0, 180),
    "remote_option": (0, 1), "cand_yoe": (0, 40), "cand_seniority_tier": (1, 5),
    "cand_currently_employed": (0, 1), "company_brand_tier": (0, 1), "declined_offer": (0, 1),
}


def _breaks(column: str, low: float | None, high: float | None) -> Column:
    value = F.col(column)
    bad = value.isNull()
    if low is not None:
        bad = bad | (value < low)
    if high is not None:
        bad = bad | (value > high)
    return bad


def violations(df: DataFrame, bounds: Bounds) -> DataFrame:
    """(rule, n_violations) of every bounded column, counted in one pass."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("rule"), F.count_if(_breaks(c, lo, hi)).alias("n_violations"))
        for c, (lo, hi) in bounds.items()
    ])
    return df.agg(rows.alias("rows")).select(F.inline("rows"))


def require_bounds(df: DataFrame, bounds: Bounds) -> DataFrame:
    """The same table; a row outside a bound fails the job that reads it."""
    checks = [
        F.when(_breaks(c, lo, hi), F.raise_error(F.lit(f"{c} is outside its bounds"))).otherwise(F.lit(True))
        for c, (lo, hi) in bounds.items()
    ]
    ok = checks[0]
    for check in checks[1:]:
        ok = ok & check
    return df.filter(ok)
