"""Career trajectories of candidates, what a posting asks for, and the match of both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import periods, text as T, vocab as V

TRAJECTORY_COLUMNS = [
    "years_experience", "seniority", "company_tier", "domain", "tenure_signal", "role_count",
    "recent_yoe", "recent_seniority", "recent_company_tier", "recent_domain", "n_recent_roles",
]
CRITERIA_COLUMNS = ["min_yoe", "target_seniority", "target_domain"]


def _joined(skills: Column) -> Column:
    return F.when(F.size(skills) > 0, F.concat(F.array_join(skills, " "), F.lit(" "))).otherwise("")


def with_trajectory(resumes: DataFrame) -> DataFrame:
    """Adds the trajectory columns to (text, skills, years_experience, target_role).

    Whole texts are searched for all words at once; the few recent passages word by word, where there are any.
    """
    body = T.blank_if_null(F.col("text"))
    role = T.blank_if_null(F.col("target_role"))
    titled, whole = F.concat(role, F.lit(" "), body), F.concat(_joined(F.col("skills")), role, F.lit(" "), body)
    dated = resumes.withColumns({
        "_dated": periods.dated_roles(body), "_titles": T.title_words(titled), "_domains": T.domain_words(whole),
    })
    roles = F.col("_dated.roles")
    recent_text = F.col("_dated.recent_text")
    n_recent = F.size(periods.recent_roles(roles))
    has_text = (n_recent > 0) & (T.strip(recent_text) != "")
    years = F.coalesce(F.col("years_experience"), T.years_of_experience(body))
    return (
        dated.withColumn("seniority", T.seniority(titled, F.col("_titles")))
        .withColumn("domain", T.domain(whole, F.col("_domains")))
        .withColumn("company_tier", T.company_tier(body, F.col("_titles")))
        .withColumn("role_count", T.role_mentions(body))
        .withColumn("recent_yoe", F.when(F.size(roles) > 0, periods.recent_years(roles)))
        .withColumn("n_recent_roles", n_recent)
        .withColumn("recent_seniority", F.when(has_text, T.seniority(recent_text)).otherwise(V.UNKNOWN))
        .withColumn("recent_domain", F.when(has_text, T.domain(recent_text)).otherwise(V.GENERAL_DOMAIN))
        .withColumn("recent_company_tier", F.when(has_text, T.company_tier(recent_text)).otherwise(0))
        .withColumn("years_experience", years)
        .withColumn("tenure_signal", T.tenure_signal(F.col("years_experience")))
        .drop("_dated", "_titles", "_domains")
    )


def with_criteria(jobs: DataFrame) -> DataFrame:
    """Adds what a posting asks for to (title, description, required_skills, min_years_experience)."""
    body = T.blank_if_null(F.col("description"))
    heading = F.concat(T.blank_if_null(F.col("title")), F.lit(" "), body)
    return (
        jobs.withColumn("min_yoe", F.coalesce(F.col("min_years_experience"), T.years_of_experience(body)))
        .withColumn("target_seniority", T.seniority(heading))
        .withColumn("target_domain", T.domain(F.concat(_joined(F.col("required_skills")), heading)))
    )


def yoe_match(years: Column, wanted: Column) -> Column:
    return (
        F.when(wanted.isNull() | (wanted <= 0), 0.5)
        .when(years.isNull(), 0.3)
        .when(years >= wanted, 1.0)
        .otherwise(F.greatest(F.lit(0.0), years / wanted))
    )


def seniority_match(level: Column, wanted: Column) -> Column:
    gap = F.abs(level - wanted)
    return (
        F.when((level == V.UNKNOWN) | (wanted == V.UNKNOWN), 0.5)
        .when(gap == 0, 1.0).when(gap == 1, 0.7).when(gap == 2, 0.4).otherwise(0.1)
    )


def domain_match(have: Column, wanted: Column) -> Column:
    general = (have == V.GENERAL_DOMAIN) | (wanted == V.GENERAL_DOMAIN)
    return F.when(have == wanted, 1.0).when(general, 0.5).otherwise(0.0)


def trajectory_score(
    weights: dict[str, float] = V.TRAJECTORY_WEIGHTS,
    recency_bias: float = V.RECENCY_BIAS,
    use_company_tier: bool = True,
) -> Column:
    """The parts and the total of a (candidate, posting) row that holds both column sets."""
    bias = min(1.0, max(0.0, recency_bias))
    recent = F.col("recent_yoe").isNotNull() & (F.col("n_recent_roles") > 0)
    beta = F.when(recent, F.lit(bias)).otherwise(0.0)

    def blend(whole: Column, latest: Column) -> Column:
        return (1 - beta) * whole + beta * latest

    tier = blend(F.col("company_tier").cast("double"), F.col("recent_company_tier").cast("double"))
    parts = {
        "yoe_match": blend(yoe_match(F.col("years_experience"), F.col("min_yoe")),
                           yoe_match(F.col("recent_yoe"), F.col("min_yoe"))),
        "seniority_match": blend(seniority_match(F.col("seniority"), F.col("target_seniority")),
                                 seniority_match(F.col("recent_seniority"), F.col("target_seniority"))),
        "domain_overlap": blend(domain_match(F.col("domain"), F.col("target_domain")),
                                domain_match(F.col("recent_domain"), F.col("target_domain"))),
        "tenure": F.col("tenure_signal"),
        "tier_bonus": tier if use_company_tier else F.lit(0.0),
    }
    total = sum((F.lit(weights[n]) * c for n, c in parts.items()), F.lit(0.0))
    return F.struct(*[c.alias(n) for n, c in parts.items()], total.alias("total"))
