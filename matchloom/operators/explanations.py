"""Evidence-grounded explanations: by template, or by a language model with the template behind it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import phrases, text as tx, vocab as V
from matchloom.functions.decisions import risk_band

EXPLANATION_COLUMNS = [
    "matched_skills", "missing_skills", "skill_overlap_pct", "overall_fit", "dropoff_risk",
    "dropoff_drivers", "recommendation", "recommendation_note",
]


def with_skill_evidence(rows: DataFrame, cand_skills: str = "cand_skills", job_skills: str = "job_skills") -> DataFrame:
    """matched, missing and overlap of two skill lists."""
    matched = F.array_sort(F.array_intersect(cand_skills, job_skills))
    missing = F.array_sort(F.array_except(job_skills, cand_skills))
    n = F.size(matched) + F.size(missing)
    return rows.withColumns({"matched_skills": matched, "missing_skills": missing}).withColumn(
        "overlap", F.when(n > 0, F.size("matched_skills") / n).otherwise(0.0)
    )


def with_explanation(rows: DataFrame, p: str = "p", drivers: Column | None = None) -> DataFrame:
    """Adds the explanation columns to rows with skill evidence and a probability."""
    text = drivers if drivers is not None else phrases.driver_text(F.col("p_base"), F.col("attributions"))
    advice = phrases.recommendation(F.col("overlap"), F.col("dropoff_risk"))
    return (
        rows.withColumn("dropoff_risk", risk_band(F.col(p)))
        .withColumn("skill_overlap_pct", F.bround(100 * F.col("overlap")).cast("int"))
        .withColumn("overall_fit", phrases.overall_fit(F.col("matched_skills"), F.col("missing_skills"), F.col("overlap")))
        .withColumn("dropoff_drivers", text)
        .withColumn("_advice", advice)
        .withColumn("recommendation", F.col("_advice.recommendation"))
        .withColumn("recommendation_note", F.col("_advice.note"))
        .drop("_advice")
    )


def rendered(candidate: Column, job: Column) -> Column:
    """The plain-text form of a row that has the explanation columns."""
    def listed(name: str, items: Column) -> Column:
        inner = F.when(F.size(items) > 0, F.array_join(items, ", ")).otherwise("—")
        return F.concat(F.lit(f"{name}  ("), F.size(items).cast("string"), F.lit("): "), inner)

    return F.concat_ws(
        "\n",
        F.concat(F.lit("Candidate "), candidate, F.lit("  ·  Job "), job), F.lit(""),
        listed("Matched skills", F.col("matched_skills")), listed("Missing skills", F.col("missing_skills")),
        F.concat(F.lit("Skill overlap : "), F.col("skill_overlap_pct").cast("string"), F.lit("%")), F.lit(""),
        F.concat(F.lit("Overall fit   : "), F.col("overall_fit")), F.lit(""),
        F.concat(F.lit("Drop-off risk : "), F.upper("dropoff_risk")), F.col("dropoff_drivers"), F.lit(""),
        F.concat(F.lit("Recommendation: "), F.replace(F.upper("recommendation"), F.lit("_"), F.lit(" "))),
        F.concat(F.lit("  → "), F.col("recommendation_note")),
    )


# (system prompt, prompt) in, raw answer out; an exception means no answer.
Client = Callable[[str, str], str]


def ask(rows: DataFrame, prompt: str, client: Client, system: str = V.SYSTEM_PROMPT) -> DataFrame:
    """Adds ``raw`` and ``failure``: the client's answer to each prompt, or why there is none."""
    schema = T.StructType([*rows.schema.fields, T.StructField("raw", T.StringType()), T.StructField("failure", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(text: str) -> tuple[str | None, str | None]:
            try:
                return client(system, text), None
            except Exception as error:  # any failure of the service falls back to the template
                return None, str(error)

        for batch in batches:
            answers = [one(text) for text in batch[prompt]]
            yield batch.assign(raw=[a for a, _ in answers], failure=[f for _, f in answers])

    return rows.mapInPandas(run, schema)


ANSWER = "dropoff_risk string, recommendation string, overall_fit string, recommendation_note string"


def json_object(raw: Column) -> Column:
    """The answer itself when it is JSON, else its outermost braces, else NULL."""
    block = F.regexp_extract(raw, r"(?s)\{.*\}", 0)

    def valid(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull(), c)

    return F.coalesce(valid(raw), valid(F.when(block != "", block)))


def with_model_explanation(rows: DataFrame) -> DataFrame:
    """Coerces ``raw`` answers into the explanation columns of a templated row.

    Skills, overlap and drivers always stay the computed ones. Without a JSON
    answer the templated row is kept, with the reason behind its fit sentence.
    """
    parsed = rows.withColumn("_json", json_object(F.col("raw"))).withColumn("_a", F.from_json("_json", ANSWER))
    answered = F.col("_json").isNotNull()
    reason = F.coalesce("failure", F.lit(V.NON_JSON_REASON))
    risk = F.lower(tx.blank_if_null(F.col("_a.dropoff_risk")))
    advice = F.lower(tx.strip(tx.blank_if_null(F.col("_a.recommendation"))))
    fit = tx.strip(tx.blank_if_null(F.col("_a.overall_fit")))
    note = tx.strip(tx.blank_if_null(F.col("_a.recommendation_note")))
    plain_fit = F.concat(F.col("skill_overlap_pct").cast("string"), F.lit("% skill overlap with the role."))
    return parsed.withColumns({
        "dropoff_risk": F.when(answered & risk.isin("low", "moderate", "high"), risk).otherwise(F.col("dropoff_risk")),
        "recommendation": F.when(~answered, F.col("recommendation"))
        .when(advice.isin("interview", "consider", "likely_mismatch"), advice).otherwise("consider"),
        "overall_fit": F.when(~answered, F.concat("overall_fit", F.lit("  [templated fallback: "), reason, F.lit("]")))
        .when(fit != "", fit).otherwise(plain_fit),
        "recommendation_note": F.when(~answered, F.col("recommendation_note"))
        .when(note != "", note).otherwise(V.DEFAULT_NOTE),
    }).drop("_json", "_a")
