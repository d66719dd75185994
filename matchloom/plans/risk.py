"""Sessions, risk bands, interventions, drift, posting health, offers, audits and classifier metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.functions import decisions as dc, phrases, vocab as V
from matchloom.operators import (
    attributions as at, classifier_metrics as cm, fairness as fa, fusion, interventions as iv,
    monitoring as mo, sessions as se, simulate as sim,
)
from matchloom.operators.ordered import exact_quantiles
from matchloom.plans import tables as t
from matchloom.plans.reading import audit_proxies
from matchloom.plans.retrieval import bm25_channel, text_channels
from matchloom.session import settle

N_FIELDS = len(V.FORM_FIELDS)
RULE_FEATURES = [
    "skill_gap", "yoe_gap", "job_posting_age_days", "job_n_required_fields", "job_has_remote_option",
    "session_device_mobile", "session_time_on_page_secs", "session_n_fields_completed",
    "session_n_fields_skipped", "session_field_completion_rate", "session_navigation_back_count",
]


def _sessions(spark, folder) -> DataFrame:
    return se.session_features(t.form_events(spark, folder), N_FIELDS)


def _rule_rows(spark, folder) -> DataFrame:
    """Session features with match and posting fields derived from the session id."""
    s = F.col("session_id")
    return _sessions(spark, folder).withColumns({
        "session_time_on_page_secs": F.col("session_time_on_page_secs").cast("int"),
        "session_navigation_back_count": F.col("session_navigation_back_count").cast("int"),
        "skill_gap": (s * 7 % 11) / 10.0, "yoe_gap": (s * 5 % 13 - 4).cast("double"),
        "job_posting_age_days": (s * 3 % 31).cast("int"), "job_has_remote_option": s % 2 == 0,
        "job_n_required_fields": (F.lit(5) + s % 10).cast("int"),
    })


def rule_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("p", dc.sigmoid(dc.dropoff_logit()))


def session_features(spark, folder):
    return _sessions(spark, folder).select(
        "session_id", "session_time_on_page_secs", "session_hour_of_day", "session_is_weekend", "session_device_mobile",
        "session_n_fields_completed", "session_n_fields_skipped", F.round("session_field_completion_rate", 6).alias("completion_rate"),
        "session_navigation_back_count",
    )


def field_states(spark, folder):
    return se.field_states(t.form_events(spark, folder))


def abandonment_labels(spark, folder):
    out = se.abandonment_labels(t.form_events(spark, folder), 7)
    return out.select("session_id", "label", F.unix_timestamp("started_at").alias("started"), F.unix_timestamp("submitted_at").alias("submitted"))


def dropoff_risk(spark, folder):
    scored = rule_scorer(_rule_rows(spark, folder))
    conf = dc.confidence(F.col("p"))
    band = dc.abstention_band(F.round(conf, 9))
    return scored.select(
        "session_id", F.round("p", 6).alias("p"), dc.risk_band(F.col("p")).alias("risk_band"), F.round(conf, 6).alias("confidence"),
        band.alias("abstention_band"), dc.reach_out(F.col("p"), band).alias("reach_out"),
    )


def intervention_ranking(spark, folder):
    out = iv.rank_interventions(_rule_rows(spark, folder), "session_id", RULE_FEATURES, rule_scorer)
    return out.select("session_id", "intervention", *[F.round(c, 6).alias(c) for c in ("baseline_prob", "counterfactual_prob", "uplift_absolute", "uplift_relative")], "verdict", "rank")


def minimum_interventions(spark, folder):
    out = iv.minimum_counterfactual(_rule_rows(spark, folder), "session_id", RULE_FEATURES, rule_scorer)
    return out.select("session_id", F.array_join("applied", ",").alias("applied"), F.round("baseline_prob", 6).alias("baseline_prob"), F.round("final_prob", 6).alias("final_prob"), "reached_target")


def training_statistics(spark, folder):
    live = settle(_sessions(spark, folder).select(*schemas.MONITORED_FEATURES), "sessions")
    stats = mo.training_stats(live, schemas.MONITORED_FEATURES)
    return stats.select("feature", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p05", "p50", "p95")])


def value_quantiles(spark, folder):
    events = t.table(spark, folder, "events")
    out = exact_quantiles(events, "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["event_type"])
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("p05", "p50", "p95")])


def session_drift(spark, folder):
    live = settle(_sessions(spark, folder).select("session_id", *schemas.MONITORED_FEATURES), "sessions")
    stats = mo.training_stats(live, schemas.MONITORED_FEATURES)
    report = mo.drift_report(mo.drift_cells(live, "session_id", schemas.MONITORED_FEATURES, stats), "session_id")
    return report.select("session_id", F.round("max_abs_z", 6).alias("max_abs_z"), F.array_join("features_flagged", ",").alias("flagged"), "verdict")


def _attributed(spark, folder) -> DataFrame:
    rows = settle(_rule_rows(spark, folder), "sessions")
    return at.linear_attributions(rows, "session_id", dc.dropoff_terms(), V.DROPOFF_WEIGHTS, V.DROPOFF_INTERCEPT)


def rule_attributions(spark, folder):
    rows = _attributed(spark, folder)
    return rows.select("session_id", F.round("base_logit", 6).alias("base_logit"), F.inline("attributions")).select(
        "session_id", "base_logit", "feature", F.round("value", 6).alias("value"), F.round("feature_value", 6).alias("feature_value"))


def rule_importance(spark, folder):
    return at.global_importance(_attributed(spark, folder)).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


def rule_waterfall(spark, folder):
    path = at.waterfall(_attributed(spark, folder), "session_id", 5)
    return path.groupBy("session_id").agg(
        F.count("*").alias("steps"), F.round(F.max_by("end", "step"), 6).alias("final_logit"), F.max_by("label", "step").alias("strongest"),
        F.max(F.when(F.col("step") == 0, F.col("label"))).alias("first_label"))


def _posting_rows(spark, folder) -> DataFrame:
    """BM25 top twenty of every posting with the risk and attributions of a session."""
    hits = bm25_channel(t.resumes(spark, folder), t.jobs(spark, folder), 20)
    n = t.table(spark, folder, "events").agg(F.max("user_id").alias("m")).first()["m"] + 1
    scored = _attributed(spark, folder).select("session_id", "p", "attributions")
    return settle(hits.withColumn("session_id", (F.col("doc_id") * 31 + F.col("query_id")) % n).join(scored, "session_id"), "postings")


def posting_health(spark, folder):
    out = mo.posting_health(_posting_rows(spark, folder))
    names = ["mean_dropoff_prob", "median_dropoff_prob", "pct_high_risk", "pct_low_risk", "health_score"]
    return out.select("query_id", "n_candidates", *[F.round(c, 6).alias(c) for c in names], "health_band")


def posting_drivers(spark, folder):
    out = mo.posting_drivers(_posting_rows(spark, folder))
    return out.select("query_id", "driver_rank", "feature", "times_in_top_3", F.round("mean_shap", 6).alias("mean_shap"), "direction")


def final_ranking(spark, folder):
    """Semantic score, staying probability and trajectory as one ranking of each pool."""
    fused = fusion.rrf(text_channels(spark, folder, 30), pool=30)
    p = ((F.col("doc_id") * 17 + F.col("query_id") * 29) % 1000) / 1000.0
    traj = ((F.col("doc_id") * 23 + F.col("query_id") * 5) % 1000) / 1000.0
    sem = F.coalesce("dense_score", F.lit(0.0))
    rows = fused.withColumns({"sem": sem, "p": p, "trajectory": traj, "bm25": F.coalesce("bm25_score", F.lit(0.0))})
    final = fusion.final_score(F.col("sem"), F.col("p"), F.col("trajectory"), w_exp=0.2)
    rows = rows.withColumn("final", F.round(final, 9)).withColumn("s", fusion.score_shares(F.col("sem"), F.col("p"), F.col("trajectory"), w_exp=0.2))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), F.asc("rank"))
    return rows.select(
        "query_id", "doc_id", F.row_number().over(order).alias("final_rank"), "final", F.round("bm25", 6).alias("bm25"),
        F.round("s.sem_pct", 6).alias("sem_pct"), F.round("s.stay_pct", 6).alias("stay_pct"), F.round("s.exp_pct", 6).alias("exp_pct"))


def model_comparison(spark, folder):
    """Two intercepts of the rule as two models of the same rows."""
    rows = _rule_rows(spark, folder).withColumns({
        "p": dc.sigmoid(dc.dropoff_logit()), "p_secondary": dc.sigmoid(dc.dropoff_logit(V.DROPOFF_INTERCEPT - 1.0))})
    return rows.select("session_id", F.round("p", 6).alias("p"), F.round("p_secondary", 6).alias("p_secondary"), F.round(F.col("p") - F.col("p_secondary"), 6).alias("delta"))


# ---- offers ---------------------------------------------------------------------------------


def offer_decline(spark, folder):
    rows = t.offers(spark, folder)
    logit = dc.decline_logit(-2.0)
    p = dc.sigmoid(logit)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(logit, 6).alias("logit"), F.round(p, 6).alias("p"), dc.risk_band(F.round(p, 9)).alias("band"))


def offer_drivers(spark, folder):
    rows = t.offers(spark, folder).withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    weights = {n: v[0] for n, v in V.DECLINE_TERMS.items()}
    out = at.linear_attributions(rows, "key", dc.decline_terms(), weights, -2.0)
    return at.global_importance(out).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


def offer_bounds(spark, folder):
    bounds = {k: v for k, v in schemas.OFFER_BOUNDS.items() if k != schemas.OFFER_LABEL}
    return schemas.violations(t.offers(spark, folder), bounds)


def offer_summary(spark, folder):
    rows = t.offers(spark, folder)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in schemas.OFFER_FEATURES])
    return rows.select(F.inline(cells)).groupBy("feature").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.min("v"), 6).alias("low"), F.round(F.max("v"), 6).alias("high"))


def offer_prompts(spark, folder):
    rows = t.offers(spark, folder)
    p = dc.sigmoid(dc.decline_logit(-2.0))
    prompt = phrases.offer_prompt(F.round(p, 6), F.lit("n/a"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.length(prompt).alias("n_chars"), F.md5(prompt).alias("prompt_md5"))


# ---- audits -----------------------------------------------------------------------------------


def group_audit(spark, folder):
    out = fa.audit_groups(t.scored_documents(spark, folder), "lang", min_group_n=20)
    return out.select("group", "n", *[F.round(c, 6).alias(c) for c in ("base_rate", "selection_rate", "tpr", "fpr")])


def group_audit_summary(spark, folder):
    out = fa.audit_summary(fa.audit_groups(t.scored_documents(spark, folder), "lang", min_group_n=20))
    names = ["demographic_parity_diff", "equal_opportunity_diff", "disparate_impact_ratio"]
    return out.select("n_groups", *[F.round(c, 6).alias(c) for c in names], "passes_4_5_rule")


def audit_row_counts(spark, folder):
    return fa.audit_rows(t.scored_documents(spark, folder), "lang", ["en", "fr", "de"])


def gender_distribution(spark, folder):
    """Group counts with the missing group kept, and the positive rate of each."""
    rows = t.scored_documents(spark, folder).withColumn("group", F.when(F.col("lang") != "es", F.col("lang")))
    return rows.groupBy("group").agg(F.count("*").alias("n"), F.round(F.avg(F.col("label").cast("double")), 6).alias("positive_rate"))


def _audited_channels(spark, folder, k=10):
    found = {n: settle(df, n) for n, df in text_channels(spark, folder, 50).items()}
    found["hybrid2"] = fusion.rrf(found)
    rows = None
    for name, ranked in found.items():
        part = ranked.select(F.lit(name).alias("channel"), "query_id", "doc_id", "rank").filter(F.col("rank") <= k)
        rows = part if rows is None else rows.unionByName(part)
    members = t.table(spark, folder, "documents").select("doc_id", "lang")
    return fa.ranking_skew(rows, members, "lang", k, ["channel"])


def ranking_skew(spark, folder):
    out = _audited_channels(spark, folder)
    return out.select("channel", "query_id", "group", *[F.round(c, 6).alias(c) for c in ("corpus_share", "topk_share", "skew", "ndkl")])


def ranking_skew_mean(spark, folder):
    out = fa.mean_skew(_audited_channels(spark, folder), ["channel"])
    return out.select("channel", "group", *[F.round(c, 6).alias(c) for c in ("corpus_share", "topk_share", "skew", "ndkl")])


def proxy_coverage(spark, folder):
    out = fa.proxy_coverage(audit_proxies(spark, folder), {"gender": "unknown", "country": "other"})
    return out.select("proxy", "inferred", "total", F.round("pct", 6).alias("pct"))


# ---- classifier metrics --------------------------------------------------------------------------


def classifier_report(spark, folder):
    out = cm.report(t.scored_documents(spark, folder), ["lang"])
    names = ["roc_auc", "pr_auc", "f1_at_0_5", "f1_optimal", "threshold_optimal", "brier"]
    return out.select("lang", *[F.round(c, 6).alias(c) for c in names], "n")


def confusion_matrix(spark, folder):
    out = cm.confusion_at(t.scored_documents(spark, folder), 0.4)
    return out.select("threshold", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def threshold_sweep(spark, folder):
    out = cm.threshold_counts(t.scored_documents(spark, folder))
    return out.select(F.round("threshold", 6).alias("threshold"), "tp", "fp", "fn", "tn")


def class_balance(spark, folder):
    out = cm.class_balance(t.scored_documents(spark, folder))
    return out.select("n_pos", "n_neg", F.round("pos_weight", 6).alias("pos_weight"))


def extreme_samples(spark, folder):
    """The riskiest, the safest and the most ambiguous row."""
    rows = rule_scorer(_rule_rows(spark, folder)).select("session_id", F.round("p", 9).alias("p"))
    return rows.agg(
        (-F.max(F.struct("p", (-F.col("session_id")).alias("i")))["i"]).alias("riskiest"),
        F.min(F.struct("p", "session_id"))["session_id"].alias("safest"),
        F.min(F.struct(F.round(F.abs(F.col("p") - 0.5), 9), "session_id"))["session_id"].alias("ambiguous"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        session_features, field_states, abandonment_labels, dropoff_risk, intervention_ranking,
        minimum_interventions, training_statistics, value_quantiles, session_drift, rule_attributions,
        rule_importance, rule_waterfall, posting_health, posting_drivers, final_ranking, model_comparison,
        offer_decline, offer_drivers, offer_bounds, offer_summary, offer_prompts, group_audit,
        group_audit_summary, audit_row_counts, gender_distribution, ranking_skew, ranking_skew_mean,
        proxy_coverage, classifier_report, confusion_matrix, threshold_sweep, class_balance, extreme_samples,
    )
}
