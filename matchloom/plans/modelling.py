"""Trained models of drop-off and offer decline: quality, predictions and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.functions import decisions as dc, vocab as V
from matchloom.operators import attributions as at, classifier_metrics as cm, features as fe, models as mo, search as sr, simulate as sim, staged as st, tree_attributions as ta
from matchloom.plans import tables as t
from matchloom.plans.retrieval import bm25_channel, dense_channel
from matchloom.session import scratch_path, settle
from matchloom.sources import artefacts

#: Rounds at most, depth and step; the validation rows end the rounds.
OFFER_BOOST = {"trees": 300, "depth": 5, "step": 0.06}
DROPOFF_BOOST = {"trees": 400, "depth": 6, "step": 0.05}
OFFER_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
OFFER_NUMERIC = [c for c in schemas.OFFER_FEATURES if c not in schemas.OFFER_CATEGORICAL]
DROPOFF_NUMERIC = [c for c in schemas.DROPOFF_FEATURES if c not in schemas.DROPOFF_CATEGORICAL]
PAIR_DEPTH, LEXICAL_DEPTH = 30, 200


def with_split(df: DataFrame, draw) -> DataFrame:
    return df.withColumn("split", F.when(draw < 0.70, "train").when(draw < 0.85, "val").otherwise("test"))


def labelled_offers(spark, folder) -> DataFrame:
    """Offers with a decline drawn by the rule at a mean rate of 18 percent, and a split; settled.

    They are dealt by order: lines that are read as one row group would else stay in one task in all that follows.
    """
    rows = t.offers(spark, folder)
    base = sim.solve_base_logit(rows.select(dc.decline_logit().alias("logit")), 0.18)
    d = sim.Draws(42, F.lit("decline"), *[F.col(c) for c in OFFER_KEYS])
    declined = d.uniform() < dc.sigmoid(dc.decline_logit(base))
    labelled = with_split(rows.withColumn(schemas.OFFER_LABEL, declined.cast("int")), d.uniform())
    return settle(labelled.repartition("l_orderkey"), "offers")


def labelled_pairs(spark, folder) -> DataFrame:
    """Each posting with its best candidates, a drawn session and the label of the drop-off rule; settled."""
    resumes, jobs = t.resumes(spark, folder), t.jobs(spark, folder)
    pairs = fe.candidate_pairs(dense_channel(resumes, jobs, PAIR_DEPTH), bm25_channel(resumes, jobs, LEXICAL_DEPTH))
    # the pairs are read twice, for the candidates that occur and for their rows: unsettled, both channels would run twice
    rows = settle(fe.pair_rows(settle(pairs, "hits"), resumes, jobs), "pairs")
    d = sim.Draws(42, F.lit("label"), F.col("job_id"), F.col("resume_id"))
    drawn = fe.feature_rows(rows)
    p = dc.sigmoid(dc.dropoff_logit() + d.normal(0.0, V.DROPOFF_NOISE_SD))
    labelled = drawn.withColumn("p_dropoff_true", p).withColumn(schemas.DROPOFF_LABEL, (d.uniform() < F.col("p_dropoff_true")).cast("int"))
    return settle(with_split(labelled, d.uniform()), "dropoff")


def fit_all(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, boost: dict) -> dict[str, mo.Trained]:
    """The linear and the boosted model of the train rows, and the boosted one calibrated on the val rows."""
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    prepared = mo.preprocessor(numeric, categorical).fit(train)
    train, val = (mo.merged(prepared, df, label) for df in (train, val))  # each fit reads equal rows once
    boosted = mo.fit_boosted(prepared, train, val, label, **boost)
    return {"linear": mo.fit_linear(prepared, train, label), "boosted": boosted, "calibrated": mo.calibrated(boosted, val, label)}


def model_quality(rows: DataFrame, found: dict[str, mo.Trained], label: str) -> DataFrame:
    scored = None
    for name, trained in found.items():
        part = trained.score(rows.filter("split <> 'train'")).select(F.lit(name).alias("model"), "split", F.col(label).alias("label"), F.round("p", 6).alias("p"))
        scored = part if scored is None else scored.unionByName(part)
    out = cm.report(settle(scored, "scored"), ["model", "split"])
    names = ["roc_auc", "pr_auc", "f1_at_0_5", "f1_optimal", "threshold_optimal", "brier"]
    return out.select("model", "split", *[F.round(c, 4).alias(c) for c in names], "n")


#: Where a session keeps the offers of a folder and the models fitted on them: the queries below share one fit.
_OFFER_MODELS: dict[tuple[str, str], tuple[DataFrame, str]] = {}


def offer_models(spark, folder) -> tuple[DataFrame, dict[str, mo.Trained]]:
    """The labelled offers and their models, fitted once in a session, saved in the shared folder and loaded from there."""
    key = (spark.sparkContext.applicationId, folder)
    names = ("linear", "boosted", "calibrated")
    if key not in _OFFER_MODELS:
        rows, path = labelled_offers(spark, folder), scratch_path(spark, "offer-models")
        found = fit_all(rows, OFFER_NUMERIC, schemas.OFFER_CATEGORICAL, schemas.OFFER_LABEL, OFFER_BOOST)
        for name in names:
            artefacts.save_trained(found[name], f"{path}/{name}")
        _OFFER_MODELS[key] = (rows, path)
    rows, path = _OFFER_MODELS[key]
    return rows, {name: artefacts.load_trained(f"{path}/{name}") for name in names}


def offer_model_quality(spark, folder):
    rows, found = offer_models(spark, folder)
    return model_quality(rows, found, schemas.OFFER_LABEL)


def offer_presets(spark, folder):
    """The three preset situations under the calibrated model of the folder's offers: probability of a refusal and its band."""
    _, found = offer_models(spark, folder)
    kinds = {c: "double" if isinstance(v, float) else "int" for c, v in V.OFFER_DEFAULTS.items()}
    rows = [(name, *({**V.OFFER_DEFAULTS, **values}[c] for c in kinds)) for name, values in V.OFFER_SCENARIOS.items()]
    presets = spark.createDataFrame(rows, "scenario string, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))
    return found["calibrated"].score(presets).select("scenario", F.round("p", 6).alias("p"), F.round("p_raw", 6).alias("p_raw"), dc.risk_band(F.col("p")).alias("band"))


def _explained(trained: mo.Trained, rows: DataFrame, keys: list[str]) -> DataFrame:
    sources = mo.slot_sources(trained.prepared, OFFER_NUMERIC, schemas.OFFER_CATEGORICAL)
    return ta.tree_attributions(trained.score(rows), [*keys, "p_raw", "p"], trained.classifier, sources)


def offer_model_drivers(spark, folder):
    """Calibrated probability, band and strongest driver of every offer, with the gap between attributions and log-odds."""
    rows, found = offer_models(spark, folder)
    logit = F.col("base_logit") + F.aggregate("attributions", F.lit(0.0), lambda s, a: s + a["value"])
    return _explained(found["calibrated"], rows, OFFER_KEYS).select(
        *OFFER_KEYS, F.round("p", 4).alias("p"), dc.risk_band(F.col("p")).alias("band"),
        F.col("attributions")[0]["feature"].alias("strongest"), F.round(F.abs(dc.sigmoid(logit) - F.col("p_raw")), 6).alias("gap"))


def offer_model_importance(spark, folder):
    rows, found = offer_models(spark, folder)
    counted = rows.groupBy(*schemas.OFFER_FEATURES).agg(F.count("*").alias("n"))  # equal offers have equal attributions
    return at.global_importance(_explained(found["calibrated"], counted, ["n"]), F.col("n")).select("feature", F.round("mean_abs_shap", 4).alias("mean_abs_shap"))


def dropoff_features(spark, folder):
    """The feature row of each posting's best candidates."""
    rows = labelled_pairs(spark, folder)
    return rows.select("job_id", "resume_id", *[F.round(c, 6).alias(c) if rows.schema[c].dataType.typeName() == "double" else F.col(c) for c in schemas.DROPOFF_FEATURES])


def dropoff_model_quality(spark, folder):
    rows = labelled_pairs(spark, folder)
    return model_quality(rows, fit_all(rows, DROPOFF_NUMERIC, schemas.DROPOFF_CATEGORICAL, schemas.DROPOFF_LABEL, DROPOFF_BOOST), schemas.DROPOFF_LABEL)


#: Trials of the parameter search; the first has the parameters of DROPOFF_BOOST.
TUNE_TRIALS = 20
TUNED_REPORT = ["roc_auc", "pr_auc", "f1_at_0_5", "f1_optimal", "threshold_optimal", "brier"]


def tuned_models(rows: DataFrame, numeric: list[str], categorical: list[str], label: str, boost: dict, trials: int, seed: int = 42, at_once: int = 4, space=None):
    """Searches parameters by validation AUC on one settled, once prepared table: all trials, and three models.

    `default` has the parameters of `boost`, `tuned` those of the best trial, and `calibrated` is the tuned one with an
    isotonic calibration on the val rows. A trial's model is kept as fitted: a second fit on the same rows is the same.
    """
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    prepared = mo.preprocessor(numeric, categorical).fit(train)
    ready = settle(st.staged_rows(prepared, train, val, label), "tuning")

    def objective(params):
        fit = st.fit_staged(prepared, ready, seed=seed, **params)
        return (fit.auc if fit.auc is not None else 0.5), fit

    space = space or sr.BOOST_SPACE
    plain = {"minInstancesPerNode": 1, "subsample": 1.0, "features": 1.0, "minInfoGain": 0.0, "minWeightFractionPerNode": 0.0}
    done = sr.search(objective, space, trials, seed, at_once, first={**plain, **boost})
    tuned = sr.best_trial(done).result.trained
    return done, {"default": done[0].result.trained, "tuned": tuned, "calibrated": mo.calibrated(tuned, val, label)}


def trial_rows(spark, done: list[sr.Trial]) -> DataFrame:
    """A row for each trial: its parameters, validation AUC, rounds fitted and kept, and whether it is the best."""
    best = sr.best_trial(done).number
    names = list(sr.BOOST_SPACE)
    rows = [(t.number, *[float(t.params[n]) for n in names], round(t.score, 6), t.result.rounds_fitted, len(t.result.trained.classifier.trees), t.number == best) for t in done]
    columns = ["trial int", *[f"{n} double" for n in names], "val_auc double", "rounds_fitted int", "rounds_kept int", "best boolean"]
    return spark.createDataFrame(rows, ", ".join(columns))


def paired_quality(rows: DataFrame, found: dict[str, mo.Trained], label: str) -> DataFrame:
    """The measures of each model on the val and the test rows, and its AUC over the default model's on the same rows."""
    out = model_quality(rows, found, label)
    base = out.filter("model = 'default'").select("split", F.col("roc_auc").alias("default_auc"))
    return out.join(F.broadcast(base), "split").select("model", "split", *TUNED_REPORT, "n", F.round(F.col("roc_auc") - F.col("default_auc"), 4).alias("auc_over_default"))


_TUNED: dict[tuple[str, str], tuple[DataFrame, list, str]] = {}


def _tuned(spark, folder):
    """The search on the folder's pairs, run once in a session; its models are saved and read back."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _TUNED:
        rows, path = labelled_pairs(spark, folder), scratch_path(spark, "dropoff-tuned")
        done, found = tuned_models(rows, DROPOFF_NUMERIC, schemas.DROPOFF_CATEGORICAL, schemas.DROPOFF_LABEL, DROPOFF_BOOST, TUNE_TRIALS)
        for name, trained in found.items():
            artefacts.save_trained(trained, f"{path}/{name}")
        _TUNED[key] = (rows, done, path)
    rows, done, path = _TUNED[key]
    return rows, done, {name: artefacts.load_trained(f"{path}/{name}") for name in ("default", "tuned", "calibrated")}


def dropoff_parameter_trials(spark, folder):
    """Every trial of the parameter search on the drop-off pairs."""
    return trial_rows(spark, _tuned(spark, folder)[1])


def dropoff_tuned_quality(spark, folder):
    """Default, tuned, and tuned and calibrated model on val and test rows."""
    rows, _, found = _tuned(spark, folder)
    return paired_quality(rows, found, schemas.DROPOFF_LABEL)


QUERIES = {
    f.__name__: f
    for f in (offer_model_quality, offer_presets, offer_model_drivers, offer_model_importance, dropoff_features, dropoff_model_quality)
}
