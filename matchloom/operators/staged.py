"""Boosting in stages: a tree a round on the residuals, and the validation AUC after each says when to stop."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.classifier_metrics import ranking_quality
from matchloom.operators.models import Trained, class_weights, ensemble
from matchloom.session import discard, scratch_path

BATCH = 10  # rounds between two looks at the validation rows, and between two cuts of the lineage


@dataclass
class Staged:
    """A model cut to its best round, how many rounds were fitted for it, and its validation AUC."""

    trained: Trained
    rounds_fitted: int
    auc: float | None


def staged_rows(prepared: PipelineModel, train: DataFrame, val: DataFrame, label: str) -> DataFrame:
    """What every fit on a split needs: features, y (-1 or 1), weight and whether the row is held out, one table for both."""
    parts = [(class_weights(train, label), False), (val.withColumn("weight", F.lit(1.0)), True)]
    first, second = (
        prepared.transform(df).select("features", (2.0 * F.col(label) - 1.0).alias("y"), F.col("weight").cast("double").alias("weight"), F.lit(held).alias("held"))
        for df, held in parts
    )
    return first.union(second)


def stop_at(aucs: list[float], patience: int) -> tuple[int, bool]:
    """The number of rounds with the greatest AUC (the first of equals), and whether patience has run out since."""
    best = max(range(len(aucs)), key=lambda k: (aucs[k], -k))
    return best + 1, len(aucs) - 1 - best >= patience


def fit_staged(
    prepared: PipelineModel, rows: DataFrame, trees: int = 400, depth: int = 6, step: float = 0.05, seed: int = 42, patience: int = 30,
    subsample: float = 1.0, features: float = 1.0, **options,
) -> Staged:
    """Boosted trees for the log loss on `staged_rows`, ended by the AUC on the held rows.

    Each tree fits 4y / (1 + exp(2ym)) at the margins m so far, and enters with the weight `step`. After each batch the
    held rows are scored at all of its rounds in one pass; rounds end where the best AUC has seen `patience` rounds
    without a better one, so that at most patience + BATCH - 1 rounds are fitted behind it. Margins travel with the rows,
    in a table that each batch writes anew: no round scores the trees of earlier batches again. Without held rows of both
    classes all rounds are fitted and kept. `options` go to the library's tree learner.
    """
    spark = rows.sparkSession
    share = "all" if features >= 1.0 else str(round(features, 4))
    learner = RandomForestRegressor(
        numTrees=1, maxDepth=depth, labelCol="residual", weightCol="weight", predictionCol="step_value", bootstrap=False,
        subsamplingRate=subsample, featureSubsetStrategy=share, **options)
    found, aucs, path, best, over = [], [], None, 0, False
    state = rows.withColumn("margin", F.lit(0.0))
    while len(found) < trees and not over:
        now = state.withColumn("margins", F.array().cast("array<double>"))
        for _ in range(min(BATCH, trees - len(found))):
            residual = 4.0 * F.col("y") / (1.0 + F.exp(2.0 * F.col("y") * F.col("margin")))
            model = learner.setSeed(seed + len(found)).fit(now.filter(~F.col("held")).withColumn("residual", residual))
            found.append(model.trees[0])
            now = model.transform(now).withColumn("margin", F.col("margin") + step * F.col("step_value")).drop("step_value")
            now = now.withColumn("margins", F.concat("margins", F.array("margin")))
        written = scratch_path(spark, "staged")
        now.write.parquet(written)
        whole = spark.read.schema(now.schema).parquet(written)
        each = whole.filter("held").select((F.col("y") > 0).cast("int").alias("label"), F.posexplode("margins").alias("round", "p"))
        told = {r["round"]: r["roc_auc"] for r in ranking_quality(each, ["round"]).collect()}  # a row for each round of the batch
        if path:
            discard(spark, path)
        path, state = written, whole.drop("margins")
        if told and None not in told.values():
            aucs += [told[k] for k in sorted(told)]
            best, over = stop_at(aucs, patience)
    if path:
        discard(spark, path)
    keep = best or len(found)
    slots = found[0].numFeatures
    return Staged(Trained(prepared, ensemble(found[:keep], [step] * keep, slots)), len(found), aucs[keep - 1] if aucs else None)
