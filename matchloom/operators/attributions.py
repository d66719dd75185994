"""Attributions of linear logits, and what is made of any attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.decisions import sigmoid


def linear_attributions(
    df: DataFrame, key: str, terms: dict[str, Column], weights: dict[str, float], intercept: float,
) -> DataFrame:
    """Exact attributions of a linear logit: weight times distance from the mean.

    (key, base_logit, attributions sorted by size, p); base + sum is the logit.
    The means are one row, read back before the second pass.
    """
    names = list(terms)
    wide = df.select(key, *[terms[n].cast("double").alias(n) for n in names])
    means = wide.agg(*[F.avg(n).alias(n) for n in names]).first().asDict()
    base = float(intercept) + sum(weights[n] * (means[n] or 0.0) for n in names)
    cells = F.array(*[
        F.struct(F.lit(n).alias("feature"), (F.lit(weights[n]) * (F.col(n) - F.lit(means[n]))).alias("value"),
                 F.col(n).alias("feature_value"))
        for n in names
    ])
    ordered = by_magnitude(cells)
    logit = F.aggregate("attributions", F.lit(base), lambda s, a: s + a["value"])
    return wide.select(key, F.lit(base).alias("base_logit"), ordered.alias("attributions")).withColumn("p", sigmoid(logit))


def by_magnitude(cells: Column) -> Column:
    """Attributions by falling size; equal ones keep their place."""
    return F.array_sort(cells, lambda a, b: F.when(F.abs(a["value"]) > F.abs(b["value"]), -1)
                        .when(F.abs(a["value"]) < F.abs(b["value"]), 1).otherwise(0))


def waterfall(rows: DataFrame, key: str, top: int = 8) -> DataFrame:
    """(key, step, label, value, start, end): the path from the base logit to the row's.

    The strongest bars come last; the rest are one bar, and come first.
    """
    kept = F.slice("attributions", 1, top)
    n_rest = F.size("attributions") - F.size(kept)
    rest = F.slice("attributions", top + 1, F.greatest(n_rest, F.lit(1)))
    tail = F.struct(
        F.concat(n_rest.cast("string"), F.lit(" other features")).alias("label"),
        F.aggregate(rest, F.lit(0.0), lambda s, a: s + a["value"]).alias("value"),
    )
    bars = F.transform(kept, lambda a: F.struct(a["feature"].alias("label"), a["value"].alias("value")))
    path = F.reverse(F.when(n_rest > 0, F.concat(bars, F.array(tail))).otherwise(bars))
    steps = rows.select(key, "base_logit", F.posexplode(path).alias("step", "bar"))
    so_far = Window.partitionBy(key).orderBy("step")
    end = F.col("base_logit") + F.sum("bar.value").over(so_far)
    return steps.select(
        key, "step", F.col("bar.label").alias("label"), F.col("bar.value").alias("value"), end.alias("end"),
    ).withColumn("start", F.col("end") - F.col("value"))


def global_importance(rows: DataFrame, weight: Column | None = None) -> DataFrame:
    """(feature, mean_abs_shap); a row counts once, or as its weight says."""
    size, n = F.abs("value"), F.col("_n")
    mean = F.avg(size) if weight is None else F.sum(size * n) / F.sum(n)
    return rows.select(F.inline("attributions"), (F.lit(1) if weight is None else weight).alias("_n")).groupBy("feature").agg(
        mean.alias("mean_abs_shap")
    )
