"""Drift of live sessions against training data, and the health of a posting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.decisions import health_band, health_score
from matchloom.operators.ordered import exact_quantiles

QUANTILES = {"p05": 0.05, "p50": 0.50, "p95": 0.95}


def _long(df: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keys, F.inline(cells))


def training_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, mean, std, p05, p50, p95); a feature without spread gets std 1."""
    long = _long(df, features, [])
    moments = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    ).select("feature", "mean", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0).alias("std"))
    return moments.join(exact_quantiles(long, "value", QUANTILES, ["feature"]), "feature")


def drift_cells(live: DataFrame, key: str, features: list[str], stats: DataFrame, z_threshold: float = 2.0) -> DataFrame:
    """(key, feature, live, z, flagged); a missing live value counts as the mean."""
    cells = _long(live, features, [key]).join(F.broadcast(stats), "feature")  # a row for each feature
    z = (F.coalesce("value", "mean") - F.col("mean")) / F.col("std")
    return cells.select(
        key, "feature", F.coalesce("value", "mean").alias("live"), "mean", "std",
        z.alias("z_score"), (F.abs(z) > z_threshold).alias("flagged"),
    )


def drift_report(cells: DataFrame, key: str) -> DataFrame:
    n = F.count_if("flagged")
    return cells.groupBy(key).agg(
        F.max(F.abs("z_score")).alias("max_abs_z"),
        F.array_sort(F.collect_list(F.when(F.col("flagged"), F.col("feature")))).alias("features_flagged"),
        F.when(n == 0, "in_distribution").when(n == 1, "one_feature_drifting")
        .otherwise("multiple_features_drifting").alias("verdict"),
    )


def posting_health(rows: DataFrame, job: str = "query_id", p: str = "p") -> DataFrame:
    """Risk profile of each posting over its scored candidates, of any number."""
    risk = F.col(p)
    basic = rows.groupBy(job).agg(
        F.count("*").alias("n_candidates"), F.avg(risk).alias("mean_dropoff_prob"),
        F.avg((risk >= 0.60).cast("double")).alias("pct_high_risk"),
        F.avg((risk < 0.30).cast("double")).alias("pct_low_risk"),
    )
    median = exact_quantiles(rows, p, {"median_dropoff_prob": 0.5}, [job])
    score = health_score(F.col("mean_dropoff_prob"))
    return basic.join(median, job).withColumn("health_score", score).withColumn("health_band", health_band(score))


def posting_drivers(
    rows: DataFrame, job: str = "query_id", position: str = "rank",
    attributions: str = "attributions", top: int = 5,
) -> DataFrame:
    """The features most often among a candidate's three strongest, per posting.

    Equal counts keep the order in which the features first appear down the list.
    """
    three = rows.select(job, F.col(position).alias("_row"), F.posexplode(F.slice(attributions, 1, 3)))
    value = F.col("col.value")
    ups = F.count_if(value > 0)
    counted = three.groupBy(job, F.col("col.feature").alias("feature")).agg(
        F.count("*").alias("times_in_top_3"), F.avg(value).alias("mean_shap"),
        F.when(ups >= F.count("*") - ups, "↑ drop-off").otherwise("↓ drop-off").alias("direction"),
        F.min(F.struct("_row", "pos")).alias("_first"),
    )
    order = Window.partitionBy(job).orderBy(F.desc("times_in_top_3"), F.asc("_first"))
    return counted.withColumn("driver_rank", F.row_number().over(order)).filter(F.col("driver_rank") <= top).drop("_first")
