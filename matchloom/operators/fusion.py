"""Rank fusion, rerank, structured filters and list overlap.

Channels are tables (query_id, doc_id, score, rank); every list a window sorts
is already cut to its pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import strip

RRF_SMOOTHING = 60


def _one_row_per_document(channels: dict[str, DataFrame]) -> DataFrame:
    stacked = None
    for name, hits in channels.items():
        part = hits.select("query_id", "doc_id", F.lit(name).alias("channel"), "score", "rank")
        stacked = part if stacked is None else stacked.unionByName(part)
    per_channel = []
    for name in channels:
        own = F.col("channel") == name
        per_channel += [
            F.max(F.when(own, F.col("rank"))).alias(f"{name}_rank"),
            F.max(F.when(own, F.col("score"))).alias(f"{name}_score"),
        ]
    return stacked.groupBy("query_id", "doc_id").agg(*per_channel)


def rrf(
    channels: dict[str, DataFrame],
    weights: dict[str, float] | None = None,
    k_smooth: int = RRF_SMOOTHING,
    pool: int | None = None,
) -> DataFrame:
    """Weighted reciprocal-rank fusion that keeps each channel's score.

    Equal sums are settled by the earliest channel that holds the document and
    its rank there.
    """
    if weights is not None and set(weights) != set(channels):
        raise ValueError(f"weights for {sorted(weights)} do not fit channels {sorted(channels)}")
    wide = _one_row_per_document(channels)
    total: Column = F.lit(0.0)
    for name in channels:
        weight = 1.0 if weights is None else weights[name]
        total = total + F.coalesce(F.lit(weight) / (F.lit(k_smooth) + F.col(f"{name}_rank")), F.lit(0.0))
    ties = [F.col(f"{name}_rank").asc_nulls_last() for name in channels]
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), *ties)
    fused = wide.withColumn("rrf_score", total).withColumn("rank", F.row_number().over(order))
    return fused if pool is None else fused.filter(F.col("rank") <= pool)


def rerank(pool: DataFrame, beta: float = 0.7, trajectory: str = "trajectory") -> DataFrame:
    """Blend of 1/position in the pool and the trajectory score."""
    if not 0.0 <= beta <= 1.0:
        raise ValueError(f"beta must be in [0, 1], got {beta}")
    score = F.lit(beta) * (1.0 / F.col("rank")) + F.lit(1.0 - beta) * F.col(trajectory)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("position"))
    return (
        pool.withColumn("score", score)
        .withColumnRenamed("rank", "position")
        .withColumn("rank", F.row_number().over(order))
    )


def final_score(
    sem: Column, p_dropoff: Column, trajectory: Column,
    w_sem: float = 0.6, w_stay: float = 0.4, w_exp: float = 0.0,
) -> Column:
    return F.lit(w_sem) * sem + F.lit(w_stay) * (1.0 - p_dropoff) + F.lit(w_exp) * trajectory


def score_shares(
    sem: Column, p_dropoff: Column, trajectory: Column,
    w_sem: float = 0.6, w_stay: float = 0.4, w_exp: float = 0.0,
) -> Column:
    """What each term adds to the final score, and its percentage of the whole."""
    terms = {"sem": F.lit(w_sem) * sem, "stay": F.lit(w_stay) * (1.0 - p_dropoff), "exp": F.lit(w_exp) * trajectory}
    total = F.greatest(F.lit(1e-6), terms["sem"] + terms["stay"] + terms["exp"])
    return F.struct(
        *[c.alias(f"{n}_part") for n, c in terms.items()],
        *[(100 * c / total).alias(f"{n}_pct") for n, c in terms.items()],
    )


def renumber(ranked: DataFrame) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("rank")
    return ranked.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")


def passes_filters(
    years: Column, min_years: Column, place: Column, wanted_place: Column,
    skills: Column, certifications: Column,
) -> Column:
    """Experience, place and certifications; whatever is unknown passes."""
    def plain(c: Column) -> Column:
        return F.lower(strip(F.coalesce(c, F.lit(""))))

    here, there = plain(place), plain(wanted_place)
    held = F.transform(F.coalesce(skills, F.array().cast("array<string>")), plain)
    needed = F.transform(F.coalesce(certifications, F.array().cast("array<string>")), plain)
    return (
        F.coalesce(years >= min_years, F.lit(True))
        & (F.contains(here, there) | F.contains(there, here))
        & (F.size(F.array_except(needed, held)) == 0)
    )


def list_overlap(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Jaccard of two top-k lists per query; two empty lists agree."""
    def top(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_set("doc_id").alias(name))

    both = top(a, "a").join(top(b, "b"), "query_id", "full_outer")
    size_union = F.size(F.array_union("a", "b"))
    jaccard = F.when(size_union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / size_union)
    return both.withColumns({
        "a": F.coalesce("a", F.array().cast(both.schema["a"].dataType)),
        "b": F.coalesce("b", F.array().cast(both.schema["b"].dataType)),
    }).select("query_id", jaccard.alias("jaccard"))
