"""How close a candidate's skills come to the ones a posting requires."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.channels import cosine

MATCHED, ADJACENT, MISSING = "matched", "adjacent", "missing"


def skill_similarities(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(required, held, sim) of the distinct skill pairs that occur; each is computed once."""
    distinct = pairs.select(F.explode("required").alias("required"), "held").select(
        "required", F.explode("held").alias("held")
    ).distinct()
    a = vectors.select(F.col("skill").alias("required"), F.col("vector").alias("a"))
    b = vectors.select(F.col("skill").alias("held"), F.col("vector").alias("b"))
    return distinct.join(a, "required").join(b, "held").select("required", "held", cosine(F.col("a"), F.col("b")).alias("sim"))


def adjacency(
    pairs: DataFrame, keys: list[str], vectors: DataFrame,
    match: float = 0.85, adjacent: float = 0.55,
) -> DataFrame:
    """(keys, required, category, best, similarity) from (keys, required[], held[]).

    Skills are lower-cased strings. A similarity of zero or less finds nothing.
    """
    sims = skill_similarities(pairs, vectors).filter(F.col("sim") > 0)
    needs = pairs.select(*keys, "held", F.posexplode("required").alias("place", "skill"))
    verbatim = F.array_contains("held", F.col("skill"))
    tried = needs.filter(~verbatim).select(
        *keys, "place", F.col("skill").alias("required"), F.posexplode_outer("held").alias("held_place", "held")
    )
    # The first of equally close skills wins.
    closeness = F.struct("sim", (-F.col("held_place")).alias("order"), "held")
    found = tried.join(sims, ["required", "held"], "left").groupBy(*keys, "place", "required").agg(
        F.max(F.when(F.col("sim").isNotNull(), closeness)).alias("best")
    )
    sim = F.coalesce("best.sim", F.lit(0.0))
    category = F.when(sim >= match, MATCHED).when(sim >= adjacent, ADJACENT).otherwise(MISSING)
    same = needs.filter(verbatim).select(
        *keys, "place", F.col("skill").alias("required"), F.lit(MATCHED).alias("category"),
        F.col("skill").alias("best"), F.lit(1.0).alias("similarity"),
    )
    return same.unionByName(found.select(
        *keys, "place", "required", category.alias("category"), F.col("best.held").alias("best"), sim.alias("similarity")
    ))


def coverage(report: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per category and the coverage: matched 1, adjacent 0.6, missing 0."""
    cat = F.col("category")
    weight = F.when(cat == MATCHED, 1.0).when(cat == ADJACENT, 0.6).otherwise(0.0)
    return report.groupBy(*keys).agg(
        F.count_if(cat == MATCHED).alias("n_matched"), F.count_if(cat == ADJACENT).alias("n_adjacent"),
        F.count_if(cat == MISSING).alias("n_missing"), F.avg(weight).alias("coverage_score"),
    )
