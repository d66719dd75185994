"""Ranking quality over graded relevance (query_id, doc_id, grade)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ordered import running_totals, value_at


def _gain(grade: Column, position: Column) -> Column:
    return F.when(grade > 0, (F.pow(F.lit(2.0), grade) - 1) / F.log2(position + 1)).otherwise(0.0)


def per_query_metrics(ranked: DataFrame, qrels: DataFrame, ks: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, query_id, k, precision, recall, ndcg, rr) for every labelled query.

    ``ranked`` may hold several retrievers, told apart by the ``by`` columns. The
    reciprocal rank looks at the whole fetched list, the rest at its first k.
    """
    if not ks or min(ks) <= 0:
        raise ValueError("every k must be positive")
    by = by or []
    deepest = max(ks)
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    best = qrels.filter(F.col("grade") > 0).select(
        "query_id", "grade", F.row_number().over(order).alias("place")
    ).filter(F.col("place") <= deepest)
    relevant = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("n_relevant"))
    ideal = best.groupBy("query_id").agg(*[
        F.sum(F.when(F.col("place") <= k, _gain(F.col("grade"), F.col("place"))).otherwise(0.0)).alias(f"ideal_{k}")
        for k in ks
    ])
    graded = ranked.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    hit = F.coalesce(F.col("grade"), F.lit(0.0)) > 0
    sums = [F.min(F.when(hit, F.col("rank"))).alias("first_hit")]
    for k in ks:
        inside = hit & (F.col("rank") <= k)
        sums.append(F.count_if(inside).alias(f"hits_{k}"))
        sums.append(F.sum(F.when(inside, _gain(F.col("grade"), F.col("rank"))).otherwise(0.0)).alias(f"dcg_{k}"))
    scored = (
        graded.groupBy(*by, "query_id").agg(*sums)
        .join(relevant, "query_id").join(ideal, "query_id", "left")
    )
    rows = F.array(*[
        F.struct(
            F.lit(k).alias("k"),
            (F.col(f"hits_{k}") / k).alias("precision"),
            F.when(F.col("n_relevant") > 0, F.col(f"hits_{k}") / F.col("n_relevant")).otherwise(0.0).alias("recall"),
            F.when(F.col(f"ideal_{k}") > 0, F.col(f"dcg_{k}") / F.col(f"ideal_{k}")).otherwise(0.0).alias("ndcg"),
            F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("rr"),
        )
        for k in ks
    ])
    return scored.select(*by, "query_id", F.inline(rows))


def mean_metrics(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    return per_query.groupBy(*(by or []), "k").agg(
        F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"),
        F.avg("ndcg").alias("mean_ndcg"), F.avg("rr").alias("mrr"), F.count("*").alias("n_queries"),
    )


def spread_of(df: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Mean, median, and the values at places n//10 and 9n//10 - 1 of each group."""
    ranked = running_totals(df, value, {"n": F.count("*")}, keys)
    size = F.col("n_all")
    ninth = F.greatest(F.lit(0), F.floor(size * 9 / 10) - 1)
    low, high = F.floor((size - 1) / 2), F.floor(size / 2)
    return ranked.groupBy(*keys).agg(
        (F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"),
        ((value_at(ranked, value, low) + value_at(ranked, value, high)) / 2).alias("median"),
        value_at(ranked, value, F.floor(size / 10)).alias("p10"),
        value_at(ranked, value, ninth).alias("p90"),
    )


def rank_of(documents: DataFrame, scored: DataFrame, salts: int | None = None) -> DataFrame:
    """Full-corpus rank of chosen (query_id, doc_id): one more than the rows ahead of it.

    Counting needs no sort of the corpus. ``scored`` is (query_id, doc_id, score);
    one query's rows are spread over salts, so they are never one join key.
    """
    salts = salts or int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = (
        documents.join(scored, ["query_id", "doc_id"])
        .select("query_id", F.col("doc_id").alias("own_id"), F.col("score").alias("own_score"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    ahead = (F.col("score") > F.col("own_score")) | (
        (F.col("score") == F.col("own_score")) & (F.col("doc_id") < F.col("own_id"))
    )
    return (
        scored.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
        .join(own, ["query_id", "salt"])
        .groupBy("query_id", F.col("own_id").alias("doc_id"))
        .agg((F.count_if(ahead) + 1).alias("rank"), F.max("own_score").alias("score"))
    )
