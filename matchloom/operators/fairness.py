"""Group audits of a classifier and of rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-9


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def audit_groups(
    df: DataFrame, group: str, label: str = "label", p: str = "p",
    threshold: float = 0.5, min_group_n: int = 30, by: list[str] | None = None,
) -> DataFrame:
    """Base, selection, true- and false-positive rate of each group that is large enough."""
    by = by or []
    chosen = F.col(p) >= threshold
    yes, no = F.col(label) == 1, F.col(label) == 0
    n, pos, neg = F.count("*"), F.count_if(yes), F.count_if(no)
    return (
        df.groupBy(*by, F.col(group).alias("group"))
        .agg(
            n.alias("n"),
            F.avg(F.col(label).cast("double")).alias("base_rate"),
            (F.count_if(chosen) / n).alias("selection_rate"),
            _rate(F.count_if(chosen & yes), pos).alias("tpr"),
            _rate(F.count_if(chosen & no), neg).alias("fpr"),
        )
        .filter(F.col("n") >= min_group_n)
    )


def audit_summary(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Parity, opportunity and impact over the groups of an audit; no groups pass."""
    high, low = F.max("selection_rate"), F.min("selection_rate")
    impact = F.when(F.count("*") == 0, 1.0).when(high > 0, low / high).otherwise(0.0)
    return (
        groups.groupBy(*(by or []))
        .agg(
            F.count("*").alias("n_groups"),
            F.coalesce(high - low, F.lit(0.0)).alias("demographic_parity_diff"),
            F.coalesce(F.max("tpr") - F.min("tpr"), F.lit(0.0)).alias("equal_opportunity_diff"),
            impact.alias("disparate_impact_ratio"),
        )
        .withColumn("passes_4_5_rule", F.col("disparate_impact_ratio") >= 0.8)
    )


def audit_rows(df: DataFrame, group: str, allowed: list[str]) -> DataFrame:
    """How many rows an audit keeps and how many it skips for want of a listed group."""
    known = F.coalesce(F.col(group).isin(allowed), F.lit(False))
    return df.agg(F.count_if(known).alias("n_audited"), F.count_if(~known).alias("n_skipped"))


def shares(df: DataFrame, group: str, by: list[str] | None = None) -> DataFrame:
    """(by, group, share). Counts are summed by group before the totals are taken."""
    by = by or []
    counts = df.groupBy(*by, F.col(group).alias("group")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0)))
    return counts.select(*by, "group", (F.col("n") / total).alias("share"))


def ranking_skew(
    ranked: DataFrame, members: DataFrame, group: str, k: int, by: list[str] | None = None,
) -> DataFrame:
    """Per query: each corpus group's share of the top k, its skew, and the query's NDKL.

    ``members`` is the corpus (doc_id, group).
    """
    if k <= 0:
        raise ValueError("k must be positive")
    by = by or []
    key = [*by, "query_id"]
    corpus = shares(members, group).withColumnRenamed("share", "corpus_share")
    top = ranked.filter(F.col("rank") <= k).select(*key, "doc_id", "rank").join(
        members.select("doc_id", F.col(group).alias("group")), "doc_id"
    )
    lists = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "group"))).alias("list"))
    # At most k entries per list: prefix counts are array work on the row.
    heads = F.transform(
        F.sequence(F.lit(1), F.size("list")),
        lambda r: F.struct(r.alias("r"), F.slice("list", F.lit(1), r).alias("head")),
    )
    prefixes = lists.select(*key, F.explode(heads).alias("c")).select(
        *key, F.col("c.r").alias("r"), F.explode("c.head.group").alias("group")
    )
    parts = prefixes.groupBy(*key, "r", "group").agg((F.count("*") / F.first("r")).alias("p"))
    kl = (
        parts.join(corpus, "group", "left")
        .withColumn("term", F.col("p") * F.log(F.col("p") / F.greatest(F.coalesce("corpus_share", F.lit(EPSILON)), F.lit(EPSILON))))
        .groupBy(*key, "r").agg(F.sum("term").alias("kl"))
    )
    weight = 1.0 / F.log2(F.col("r") + 1)
    ndkl = kl.groupBy(*key).agg((F.sum(weight * F.col("kl")) / F.greatest(F.sum(weight), F.lit(EPSILON))).alias("ndkl"))
    in_top = shares(top, "group", key).withColumnRenamed("share", "topk_share")
    # The corpus distribution has one entry per group of the audited attribute.
    groups = corpus.agg(F.collect_list(F.struct("group", "corpus_share"))).scalar()
    return (
        ndkl.withColumn("cells", groups).select(*key, "ndkl", F.inline("cells"))
        .join(in_top, [*key, "group"], "left")
        .withColumn("topk_share", F.coalesce("topk_share", F.lit(0.0)))
        .withColumn("skew", log_ratio(F.col("topk_share"), F.col("corpus_share")))
        .select(*key, "group", "corpus_share", "topk_share", "skew", "ndkl")
    )


def log_ratio(top: Column, corpus: Column) -> Column:
    return F.log(F.greatest(top, F.lit(EPSILON)) / F.greatest(corpus, F.lit(EPSILON)))


def mean_skew(per_query: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares are averaged over queries first; the skew is that of the averages."""
    return (
        per_query.groupBy(*(by or []), "group")
        .agg(F.first("corpus_share").alias("corpus_share"), F.avg("topk_share").alias("topk_share"),
             F.avg("ndkl").alias("ndkl"))
        .withColumn("skew", log_ratio(F.col("topk_share"), F.col("corpus_share")))
    )


def proxy_coverage(df: DataFrame, proxies: dict[str, str]) -> DataFrame:
    """(proxy, inferred, total, pct); ``proxies`` maps a column to its 'not inferred' value."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("proxy"), F.count_if(F.col(c) != none).alias("inferred"), F.count("*").alias("total"))
        for c, none in proxies.items()
    ])
    return df.agg(rows.alias("rows")).select(F.inline("rows")).withColumn(
        "pct", 100.0 * F.col("inferred") / F.greatest(F.col("total"), F.lit(1))
    )
