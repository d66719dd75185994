"""Exact binary-classifier metrics over (label, p) rows, at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.ordered import running_totals

# The grid steps are sums, not rounded decimals: 0.05 + i * 0.01.
THRESHOLDS = [0.05 + i * 0.01 for i in range(91)]


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)


def ranking_quality(df: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """ROC-AUC with ties counted half, and average precision in steps of the score."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    steps = running_totals(df, p, {"pos": pos, "neg": neg}, by)
    wins = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    taken_pos = F.col("pos_all") - F.col("pos_below")
    taken = taken_pos + F.col("neg_all") - F.col("neg_below")
    n_pos, n_neg = F.max("pos_all"), F.max("neg_all")
    return steps.groupBy(*(by or [])).agg(
        F.when((n_pos > 0) & (n_neg > 0), wins / (n_pos * n_neg)).alias("roc_auc"),
        F.when(n_pos > 0, F.sum(F.col("pos") * taken_pos / taken) / n_pos).alias("pr_auc"),
    )


def threshold_counts(df: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """(by, threshold, tp, fp, fn, tn) over the threshold grid.

    Rows are counted into the 92 slots between thresholds in one pass; the grid
    is never crossed with the rows.
    """
    by = by or []
    edges = F.array(*[F.lit(t) for t in THRESHOLDS])
    slot = F.size(F.filter(edges, lambda t: t <= F.col(p)))
    slots = df.groupBy(*by, slot.alias("slot")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    # Every slot must be present; empty ones come from the grid itself.
    grid = slots.select(*by).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(len(THRESHOLDS)))))
    filled = grid.join(slots, [*by, "slot"], "left").fillna(0, ["pos", "neg"]) if by else (
        df.sparkSession.range(len(THRESHOLDS) + 1).select(F.col("id").cast("int").alias("slot"))
        .join(slots, "slot", "left").fillna(0, ["pos", "neg"])
    )
    above = Window.partitionBy(*by).orderBy(F.desc("slot"))
    whole = Window.partitionBy(*by)
    return (
        filled.select(
            *by, "slot", F.sum("pos").over(above).alias("tp"), F.sum("neg").over(above).alias("fp"),
            F.sum("pos").over(whole).alias("n_pos"), F.sum("neg").over(whole).alias("n_neg"),
        )
        .filter(F.col("slot") > 0)
        .select(
            *by, F.element_at(edges, F.col("slot")).alias("threshold"), "tp", "fp",
            (F.col("n_pos") - F.col("tp")).alias("fn"), (F.col("n_neg") - F.col("fp")).alias("tn"),
        )
    )


def best_threshold(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The lowest threshold of the grid with the best F1; (0, 0.5) where every F1 is 0."""
    f1 = _f1(F.col("tp"), F.col("fp"), F.col("fn"))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))
    return counts.groupBy(*(by or [])).agg(best.alias("b")).select(
        *(by or []), F.col("b.f1").alias("f1_optimal"),
        F.when(F.col("b.f1") > 0, -F.col("b.t")).otherwise(0.5).alias("threshold_optimal"),
    )


def confusion_at(df: DataFrame, threshold: float, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    said, is_pos = F.col(p) >= threshold, F.col(label) == 1
    counted = df.groupBy(*(by or [])).agg(
        F.count_if(said & is_pos).alias("tp"), F.count_if(said & ~is_pos).alias("fp"),
        F.count_if(~said & ~is_pos).alias("tn"), F.count_if(~said & is_pos).alias("fn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(
        *(by or []), F.lit(float(threshold)).alias("threshold"), "tp", "fp", "tn", "fn",
        F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"),
        F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def report(df: DataFrame, by: list[str] | None = None, label: str = "label", p: str = "p") -> DataFrame:
    """One row per model and split: AUCs, F1 at 0.5, best F1 and its threshold, Brier, n."""
    by = by or ["_all"]
    rows = df if "_all" not in by else df.withColumn("_all", F.lit(0))
    error = F.col(p) - F.col(label)
    basic = rows.groupBy(*by).agg(F.avg(error * error).alias("brier"), F.count("*").alias("n"))
    at_half = confusion_at(rows, 0.5, by, label, p).select(*by, F.col("f1").alias("f1_at_0_5"))
    best = best_threshold(threshold_counts(rows, by, label, p), by)
    out = ranking_quality(rows, by, label, p).join(at_half, by).join(best, by).join(basic, by)
    return out.drop("_all")


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(pos.alias("n_pos"), neg.alias("n_neg"),
                  (neg / F.greatest(F.lit(1), pos)).alias("pos_weight"))
