"""Exact isotonic calibration: pool-adjacent-violators by score ranges.

Equal scores are counted first; no score is rounded. Each range of scores is pooled by itself, and ranges whose border
still falls are pooled in pairs, again and again, until every border rises. A block stays with the range it begins in, so a
task sees the blocks of two ranges at most, and the driver the first and last mean of each range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.ordered import with_range
from matchloom.session import settle

BLOCK_SCHEMA = "_range double, low double, high double, total double, n long"


def pooled(rows: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks by score, joined wherever the mean does not rise."""
    kept: list[list] = []
    for block in rows.sort_values("low")[["_range", "low", "high", "total", "n"]].itertuples(index=False):
        block = list(block)
        while kept and kept[-1][3] * block[4] >= block[3] * kept[-1][4]:
            before = kept.pop()
            block = [before[0], before[1], block[2], before[3] + block[3], before[4] + block[4]]
        kept.append(block)
    return pd.DataFrame(kept, columns=["_range", "low", "high", "total", "n"])


def isotonic_blocks(df: DataFrame, score: str, label: str, ranges: int | None = None, count: str | None = None) -> DataFrame:
    """(low, high, total, n): scores from low to high have the mean label total / n, which rises from block to block.

    Rows without a score or a label are left out; an empty table gives no blocks. A row stands for as many as ``count`` says.
    """
    rows = df.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("label"), (F.lit(1) if count is None else F.col(count)).alias("n")).dropna()
    counted = with_range(rows, "low", ranges).groupBy("_range", "low").agg(F.sum(F.col("label") * F.col("n")).alias("total"), F.sum("n").cast("long").alias("n"))
    singles = counted.select("_range", "low", F.col("low").alias("high"), "total", "n")
    blocks = settle(singles.groupBy("_range").applyInPandas(pooled, BLOCK_SCHEMA), "blocks")
    while True:
        mean = F.struct(F.col("total").alias("total"), F.col("n").alias("n"))
        ends = sorted(blocks.groupBy("_range").agg(F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")).collect())
        pair: dict[float, float] = {}
        for left, right in zip(ends, ends[1:]):
            falls = left["last"]["total"] * right["first"]["n"] >= right["first"]["total"] * left["last"]["n"]
            if falls and left["_range"] not in pair:
                pair |= {left["_range"]: left["_range"], right["_range"]: left["_range"]}
        if not pair:
            return blocks.drop("_range")
        named = F.create_map(*[F.lit(x) for item in pair.items() for x in item])
        dealt = blocks.withColumn("_pair", F.try_element_at(named, F.col("_range")))
        joined = dealt.filter("_pair is not null").groupBy("_pair").applyInPandas(lambda rows: pooled(rows), BLOCK_SCHEMA)
        blocks = settle(dealt.filter("_pair is null").drop("_pair").union(joined), "blocks")


def block_ends(blocks: DataFrame, score: str = "p_raw") -> DataFrame:
    """The blocks as weighed points (score, label, weight): their two ends, between which a curve is level."""
    mean: Column = F.col("total") / F.col("n")
    return blocks.select(F.explode(F.array_distinct(F.array("low", "high"))).alias(score), mean.alias("label"), F.col("n").cast("double").alias("weight"))
