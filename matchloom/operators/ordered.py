"""Order statistics that never put a whole group into one task.

Equal values are counted first, so a value that fills a third of the table is a
single row. The distinct values are then spread over value ranges with fixed
bounds; the totals of the ranges before give each range its starting point, and
the running total inside a range is an ordinary window over (group, range).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_range(df: DataFrame, value: str, ranges: int | None = None) -> DataFrame:
    """Adds ``_range``: which of about equally filled value ranges a row is in.

    The bounds become constants of the plan, so every use of it agrees on them. NULL and
    NaN values have no range and are left out.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    numeric = df.withColumn("_value", F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).filter(F.col("_value").isNotNull())
    cuts = [i / ranges for i in range(1, ranges)]
    bounds = sorted(set(numeric.approxQuantile("_value", cuts, 1.0 / (4 * ranges)))) if cuts else []
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return numeric.drop("_value").withColumn("_range", F.lit(0.0))
    return Bucketizer(splits=splits, inputCol="_value", outputCol="_range").transform(numeric).drop("_value")


def running_totals(
    df: DataFrame, value: str, totals: dict[str, Column], keys: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """One row per (keys, value) with each total, and around it the totals of its group.

    ``totals`` maps a name to an aggregate Column. Added per name are
    ``<name>_below``, the total over all lower values, and ``<name>_all``.
    """
    keys = keys or []
    counted = with_range(df.filter(F.col(value).isNotNull()), value, ranges).groupBy(*keys, "_range", value).agg(
        *[c.alias(n) for n, c in totals.items()]
    )
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*keys, "_range").agg(*[F.sum(n).alias(n) for n in totals]).select(
        *[F.col(c).alias(f"_{c}") for c in keys], F.col("_range").alias("_start_range"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}_start") for n in totals],
        *[F.sum(n).over(group).alias(f"{n}_all") for n in totals],
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.withColumns({f"_{n}_in": F.coalesce(F.sum(n).over(inside), F.lit(0)) for n in totals})
    same = [F.col("_range") == F.col("_start_range"), *[F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]]
    return summed.join(starts, same).select(
        *keys, value, *totals,
        *[(F.col(f"_{n}_in") + F.col(f"_{n}_start")).alias(f"{n}_below") for n in totals],
        *[f"{n}_all" for n in totals],
    )


def exact_quantiles(
    df: DataFrame, value: str, quantiles: dict[str, float], keys: list[str] | None = None,
) -> DataFrame:
    """Each group's exact quantiles with linear interpolation; NULL values are left out."""
    ranked = running_totals(df, value, {"n": F.count("*")}, keys)

    def at(place: Column) -> Column:
        holds = (F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n"))
        return F.max(F.when(holds, F.col(value).cast("double")))

    columns = []
    for name, p in quantiles.items():
        place = (F.col("n_all") - 1) * F.lit(float(p))
        low, high = at(F.floor(place)), at(F.ceil(place))
        share = F.max(place) - F.floor(F.max(place))
        columns.append((low + (high - low) * share).alias(name))
    return ranked.groupBy(*(keys or [])).agg(*columns)


def value_at(ranked: DataFrame, value: str, place: Column) -> Column:
    """Aggregate over ``running_totals`` rows: the value at a 0-based place (total ``n``)."""
    holds = (F.col("n_below") <= place) & (place < F.col("n_below") + F.col("n"))
    return F.max(F.when(holds, F.col(value)))


def shuffled_positions(df: DataFrame, id_col: str, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Adds ``position`` (from 0) and ``size`` of a seeded shuffle, within the keys.

    The order is that of a hash of the id, so it does not depend on partitions.
    Hashes are even: the 4096 ranges of their top bits need no sampled bounds.
    """
    keys = keys or []
    hashed = df.withColumn("_hash", F.xxhash64(F.col(id_col), F.lit(seed)))
    hashed = hashed.withColumn("_range", F.shiftright("_hash", 52))
    counts = hashed.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(group).alias("size"),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy("_hash", id_col)
    placed = hashed.withColumn("_in", F.row_number().over(inside) - 1)
    return (
        placed.join(starts, [*keys, "_range"])
        .withColumn("position", F.col("_in") + F.col("_start"))
        .drop("_hash", "_range", "_in", "_start")
    )
