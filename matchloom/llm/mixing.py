"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a fixed hash. Words are summed by source and leading hash bits; the bucket in which a source's budget
ends is the only one refined by further bits, and the final cut is a filter on the hash: nothing is sorted or collected
but a few sums. Targets that exceed one pass over a source take whole passes first and the hash cut for the rest, so
the sets for smaller budgets are nested in those for larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import free_prefix, settle

WORD = r"[^\x20\x09-\x0D]+"
BITS, LEVELS = 10, 5


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def document_hash(key: Column, seed: int) -> Column:
    """50 bits of a hash of the document's key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - BITS * LEVELS)


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """A row for each source with its size and its 0-based place by code point, null last; no single task sees all of them."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = settle(found.sort(F.col("source").asc_nulls_last()).withColumn("place", F.monotonically_increasing_id()))
    parts = found.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row for each task of the sort
    offsets = parts.select("part", before.alias("offset"))
    local = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    return found.join(offsets, F.shiftright("place", 33) == F.col("part")).select("source", "source_size", (F.col("offset") + local).alias("rank"))


def water_level(sources: DataFrame, max_repeats: int) -> float:
    """Words for one unit of weight once all excess is shared anew; each round sums over the sources."""
    cap = F.col("source_size") * max_repeats
    level, held = 0.0, -1
    while True:
        over = cap < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum("source_size"), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight"))), F.sum(over.cast("long"))).first()
        total, capped, free, n = (x or 0 for x in row)
        if not free or n == held:
            return level if free else float("inf")
        held, level = n, (total - capped) / free


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3) -> DataFrame:
    """Per source: its size, target, whole passes, and the hash below which documents are taken once more.

    sizes: doc columns source, size, h. Weights repeat over the sources in code point order.
    """
    sources = ranked_sources(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = settle(sources.withColumn("weight", weight))
    level = water_level(sources, max_repeats)
    cap = (F.col("source_size") * max_repeats).cast("double")
    target = F.least(cap, F.col("weight") * F.lit(level))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = sources.withColumn("target", target).withColumn("passes", F.least(passes, F.lit(max_repeats)))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size")))
    return settle(refine(sizes, plan.select("source", "source_size", "target", "passes", "rest")))


def refine(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds cut: documents with h below it hold about the rest of the target."""
    state = plan.withColumn("cut", F.lit(0).cast("long"))
    inside = sizes.filter("size > 0").select("source", "size", "h")
    for level in range(1, LEVELS + 1):
        width = 1 << (BITS * (LEVELS - level))
        known = state.select(F.col("source").alias("at"), "cut", "rest")
        joined = inside.join(known, F.col("source").eqNullSafe(F.col("at")))
        if level > 1:  # the boundary bucket alone
            joined = joined.filter((F.col("h") >= F.col("cut")) & (F.col("h") < F.col("cut") + F.lit(width << BITS)))
        sums = joined.groupBy("source", "rest", F.col("cut").alias("base"), ((F.col("h") - F.col("cut")) / F.lit(width)).cast("long").alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))  # at most 2^BITS rows a source
        full = sums.withColumn("run", run).filter("run <= rest")
        # budget ends in the first bucket that does not fit as a whole
        ends = full.groupBy("source").agg(F.max("run").alias("used"))
        first = sums.withColumn("run", run).filter("run > rest").groupBy("source").agg(F.min("bucket").alias("bucket"))
        ends = ends.join(first.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "full")
        ends = ends.select(F.when(F.col("bucket").isNotNull(), F.col("s2")).otherwise(F.col("source")).alias("end_source"), "used", "bucket")
        state = state.join(ends, F.col("source").eqNullSafe(F.col("end_source")), "left")
        everything = F.lit(1 << (BITS * LEVELS)).cast("long")
        moved = F.when(F.col("end_source").isNull(), F.col("cut")).when(F.col("bucket").isNull(), F.when(F.lit(level == 1), everything).otherwise(F.col("cut") + F.lit(width << BITS))).otherwise(F.col("cut") + F.col("bucket") * width)
        state = state.select("source", "source_size", "target", "passes", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), moved.alias("cut"))
        state = settle(state)
    # the last boundary bucket goes in if that brings the source nearer to its target
    known = state.select(F.col("source").alias("at"), "cut")
    edge = inside.join(known, F.col("source").eqNullSafe(F.col("at"))).filter("h = cut").groupBy("source").agg(F.sum("size").alias("edge"))
    state = state.join(edge.withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at")), "left")
    near = F.coalesce(F.col("edge") - F.col("rest") < F.col("rest"), F.lit(False))
    return state.select("source", "source_size", "target", "passes", (F.col("cut") + near.cast("long")).alias("cut"))


def sized(docs: DataFrame, seed: int = 17) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_hash(F.col("doc_id"), seed).alias("h"))


def copies() -> Column:
    return F.col("passes") + (F.col("h") < F.col("cut")).cast("long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """Per document: size, source_size, target (of its source) and taken, the words the mix takes with repeats.

    A null or empty text has size 0; null is a source of its own, last in order; a repeated doc_id shares its fate; a
    source without words has target 0; columns beyond doc_id, text and source are not read; an empty table gives none.
    """
    sizes = settle(sized(docs, seed))
    plan = plan_mix(sizes, weights, max_repeats).withColumnRenamed("source", "at")
    joined = sizes.join(plan, F.col("source").eqNullSafe(F.col("at")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeats: int = 3, seed: int = 17) -> DataFrame:
    """The documents of the mix with all their columns, a row for each time one is taken.

    A text without words adds nothing to a source's words and comes as often as its hash says; other cases are as in
    mix_sources; columns may have any name; long texts are counted where they are.
    """
    own = free_prefix(docs)
    sizes = settle(sized(docs, seed))
    plan = plan_mix(sizes, weights, max_repeats).select(F.col("source").alias(f"{own}at"), F.col("passes").alias(f"{own}passes"), F.col("cut").alias(f"{own}cut"))
    found = docs.join(plan, F.col("source").eqNullSafe(F.col(f"{own}at")))
    times = F.col(f"{own}passes") + (document_hash(F.col("doc_id"), seed) < F.col(f"{own}cut")).cast("long")
    found = found.withColumn(f"{own}times", times.cast("int")).filter(F.col(f"{own}times") > 0)
    return found.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}times")))).select(*docs.columns)
