"""Document fingerprints by consistent weighted sampling (DataFrame functions only).

A text is the weighted set of its words, weighted by their counts. For sample k and word t, hashes give r, c ~ Gamma(2, 1)
and b ~ U(0, 1); with q = floor(ln w / r + b) the word's value is ln a = ln c - r (q - b) - r, and the sample is the least
value over the words. Two texts have the same sample with a probability J, their generalised Jaccard similarity, so that a
likeness has a standard error of sqrt(J (1 - J) / samples): at most 0.0625 with 64 samples.

The values a of a word that weighs w are exponential with rate w, so the least of a text of n words lies above x with a
probability of exp(-n x). A bound below a that takes no logarithm leaves out most words that lie above REACH / n. Whether
each least value lies within that reach is looked at afterwards; where one does not, all words are sampled.

Texts are shuffled once, into ranges of doc_id: the text that follows is a window over a range. Words are counted within
the row and sampled where they are, so that a task holds the samples of its documents and no table of words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .store import settle

SAMPLES = 64
REACH = 28.0  # a least value lies beyond it once in 1.4e12 samples
LOWEST = -(1 << 63)
DOC = ("range", "row", "doc_id", "n_chars", "sha")
REACHES = ("reach0", "reach1")


def _uniform(h: Column, shift: int) -> Column:
    return (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def sample_draws(term: Column, k: Column) -> dict[str, Column]:
    """What sample k draws for a word: exp(-r), exp(-c) and b."""
    h, g = F.xxhash64(term, k * 2), F.xxhash64(term, k * 2 + 1)
    return {"u": _uniform(h, 0) * _uniform(h, 21), "x": _uniform(g, 0) * _uniform(g, 21), "b": _uniform(h, 42)}


def may_reach(far: Column, once: Column) -> Column:
    """Whether a word's value may be at most far.

    c = -4 ln y >= 8 (1 - y) / (1 + y) with y the fourth root of x, and exp(-r (q - b + 1)) >= u / w. A word that stands
    once has q = 0, and u^(1 - b) >= u / (1 - b + b sqrt(u))^2. Its far is the reach, that of others the reach times w.
    """
    u, y, b = F.col("u"), F.sqrt(F.sqrt("x")), F.col("b")
    below = 1 - b + b * F.sqrt(u)
    return 8 * (1 - y) * u <= far * (1 + y) * F.when(once, below * below).otherwise(1.0)


def sample_values(log_weights: list[Column]) -> list[Column]:
    """ln a of a word at each of the weights (null where there is none); the draws are common to them."""
    r, b, log_c = -F.log("u"), F.col("b"), F.log(-F.log("x"))
    return [log_c - r * (F.floor(w / r + b) - b) - r for w in log_weights]


def doc_ranges(docs: DataFrame, ranges: int) -> tuple[DataFrame, list[int]]:
    """Adds at (doc_id, null lowest) and range, from quantiles of doc_id, of which the driver gets ranges - 1."""
    keyed = docs.select(F.coalesce(F.col("doc_id"), F.lit(LOWEST)).alias("at"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cuts = keyed.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)] or [0.5], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<bigint>"), lambda c: c <= F.col("at"))) if cuts else F.lit(0)
    return keyed.withColumn("range", place), cuts


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """Adds row (place in the range) and next_text: the text of the row that follows by doc_id, after the last one the first.

    The first row of each range comes once more, behind the last one of the range before it, so that a window over a
    range sees all it needs and no text is sent to other tasks than its own and that one.
    """
    keyed, _ = doc_ranges(docs, ranges)
    everything = Window.orderBy("range")
    firsts = keyed.groupBy("range").agg(F.min("at").alias("at"))  # a row for each range, as in the next two lines
    firsts = firsts.select("range", "at", F.coalesce(F.lag("range").over(everything), F.last("range").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    heads = keyed.join(F.broadcast(firsts), ["range", "at"]).groupBy("before").agg(F.min("text").alias("text"))
    again = heads.select(F.col("before").alias("range"), F.lit(LOWEST).alias("at"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("again"))
    order = Window.partitionBy("range").orderBy("again", "at", "text")
    both = keyed.select("range", "at", "doc_id", "text", F.lit(False).alias("again")).union(again)
    rows = both.select("range", F.row_number().over(order).alias("row"), "doc_id", "text", F.lead("text").over(order).alias("next_text"), "again")
    return rows.filter("not again").drop("again")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, also where body uses it for each element of an array."""
    return F.transform(F.array(value), body)[0]


def word_codes(text: Column, bit: int) -> Column:
    """The hash of each word, its lowest bit replaced. What splitting leaves at the ends has the code of an empty word."""
    return F.transform(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: F.xxhash64(w).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))


def empty_code() -> Column:
    return F.xxhash64(F.lit("")).bitwiseAND(F.lit(-2))


def n_words(codes: Column) -> Column:
    """How many of a text's word codes are of words; an empty one may stand at each end."""
    empty = lambda c: (c.bitwiseAND(F.lit(-2)) == empty_code()).cast("int")
    return F.greatest(F.lit(0), F.size(codes) - empty(F.get(codes, F.lit(0))) - empty(F.get(codes, F.size(codes) - 1)))


def weighed_terms(rows: DataFrame, own: Column, new: Column) -> DataFrame:
    """A row for every distinct word of either text: term, the logarithms w0, w1 of its counts, null where it has none,
    how far its values are looked for (`far`, `once`), and the logarithm of each text's reach.

    The codes of both texts are sorted within the row. The word of an empty text weighs next to nothing, and so stands
    only for a text without words.
    """
    fresh = lambda codes: F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda i: (i == 0) | (F.get(codes, i - 1) != F.get(codes, i)))
    held = let(F.sort_array(F.concat(own, new)), lambda codes: F.struct(codes.alias("codes"), fresh(codes).alias("starts")))
    rows = rows.select(*DOC, *REACHES, held.alias("held")).select(*DOC, *REACHES, F.col("held.codes").alias("codes"), F.col("held.starts").alias("starts"))
    # outer, though no list is empty: else the lists are made once more, for a filter before it
    rows = rows.select("*", F.posexplode_outer("starts").alias("place", "start"))
    size = F.size("codes")
    after, end = F.coalesce(F.get("starts", F.col("place") + 1), size), F.coalesce(F.get("starts", F.col("place") + 2), size)
    code = F.get("codes", F.col("start"))
    first = code.bitwiseAND(F.lit(1)) == 0
    both = first & F.coalesce(F.get("codes", after) == code + 1, F.lit(False))  # the same word of the other text comes next
    follows = ~first & F.coalesce(F.get("codes", F.col("start") - 1) == code - 1, F.lit(False))
    n = after - F.col("start")
    found = rows.filter(~follows).select(*DOC, *REACHES, code.bitwiseAND(F.lit(-2)).alias("term"), F.when(first, n).alias("n0"), F.when(~first, n).when(both, end - after).alias("n1"))
    weight = lambda c: F.when(F.col(c).isNotNull(), F.when(F.col("term") == empty_code(), F.lit(-700.0)).otherwise(F.log(F.col(c).cast("double"))))
    far = F.when(F.col("term") == empty_code(), F.lit(float("inf"))).otherwise(F.greatest(F.col("n0") * F.col("reach0"), F.col("n1") * F.col("reach1")))
    once = (F.coalesce("n0", F.lit(1)) == 1) & (F.coalesce("n1", F.lit(1)) == 1)
    return found.select(*DOC, *[F.log(c).alias(c) for c in REACHES], "term", weight("n0").alias("w0"), weight("n1").alias("w1"), far.alias("far"), once.alias("once"))


def fingerprint_pairs(docs: DataFrame, samples: int = SAMPLES, ranges: int | None = None, reach: float = REACH) -> DataFrame:
    """Per document: samples of its text and of its edited text, and whether all of them are sure to be the least (`sure`).

    The edited text has its last floor(n/2) code points replaced by the first as many of the next document by doc_id. A
    null text is empty; texts without words share one fingerprint; a null doc_id comes first; rows that share a doc_id are
    ordered by text; an empty table gives no rows; other columns are not read. A very long text is one row with its word
    codes, sixteen bytes a word.
    """
    ranges = ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = with_next(docs, ranges).withColumn("edited", edited)
    told = rows.withColumn("n_chars", F.length("text")).withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    told = told.withColumn("codes0", word_codes(F.col("text"), 0)).withColumn("codes1", word_codes(F.col("edited"), 1))
    for name in "01":
        n = n_words(F.col(f"codes{name}"))
        told = told.withColumn(f"reach{name}", F.when(n > 0, reach / n).otherwise(float("inf")))
    # counting the rows that pass ends a compiled stage: words and samples in one method are more than the JVM compiles
    counts = weighed_terms(told, F.col("codes0"), F.col("codes1")).observe(Observation(), F.count(F.lit(1)).alias("terms"))
    tries = counts.withColumn("k", F.explode(F.array(*map(F.lit, range(samples)))))
    # the task's number keeps the filter behind the draws, which are then worked out once
    drawn = tries.select("*", *[v.alias(n) for n, v in sample_draws(F.col("term"), F.col("k")).items()], F.spark_partition_id().alias("task"))
    tested = drawn.filter((F.col("task") >= 0) & (may_reach(F.col("far"), F.col("once")) | (F.col("k") == 0)))  # no text goes missing
    own, new = sample_values([F.col("w0"), F.col("w1")])
    values = tested.select(*DOC, *REACHES, "k", own.alias("a"), new.alias("b"))
    within = [F.bool_or(F.col(c) <= F.col(far) - 1e-9) for c, far in zip("ab", REACHES, strict=True)]
    parts = values.groupBy(*DOC, "k").agg(F.min("a").alias("a"), F.min("b").alias("b"), F.coalesce(within[0] & within[1], F.lit(False)).alias("sure"))
    # 32 bits of each sample are kept, as many as the fingerprint shows
    short = lambda c: signed(F.xxhash64(c).bitwiseAND(F.lit(0xFFFFFFFF)))
    kept = F.sort_array(F.collect_list(F.struct("k", short("a").alias("own"), short("b").alias("new"))))
    found = parts.groupBy(*DOC).agg(kept.alias("kept"), (F.count_if("sure") == samples).alias("sure"))
    return found.select("range", "row", "doc_id", "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), F.col("kept.own").alias("own"), F.col("kept.new").alias("new"), "sure")


def signed(x: Column) -> Column:
    """32 bits as an int."""
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    return same / F.size(a)


def as_text(samples: Column) -> Column:
    """Eight hexadecimal digits for each sample."""
    return F.array_join(F.transform(samples, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES, reach: float = REACH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every document."""
    found = settle(fingerprint_pairs(docs, samples, reach=reach))
    if not found.filter("not sure").isEmpty():
        found = settle(fingerprint_pairs(docs, samples, reach=float("inf")))
    order = Window.partitionBy("range").orderBy("row")
    heads = found.filter("row = 1").select("range", "own")
    everything = Window.orderBy("range")  # a row for each range
    following = heads.select(F.col("range").alias("last_of"), F.coalesce(F.lead("own").over(everything), F.first("own").over(everything)).alias("head"))
    rows = found.withColumn("follower", F.lead("own").over(order))
    rows = rows.withColumn("last_of", F.when(F.col("follower").isNull(), F.col("range"))).join(F.broadcast(following), "last_of", "left")
    after = F.coalesce("follower", "head")
    return rows.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("new")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("new")).alias("near_edited"), likeness(F.col("own"), after).alias("near_next"))
