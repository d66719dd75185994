"""Line dedup by distinct-site spread.

A HyperLogLog sketch of the sites of each line hash is merged by aggregation. Lines well over the threshold are
boilerplate, lines well under it are not, and those near it get an exact distinct count. A boilerplate line stays where it
stands first (by doc_id, then place) and goes everywhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import free_prefix, settle

WORD = r"[^\x20\x09-\x0D]+"


def site_key(site: Column) -> Column:
    """Null is a site of its own."""
    return F.when(site.isNull(), "-").otherwise(F.concat(F.lit("+"), site.cast("string")))


def numbered_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """at (doc_id), digest (of the text), place, line (hash) and site of each line with at least min_words words."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("at"), F.xxhash64(text).alias("digest"), site_key(F.col("source")).alias("site"), F.posexplode(F.split(text, "\n")).alias("place", "said"))
    rows = rows.filter(F.regexp_count("said", F.lit(WORD)) >= min_words)
    return rows.select("at", "digest", "place", F.xxhash64("said").alias("line"), "site")


def spread_lines(lines: DataFrame, min_sites: int, log_k: int = 12, band: float = 0.1) -> DataFrame:
    """The lines on at least min_sites sites. band: how far an estimate may be off (over six standard errors at log_k 12)."""
    estimated = lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_k))).alias("sites"))
    estimated = settle(estimated.filter(F.col("sites") >= (1 - band) * min_sites - 1))
    near = estimated.filter(F.col("sites") <= (1 + band) * min_sites + 1).select("line")
    exact = lines.join(near, "line").select("line", "site").distinct().groupBy("line").count().filter(F.col("count") >= min_sites)
    return settle(estimated.filter(F.col("sites") > (1 + band) * min_sites + 1).select("line").union(exact.select("line")))


def removed_places(docs: DataFrame, min_sites: int, min_words: int) -> DataFrame:
    """at, digest and gone (places of the lines that go), for documents that lose a line."""
    lines = numbered_lines(docs, min_words)
    found = lines.join(spread_lines(lines, min_sites), "line").select("line", "at", "digest", "place")
    first = found.groupBy("line").agg(F.min(F.struct("at", "place")).alias("first"))
    others = found.join(first, "line").filter(~F.struct("at", "place").eqNullSafe(F.col("first")))
    return others.groupBy("at", "digest").agg(F.collect_set("place").alias("gone"))


def dedup_lines(docs: DataFrame, min_sites: int = 10, min_words: int = 3) -> DataFrame:
    """docs with boilerplate lines gone, and __lines, __removed: how many each had and lost.

    Lines of fewer than min_words words are left alone; a null text has no lines and stays null; an empty text has one
    empty line; null sources are one site; rows of one doc_id and text share a fate; an empty table stays empty. Other
    columns stay whatever their names are, but for columns of these two names, which are replaced. Long texts are split
    where they are; only their lines' hashes are shuffled.
    """
    own = free_prefix(docs.drop("__lines", "__removed"))
    at, digest, gone = f"{own}at", f"{own}digest", F.col(f"{own}gone")
    found = removed_places(docs.select("doc_id", "text", "source"), min_sites, min_words).select(F.col("at").alias(at), F.col("digest").alias(digest), F.col("gone").alias(f"{own}gone"))
    keyed = docs.withColumn(f"{own}own", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(f"{own}own") == F.col(digest)), "left")
    lines = F.split("text", "\n")
    kept = F.filter(lines, lambda _, i: ~F.array_contains(gone, i))
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counted = joined.withColumn("__lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
    counted = counted.withColumn("__removed", F.coalesce(F.when(gone.isNotNull(), F.size(gone)), F.lit(0)).cast("long"))
    return counted.withColumn("text", text).select(*[c for c in docs.columns if c not in ("__lines", "__removed")], "__lines", "__removed")


def line_report(docs: DataFrame, min_sites: int = 10, min_words: int = 3) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the digest of the text that is left."""
    found = dedup_lines(docs.select("doc_id", "text", "source"), min_sites, min_words)
    return found.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def without_boilerplate(docs: DataFrame, min_sites: int = 10, min_words: int = 3) -> DataFrame:
    """The documents with boilerplate gone; one that loses all its words to it goes, as every line stays elsewhere.

    Nulls, empty tables, repeated rows, long texts and other columns are as in dedup_lines; all columns come back.
    """
    names = [f"c{k}" for k in range(len(docs.columns))]
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(c).alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("row"))
    found = dedup_lines(whole, min_sites, min_words)
    left = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)) > 0
    columns = [F.col("text").alias(c) if c.lower() == "text" else F.col(f"row.{n}").alias(c) for c, n in zip(docs.columns, names, strict=True)]
    return found.filter((F.col("__removed") == 0) | left).select(*columns)


LINE_SQL = r"""
    WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text, text IS NULL AS void FROM documents),
    split AS (SELECT doc_id, source, void, string_split(text, chr(10)) AS lines FROM docs),
    lines AS (SELECT doc_id, source, unnest(lines) AS line, unnest(range(len(lines))) AS place FROM split),
    long_lines AS (SELECT * FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 3),
    spread AS (SELECT line, min((doc_id, place)) AS first FROM long_lines GROUP BY line HAVING count(DISTINCT coalesce('+' || source, '-')) >= 10),
    gone AS (SELECT doc_id, count(*) AS n, list(place) AS places FROM long_lines JOIN spread USING (line) WHERE (doc_id, place) <> first GROUP BY doc_id)
    SELECT doc_id, CAST(CASE WHEN void THEN 0 ELSE len(lines) END AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed,
        sha256(array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT coalesce(list_contains(places, i), false)], chr(10))) AS kept_sha256
    FROM split LEFT JOIN gone USING (doc_id)
"""
