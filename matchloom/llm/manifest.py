"""Merkle manifest of a dataset by sibling-shift self-joins (DataFrame functions only).

Rows are leaves, numbered within their group by a key; nodes of a level are numbered 0, 1, 2, ... Each level equijoins its
nodes with themselves by the computed number of a sibling: number XOR 1 in binary trees, otherwise the slots of the run one
after another by their offset. The node of slot zero then emits the parent. The roots of the groups are the leaves of one
more tree, built likewise. Every level is written, with its siblings; going down again, a node's proof is its own siblings
and its parent's proof, so that a level costs one join and all levels together about two rows a leaf.

Numbers come from one range sort of hashes and keys, not of texts: the place in a range and a count of rows for each range
and group. No task holds a group, and the driver gets the size of the largest group and no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import settle

PLACE_BITS = 33  # of monotonically_increasing_id: the place within a partition


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, or a dash; fields can be joined without ambiguity."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)).cast("binary"), 256))


def hash_of(*parts: Column) -> Column:
    """Of digests one after another as hexadecimal text; a part may hold several digests, or none."""
    return F.unhex(F.sha2(F.concat(*[F.lower(F.hex(p)) for p in parts]).cast("binary"), 256))


def numbered(rows: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """Adds i, the number of a row within its group by keys from 0, and n, the rows of the group. Settled.

    Nulls come first, strings go by their bytes. `group` may be null and is one group then.
    """
    order = [F.col(c).asc_nulls_first() for c in (group, *keys)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", PLACE_BITS)
    counts = placed.groupBy(group, part.alias("part")).agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each group and range that meet, which are no more than both together
    starts = counts.select(F.col(group).alias("own"), "part", "first", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"), F.sum("rows").over(Window.partitionBy(group)).alias("n"))
    joined = placed.withColumn("in", part).join(starts, F.col(group).eqNullSafe(F.col("own")) & (F.col("in") == F.col("part")))
    return joined.select(*rows.columns, (F.col("at") - F.col("first") + F.col("before")).alias("i"), "n")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds slot and siblings: the digests of the other nodes of the run, left to right and one after another."""
    nodes = nodes.withColumn("slot", (F.col("i") % arity).cast("int"))
    if arity == 2:
        others = nodes.select("g", F.col("i").bitwiseXOR(F.lit(1)).alias("i"), F.col("h").alias("siblings"))
        return nodes.join(others, ["g", "i"], "left").withColumn("siblings", F.coalesce("siblings", F.lit(b"")))
    for offset in range(1, arity):  # the node asked is `offset` slots on, around the run
        shifted = nodes.select("g", (F.col("i") - F.col("slot") + (F.col("slot") + arity - offset) % arity).alias("i"), F.col("h").alias(f"s{offset}"))
        nodes = nodes.join(shifted, ["g", "i"], "left")
    around = F.array(*[F.struct(((F.col("slot") + o) % arity).alias("k"), F.coalesce(f"s{o}", F.lit(b"")).alias("h")) for o in range(1, arity)])
    joined = F.aggregate(F.array_sort(around), F.lit(b""), lambda all_, x: F.concat(all_, x["h"]))
    return nodes.withColumn("siblings", joined).drop(*[f"s{o}" for o in range(1, arity)])


def parents(level: DataFrame, arity: int) -> DataFrame:
    """Slot-zero rows emit the nodes of the next level: g, i, n (nodes of the group on that level) and h."""
    up = level.filter("slot = 0 and n > 1")
    return up.select("g", F.floor(F.col("i") / arity).alias("i"), F.ceil(F.col("n") / arity).alias("n"), hash_of(F.col("h"), F.col("siblings")).alias("h"))


class Tree:
    """The levels over leaves (g, i, n, h, ...): tables of nodes with slot and siblings. Other columns stay on the leaves."""

    def __init__(self, leaves: DataFrame, arity: int, most: int):
        self.arity, self.levels = arity, [settle(with_siblings(leaves, arity))]
        while most > arity:
            self.levels.append(settle(with_siblings(parents(self.levels[-1], arity), arity)))
            most = -(-most // arity)

    def roots(self) -> DataFrame:
        """g and h of the last node of each group."""
        ends = [self.levels[0].filter("n = 1").select("g", "h")]
        ends += [parents(level.filter(F.col("n") <= self.arity), self.arity).select("g", "h") for level in self.levels]
        return settle(reduce(DataFrame.union, ends))

    def proofs(self, above: DataFrame) -> DataFrame:
        """The leaves with path: (slot, siblings) of every level up to the root. above: g and path of each group's root."""
        known = None
        for depth in range(len(self.levels) - 1, -1, -1):
            level = self.levels[depth]
            keys = [c for c in level.columns if c not in ("slot", "siblings", "h", "n")] if depth else [c for c in level.columns if c not in ("slot", "siblings")]
            own = F.array(F.struct("slot", "siblings"))
            inner = level.filter(F.col("n") > 1).withColumn("up", F.floor(F.col("i") / self.arity))
            tops = level.filter((F.col("n") > 1) & (F.col("n") <= self.arity)).select("g").distinct().join(above, "g").select("g", F.lit(0).cast("long").alias("up"), "path")
            upper = tops if known is None else tops.union(known.select("g", F.col("i").alias("up"), "path"))
            rows = inner.join(upper, ["g", "up"]).select(*keys, F.concat(own, F.col("path")).alias("path"))
            if depth == 0:
                rows = rows.union(level.filter("n = 1").join(above, "g").select(*keys, "path"))
            known = rows if depth % 4 else settle(rows)  # plans of a few joins
        return known


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    width = 32

    def up(h: Column, step: Column) -> Column:
        cut = step["slot"] * width
        left, right = F.substring(step["siblings"], F.lit(1), cut), F.substring(step["siblings"], cut + 1, F.length(step["siblings"]))
        return hash_of(left, h, right)

    return F.aggregate(path, leaf, up)


def build_manifest(docs: DataFrame, group: str, key: str, columns: list[str], arity: int = 2, carry: dict[str, Column] | None = None) -> DataFrame:
    """Per row: key, group, the columns of carry, leaf, subroot, root (digests) and path, its proof from the leaf to the root.

    Leaves hash the named columns and go by key within their group, groups by value; nulls come first, strings go by
    their bytes, equal keys by their leaves. path has an element (slot, siblings) for every level that a node passes: the
    siblings of its run left to right, none for a run of one. A single row is its own root, with an empty path. An empty
    table gives no rows; repeated rows are leaves of their own; long texts are hashed where they are and not shuffled. A
    helper's name that clashes does no harm, as only named columns are read.
    """
    carry = carry or {}
    extra = [f"carry_{k}" for k in range(len(carry))]
    read = docs.select(F.col(key).alias("key"), F.col(group).alias("grp"), row_hash([F.col(c) for c in columns]).alias("h"), *[c.alias(name) for c, name in zip(carry.values(), extra, strict=True)])
    leaves = numbered(read, "grp", ["key", "h"])
    heads = leaves.filter("i = 0").select(F.lit(0).cast("long").alias("zero"), F.col("grp").alias("group_value"), F.col("n").alias("leaves"))
    groups = numbered(heads, "zero", ["group_value"])
    groups = settle(groups.select("group_value", "leaves", F.col("i").alias("g"), F.col("n").alias("groups")))
    sizes = groups.agg(F.max("leaves"), F.max("groups")).first()
    most, count = sizes[0] or 0, sizes[1] or 0
    placed = leaves.join(groups.select("group_value", "g"), F.col("grp").eqNullSafe(F.col("group_value"))).drop("group_value")
    below = Tree(placed, arity, most)
    tops = below.roots().join(groups.select("g", "groups"), "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.col("groups").alias("n"), "h")
    top = Tree(tops, arity, count)
    empty = F.array().cast("array<struct<slot:int,siblings:binary>>")
    root = top.roots().select("g", "h", empty.alias("path"))
    found = root.first()  # one row
    ways = settle(top.proofs(root.select("g", "path")).select(F.col("i").alias("g"), F.col("h").alias("subroot"), "path"))
    rows = below.proofs(ways.select("g", "path")).join(ways.select("g", "subroot"), "g")
    return rows.select(F.col("key").alias(key), F.col("grp").alias(group), F.col("h").alias("leaf"), "subroot", F.lit(bytes(found["h"]) if found else None).cast("binary").alias("root"), "path", *[F.col(name).alias(c) for c, name in zip(carry, extra, strict=True)])


#: crc32 of a decimal is spelled out bit by bit; levels come from a recursive query over all trees at once.
MANIFEST_SQL = r"""
    WITH RECURSIVE told AS (
        SELECT *, CAST(doc_id AS VARCHAR) AS d,
            CASE WHEN doc_id IS NULL THEN NULL ELSE list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
                lambda crc, c: list_reduce(
                    list_prepend(xor(crc, c), [1::BIGINT, 1, 1, 1, 1, 1, 1, 1]),
                    lambda x, one: xor(x >> 1, (x & one) * 3988292384)))
            END AS state
        FROM documents
    ), fields AS (
        SELECT doc_id, lang, coalesce(strlen(d) || ':' || d, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
            coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS size,
            CASE WHEN xor(state, 4294967295) % 7 = 0 THEN coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') END AS changed,
            coalesce(strlen(text) || ':' || text, '-') AS said
        FROM told
    ), hashed AS (
        SELECT doc_id, lang, sha256(head || size || said) AS leaf, coalesce(sha256(head || changed || said), sha256(head || size || said)) AS asked FROM fields
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed
    ), groups AS (
        SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) OVER () AS n_groups FROM (SELECT DISTINCT lang FROM hashed)
    ), placed AS (
        SELECT numbered.*, g, n_groups, row_number() OVER () AS r FROM numbered JOIN groups ON numbered.lang IS NOT DISTINCT FROM groups.lang
    ), low AS (
        SELECT 0 AS k, g, i, n, leaf AS h FROM placed
        UNION ALL
        SELECT k + 1, g, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY k, g, i // 2, n
    ), high AS (
        SELECT 0 AS k, low.g AS i, n_groups AS n, h FROM low JOIN groups ON groups.g = low.g WHERE low.n = 1
        UNION ALL
        SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY k, i // 2, n
    ), steps AS (
        SELECT r, s.k AS k, false AS upper, (placed.i >> s.k) & 1 AS slot, coalesce(o.h, '') AS sibling
        FROM placed JOIN (SELECT DISTINCT g, k FROM low WHERE n > 1) s ON s.g = placed.g
        LEFT JOIN low o ON o.g = placed.g AND o.k = s.k AND o.i = xor(placed.i >> s.k, 1)
        UNION ALL
        SELECT r, s.k, true, (placed.g >> s.k) & 1, coalesce(o.h, '')
        FROM placed CROSS JOIN (SELECT DISTINCT k FROM high WHERE n > 1) s
        LEFT JOIN high o ON o.k = s.k AND o.i = xor(placed.g >> s.k, 1)
    ), proofs AS (
        SELECT r, list(slot ORDER BY upper, k) AS slots, list(sibling ORDER BY upper, k) AS siblings FROM steps GROUP BY r
    ), folds AS (
        SELECT placed.r AS r, 0 AS done, asked AS h, coalesce(slots, []) AS slots, coalesce(siblings, []) AS siblings FROM placed LEFT JOIN proofs ON proofs.r = placed.r
        UNION ALL
        SELECT r, done + 1, sha256(CASE WHEN slots[done + 1] = 1 THEN siblings[done + 1] || h ELSE h || siblings[done + 1] END), slots, siblings FROM folds WHERE done < len(slots)
    )
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(array_to_string(siblings, '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
    FROM placed JOIN folds f ON f.r = placed.r AND f.done = len(f.slots)
    JOIN low s ON s.g = placed.g AND s.n = 1 JOIN high t ON t.n = 1
"""
