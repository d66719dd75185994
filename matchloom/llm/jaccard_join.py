"""N-gram Jaccard join with multiple-global-order filtering.

Documents with one set of word shingles are one class, whose smallest doc_id stands for it. Two sets that are similar
enough share a token of their prefixes under every total order of the tokens. Two orders are used, each by another hash,
with very frequent tokens last: a pair is a candidate only if it shares prefix tokens under both. Buckets of a token up to
`crowd` sets yield pairs of fitting sizes; larger ones, which only large groups of like texts have once frequent tokens are
last, yield a link to their smallest member instead of pairs. Connected candidates form groups; groups are verified exactly
from whole sets, large ones in pairs of blocks, and a block pair returns a spanning forest of its links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import mix, shingle_hashes
from .components import components
from .store import settle

ORDERS = (1, 2)
BLOCK = 1024
SALTS = 256
MARKS = 16
TOP = np.uint64(1 << 63)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


class Frequent:
    """A sorted array of tokens with a bit map before it, as most tokens asked for are not in it."""

    def __init__(self, tokens: np.ndarray):
        self.tokens, self.mask = tokens, np.uint64((1 << 23) - 1)
        self.seen = np.zeros(1 << 23, bool)
        self.seen[tokens & self.mask] = True

    def holds(self, tokens: np.ndarray) -> np.ndarray:
        found = self.seen[tokens & self.mask]
        maybe = np.flatnonzero(found)
        if len(maybe):
            place = np.minimum(np.searchsorted(self.tokens, tokens[maybe]), len(self.tokens) - 1)
            found[maybe] = self.tokens[place] == tokens[maybe]
        return found


def prefix(tokens: np.ndarray, order: int, size: int, late: np.ndarray | None = None) -> np.ndarray:
    """The first tokens by (late, hash)."""
    rank = mix(tokens, order) >> np.uint64(1)
    if late is not None and late.any():
        rank = rank | np.where(late, TOP, np.uint64(0))
    size = min(size, len(tokens))
    chosen = np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
    return tokens[chosen], rank[chosen]


def marks(size: int) -> np.ndarray:
    """The places of a prefix whose ranks are kept: MARKS of them, the last one its end."""
    return (size * np.arange(1, MARKS + 1) + MARKS - 1) // MARKS


def rank_marks(rank: np.ndarray) -> bytes:
    return np.sort(rank)[marks(len(rank)) - 1].tobytes()


def frequent_tokens(docs: DataFrame, words: int, num: int, den: int, crowd: int, most: int = 1_000_000) -> np.ndarray:
    """Tokens of more than `crowd` prefix entries; should there be more than `most` of them, the most frequent. Any choice is right as long as all texts share it.

    Counted in prefixes of twice the length, as putting tokens last brings others forward.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch["text"]:
                tokens = shingle_hashes(text if isinstance(text, str) else None, words)
                if len(tokens):
                    found += [prefix(tokens, o, 2 * prefix_length(len(tokens), num, den))[0] for o in ORDERS]
            if found:
                token, n = np.unique(np.concatenate(found), return_counts=True)
                yield pd.DataFrame({"token": token.view(np.int64), "n": n})

    counts = settle(docs.select("text").mapInPandas(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > crowd))
    if counts.count() > most:
        counts = counts.orderBy(F.col("n").desc(), "token").limit(most)
    rows = counts.select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))  # in the order of the hashes as they are compared


def prefixes(docs: DataFrame, words: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """doc_id, n (size of its set), key (hash of the set), the prefix under each order, and ranks at marks of both."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Frequent(frequent)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                tokens = shingle_hashes(text if isinstance(text, str) else None, words)
                n = len(tokens)
                size = prefix_length(n, num, den)
                late = known.holds(tokens)
                both = [prefix(tokens, o, size, late) for o in ORDERS] if n else []
                rows.append((n, xxhash.xxh3_128_digest(tokens.tobytes()), *([t.tobytes() for t, _ in both] or [b""] * 2), b"".join(rank_marks(r) for _, r in both)))
            out = pd.DataFrame(rows, columns=["n", "key", *(f"p{o}" for o in ORDERS), "marks"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n long, key binary, p1 binary, p2 binary, marks binary")


def bucket_pairs(reps: DataFrame, order: int, num: int, den: int, crowd: int) -> DataFrame:
    """a, b, na, nb, times, crowded: pairs of fitting sizes with the number of small buckets they share; of large buckets
    each member b with the smallest one, a (itself for that one), and the number of such buckets."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [np.frombuffer(b, np.int64) for b in batch["p"]]
            times = [len(x) for x in own]
            yield pd.DataFrame({"token": np.concatenate(own) if own else np.zeros(0, np.int64), "sid": np.repeat(batch["sid"].to_numpy(np.int64), times), "n": np.repeat(batch["n"].to_numpy(np.int64), times)})

    def counted(a: list, b: list, na: list, nb: list, crowded: bool) -> pd.DataFrame:
        rows = pd.DataFrame({k: np.concatenate(v) for k, v in {"a": a, "b": b, "na": na, "nb": nb}.items()})
        return rows.groupby(["a", "b", "na", "nb"]).size().rename("times").reset_index().assign(crowded=crowded)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(b["token"].to_numpy(), b["sid"].to_numpy(), b["n"].to_numpy()) for b in batches]
        if not parts:
            return
        token, sid, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        at = np.lexsort((sid, n, token))
        token, sid, n = token[at], sid[at], n[at]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        sizes = np.diff(np.append(first, len(token)))
        big = np.repeat(sizes > crowd, sizes)
        if big.any():
            least = np.repeat(np.minimum.reduceat(sid, first), sizes)
            yield counted([least[big]], [sid[big]], [n[big]], [n[big]], True)
        alone = np.repeat(sizes == 1, sizes) | big
        token, sid, n = token[~alone], sid[~alone], n[~alone]
        found: list[tuple] = []
        for step in range(1, min(crowd, len(token))):  # rows of a bucket go by size: the k-th next ones of all rows at once
            same = token[step:] == token[:-step]
            if not same.any():
                break
            near = same & (den * n[:-step] >= num * n[step:])
            x, y, nx, ny = sid[:-step][near], sid[step:][near], n[:-step][near], n[step:][near]
            swap = x > y
            found.append((np.where(swap, y, x), np.where(swap, x, y), np.where(swap, ny, nx), np.where(swap, nx, ny)))
        if found:
            yield counted(*zip(*found, strict=True), False)

    exploded = reps.select("sid", "n", F.col(f"p{order}").alias("p")).mapInPandas(explode, "token long, sid long, n long")
    parts = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return exploded.repartition(2 * parts, "token").mapInPandas(run, "a long, b long, na long, nb long, times long, crowded boolean")


def candidate_links(reps: DataFrame, num: int, den: int, crowd: int) -> DataFrame:
    """Links a, b so that each similar pair is connected: the meet of the filters of both orders.

    With c common prefix tokens, two sets share at most c tokens and what either has behind its prefix. Tokens of large
    buckets are not counted pair by pair, so as many are allowed for as the set with fewer of them has.
    """
    found = [settle(bucket_pairs(reps, o, num, den, crowd)) for o in ORDERS]
    crowded = [settle(f.filter("crowded").groupBy(F.col("b").alias("sid")).agg(F.sum("times").alias("more"))) for f in found]
    counts = [f.filter("not crowded").select("a", "b", "na", "nb", *(F.when(F.lit(i == k), F.col("times")).otherwise(0).alias(f"c{i}") for i in (0, 1))) for k, f in enumerate(found)]
    pairs = counts[0].union(counts[1]).groupBy("a", "b", "na", "nb").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).filter("a <> b")
    for k in (0, 1):
        for side in "ab":
            pairs = pairs.join(crowded[k].select(F.col("sid").alias(side), F.col("more").alias(f"{side}{k}")), side, "left")
    for k in (0, 1):
        pairs = pairs.withColumn(f"c{k}", F.col(f"c{k}") + F.least(F.coalesce(f"a{k}", F.lit(0)), F.coalesce(f"b{k}", F.lit(0))))
    behind = lambda n: F.ceil(n * num / den) - 1  # noqa: E731  size less the length of the prefix
    rest = F.greatest(behind(F.col("na")), behind(F.col("nb")))
    for k in (0, 1):
        pairs = pairs.filter((F.col(f"c{k}") > 0) & ((F.col(f"c{k}") + rest) * (num + den) >= num * (F.col("na") + F.col("nb"))))
    known = reps.select("sid", "n", "marks")
    for side in "ab":
        own = known.select(F.col("sid").alias(side), F.col("n").alias(f"n{side}"), F.col("marks").alias(f"m{side}"))
        pairs = pairs.join(own, [side, f"n{side}"])

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The bound anew at the lower of both prefix ends: behind it is all that a set has less what its marks show before it."""
        for batch in batches:
            na, nb = batch["na"].to_numpy(np.int64), batch["nb"].to_numpy(np.int64)
            fits = np.ones(len(batch), bool)
            for k in (0, 1):
                ranks = [np.frombuffer(b"".join(batch[c]), np.uint64).reshape(len(batch), -1)[:, k * MARKS : (k + 1) * MARKS] for c in ("ma", "mb")]
                end = np.minimum(ranks[0][:, -1], ranks[1][:, -1])[:, None]
                behind = []
                for n, r in zip((na, nb), ranks, strict=True):
                    size = n - -(-num * n // den) + 1
                    before = (r <= end).sum(1)
                    behind.append(n - np.where(before > 0, (size * before + MARKS - 1) // MARKS, 0))
                fits &= (batch[f"c{k}"].to_numpy(np.int64) + np.minimum(*behind)) * (num + den) >= num * (na + nb)
            yield batch.loc[fits, ["a", "b"]]

    pairs = pairs.select("a", "b", "na", "nb", "c0", "c1", "ma", "mb").mapInPandas(hold, "a long, b long")
    stars = found[0].filter("crowded and a <> b").join(crowded[1].select(F.col("sid").alias("b")), "b", "left_semi")
    return pairs.select("a", "b").union(stars.select("a", "b"))


def forest(sids: np.ndarray, sets: list[np.ndarray], num: int, den: int, most: int = 1 << 22) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * |meet| >= num * |union|, from products of 0/1 matrices in bounded strips of tokens."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(m), n)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    place = np.cumsum(np.concatenate(([0], tokens[1:] != tokens[:-1])))
    shared = np.bincount(place)[place] > 1
    place, owner = place[shared], owner[shared]
    meet = np.zeros((m, m), np.int32)
    if len(place):
        _, place = np.unique(place, return_inverse=True)
        strip = max(1, most // m)
        cuts = np.searchsorted(place, np.arange(0, place[-1] + 1 + strip, strip))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                grid = np.zeros((m, strip if b - a > strip else int(place[b - 1] - place[a]) + 1), np.float32)
                grid[owner[a:b], place[a:b] - place[a]] = 1
                meet += np.rint(grid @ grid.T).astype(np.int32)
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(m):  # a row at a time, as the whole matrix of sums would be several times the size of meet
        row = meet[i, i + 1 :].astype(np.int64)
        for j in i + 1 + np.flatnonzero(den * row >= num * (n[i] + n[i + 1 :] - row)):
            a, b = find(i), find(int(j))
            if a != b:
                root[b] = a
                out.append((int(sids[i]), int(sids[j])))
    return out


def with_large(rows: DataFrame, keys: list[str], large: DataFrame) -> DataFrame:
    """rows (with a node) and the columns of their large group, null for others. Members are dealt by a salt of their node,
    so that no task reads a whole group; groups of over BLOCK members are few enough to come once for each salt."""
    salted = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "salt"], "left").drop("salt")


def verified_links(docs: DataFrame, reps: DataFrame, groups: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Exact links within the groups (node, label). A large group is dealt to pairs of blocks of neighbouring size classes."""
    sizes = groups.groupBy("label").agg(F.count("*").alias("members")).filter(F.col("members") > BLOCK)
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num)) + F.lit(1e-9)).cast("int")
    nodes = with_large(groups, ["label"], sizes).join(reps.select(F.col("sid").alias("node"), "key", "n"), "node").withColumn("c", size_class)
    # similar sets are of one size class or of neighbours; a cell holds two classes of a group, or a small group as a whole
    large = F.col("members").isNotNull()
    cells = nodes.select("label", "node", "key", F.explode(F.when(large, F.array("c", F.col("c") - 1)).otherwise(F.array(F.lit(0)))).alias("c"))
    blocks = cells.groupBy("label", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1")
    count = F.coalesce("blocks", F.lit(1))
    own = F.pmod(F.xxhash64("node"), count).cast("int")
    others = F.transform(F.sequence(F.lit(0), count - 1), lambda j: F.struct(F.col("c"), F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    nodes = with_large(cells, ["label", "c"], blocks).groupBy("label", "node", "key").agg(F.flatten(F.collect_list(others)).alias("cells"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            yield pd.DataFrame({"node": batch["node"], "packed": [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch["text"]]})

    # compressed texts are shuffled, as the hashes of their shingles take several times the room
    texts = docs.select(F.col("doc_id").alias("node"), "text").filter("text is not null and doc_id is not null").mapInPandas(pack, "node long, packed binary")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["node", "key", "packed"]).sort_values("node", kind="stable")
        unpack = zstandard.ZstdDecompressor()
        sids, sets = [], []
        for node, key, packed in zip(rows["node"], rows["key"], rows["packed"], strict=True):
            tokens = shingle_hashes(unpack.decompress(packed).decode("utf-8", "surrogatepass"), words)
            if xxhash.xxh3_128_digest(tokens.tobytes()) == key:  # a row of the same doc_id may hold another text
                sids.append(node)
                sets.append(tokens)
        found = forest(np.array(sids, np.int64), sets, num, den) if len(sids) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    dealt_out = texts.join(nodes, "node").select("label", "node", "key", "packed", F.explode("cells").alias("cell")).select("label", "node", "key", "packed", "cell.*")
    return dealt_out.groupBy("label", "c", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, crowd: int = 64) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id, the smallest doc_id reachable by links (Jaccard >= num / den).

    Words are what ASCII white space parts, with A-Z lowered; a text of fewer words is one shingle. Null texts and texts
    without words have no shingles, link with nothing and are their own component. Rows of one doc_id are one node. Rows
    without doc_id link with nothing and have no component. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    frequent = frequent_tokens(docs, words, num, den, crowd)
    table = settle(prefixes(docs, words, num, den, frequent))
    real = table.filter("n > 0 and doc_id is not null")
    classes = real.groupBy("key").agg(F.min("doc_id").alias("sid"))
    members = settle(real.select("doc_id", "key").join(classes, "key").select("doc_id", "key", "sid"))
    chosen = members.filter("doc_id = sid").select(F.col("doc_id").alias("sid"), "key").distinct()
    reps = real.select(F.col("doc_id").alias("sid"), "n", "key", "p1", "p2", "marks").dropDuplicates(["sid", "key"])
    reps = settle(reps.join(chosen, ["sid", "key"], "left_semi"))
    groups = components(candidate_links(reps, num, den, crowd))
    # rows of one doc_id with several texts hold its classes together
    same = members.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).filter("a <> b").select("a", "b")
    aside = members.filter("doc_id <> sid").select("doc_id", "sid").join(chosen.select(F.col("sid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("sid").alias("b"))
    labels = components(verified_links(docs, reps, groups, words, num, den).union(same).union(aside))
    named = members.join(labels, members["sid"] == labels["node"], "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "sid")).alias("component_id"))
    out = table.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that stand for their component: those whose doc_id it bears. Rows without doc_id all stay."""
    found = near_duplicates(docs, words, num, den).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
