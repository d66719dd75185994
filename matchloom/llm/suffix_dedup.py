"""Suffix-array dedup with threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `least` bytes that covers it starts earlier too, in a smaller doc_id or further up. To index only
what can repeat, the windows of `least` bytes are dealt into buckets by the least hash of their GRAM-byte strings, as equal
windows have equal least hashes: a stretch of windows with one least hash is a row (a region: that many windows, and the
bytes that they span). Buckets of one row are done; equal regions of a bucket are one entry, whose first place is kept.
Where regions of a bucket differ, their bytes are joined and suffix sorted, and the common prefix lengths of neighbouring
suffixes come in increasing order: those of length k + 1 are the ones whose intervals, extended backward by a byte, meet a
border of length k. The expansion stops at `least`; ranks without a border between them are equal windows.

A whole text is a region too, so that of a copy in the same task one row is shuffled instead of all its stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import as_bytes, gram_hashes, mix, span_hashes
from .store import settle

GRAM = 40
LOWEST = -(1 << 63)
#: Windows of a row at most; longer stretches are cut.
LONGEST = 4096
#: Bytes suffix sorted at once, and of a bucket's regions. A bucket of more bytes has its windows dealt anew, each by its own hash.
CHUNK = 4 << 20
RUNS = "array<struct<start:bigint,run:bigint>>"


def stretches(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows and least gram hash of each stretch, and whether that gram stands in it more than once (if not, its windows all differ)."""
    n = len(data) - least + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    grams = low = gram_hashes(data, min(GRAM, least))
    span, width = least - min(GRAM, least) + 1, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:n], low[span - width : span - width + n])
    cut = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1, [n]))
    if (np.diff(cut) > LONGEST).any():
        cut = np.unique(np.concatenate([cut, *(np.arange(a, b, LONGEST) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > LONGEST)]))
    start, size, least_hash = cut[:-1], np.diff(cut), low[cut[:-1]]
    within = np.arange(span)
    head = (grams[start[:, None] + within] == least_hash[:, None]).argmax(1)
    tail = (grams[(start + size + span - 2)[:, None] - within] == least_hash[:, None]).argmax(1)
    return start, size, least_hash, start + head != start + size + span - 2 - tail


def equal_windows(data: np.ndarray, least: int) -> np.ndarray:
    """Suffix order, and at each rank the number of borders shorter than least up to it: equal for equal windows."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    known = 8
    while True:
        order = np.argsort(key)
        new = np.empty(n, np.int64)
        ordered = key[order]
        new[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if known >= least:
            break
        tail = np.zeros(n, np.int64)
        tail[: n - known] = new[known:] + 1
        key = (new.astype(np.uint64) << np.uint64(32)) | tail.astype(np.uint64)
        known *= 2
    rank = np.empty(n, np.int32)
    rank[order] = np.arange(n, dtype=np.int32)
    follow = np.append(rank, np.int32(0))[order + 1]  # rank of the suffix without its first byte: the transform's inverse step
    first = data[order]
    border = np.concatenate(([True], first[1:] != first[:-1]))
    border |= np.concatenate(([True], (order[1:] == n - 1) | (order[:-1] == n - 1)))
    open_ranks = np.flatnonzero(~border)
    left, right = follow[open_ranks - 1], follow[open_ranks]
    for _ in range(1, least):  # prefixes of one byte more in each turn
        borders = np.cumsum(border, dtype=np.int32)
        met = borders[left] != borders[right]
        if not met.any():
            break
        border[open_ranks[met]] = True
        stay = ~met
        open_ranks, left, right = open_ranks[stay], left[stay], right[stay]
    return order, np.cumsum(border, dtype=np.int32)


def repeated_windows(regions: list[bytes], at: np.ndarray, start: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """at and start of every window that an earlier one equals. A byte that no UTF-8 text has parts the regions."""
    sizes = np.array([len(r) for r in regions])
    data = np.frombuffer(b"\xff".join(regions) + b"\xff", np.uint8)
    order, cls = equal_windows(data, least)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    window = np.concatenate([np.arange(b, b + s - least + 1) for b, s in zip(begins, sizes, strict=True)])
    owner = np.repeat(np.arange(len(regions)), sizes - least + 1)
    by_place = np.empty(len(data), np.int32)
    by_place[order] = cls
    own = by_place[window]
    where, when = at[owner], start[owner] + window - begins[owner]
    turn = np.lexsort((when, where, own))
    own, where, when = own[turn], where[turn], when[turn]
    later = np.concatenate(([False], (own[1:] == own[:-1]) & ((where[1:] != where[:-1]) | (when[1:] != when[:-1]))))
    # rows of one doc_id that say the same at the same place count as one
    head = np.maximum.accumulate(np.where(np.concatenate(([True], own[1:] != own[:-1])), np.arange(len(own)), 0))
    later &= (where != where[head]) | (when != when[head])
    return where[later], when[later]


def as_runs(at: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    if not len(at):
        return pd.DataFrame({"at": at, "start": start, "run": start})
    turn = np.lexsort((start, at))
    at, start = at[turn], start[turn]
    cut = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] > start[:-1] + 1))))
    last = np.append(cut[1:], len(at)) - 1
    return pd.DataFrame({"at": at[cut], "start": start[cut], "run": start[last] - start[cut] + 1})


def region_rows(texts: DataFrame, least: int) -> DataFrame:
    """h (bucket), d (hash of the region), at, start, run (negative if it may repeat itself) of every stretch.

    Each text is a region as well, in a bucket of its own digest. A copy of a text that the task has seen in a smaller
    doc_id is that row alone, so that groups of copies are small before they are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for at, text in zip(batch["at"], batch["text"], strict=True):
                data = as_bytes(text)
                n = len(data) - least + 1
                if n <= 0:
                    continue
                name = hashlib.md5(data.tobytes()).digest()
                whole = np.frombuffer(name, np.int64)
                out.append((whole[:1], whole[1:], np.array([at]), np.zeros(1, np.int64), np.array([n])))
                if seen.get(name, at) < at:
                    continue
                seen[name] = at
                start, size, low, loops = stretches(data, least)
                digest = span_hashes(data, start, start + size + least - 1)
                out.append((low.view(np.int64), digest.view(np.int64), np.full(len(start), at), start, np.where(loops, -size, size)))
            if out:
                yield pd.DataFrame(dict(zip(("h", "d", "at", "start", "run"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return texts.select("at", "text").mapInPandas(run, "h long, d long, at long, start long, run long")


def sift(rows: DataFrame, least: int, parts: int, chunk: int) -> DataFrame:
    """at, start, run and kind: 0 every window goes (an equal region stands earlier), 1 to be indexed, 2 the same in a bucket too large."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = [b.to_numpy(np.int64) for b in batches]
        if not kept:
            return
        h, d, at, start, size = np.concatenate(kept).T
        turn = np.lexsort((start, at, d, h))
        h, d, at, start, size = (x[turn] for x in (h, d, at, start, size))
        loops, size = size < 0, np.abs(size)
        new_h = np.concatenate(([True], h[1:] != h[:-1]))
        new_d = new_h | np.concatenate(([True], d[1:] != d[:-1]))
        head = np.maximum.accumulate(np.where(new_d, np.arange(len(h)), 0))
        again = ~new_d & ((at != at[head]) | (start != start[head]))
        bucket = np.cumsum(new_h) - 1
        distinct = np.bincount(bucket[new_d])
        total = np.bincount(bucket[new_d], (size + least)[new_d])
        index = new_d & ((distinct[bucket] > 1) | loops)
        kind = np.where(again, 0, np.where(total[bucket] > chunk, 2, 1))
        keep = again | index
        yield pd.DataFrame({"h": h[keep], "at": at[keep], "start": start[keep], "run": size[keep], "kind": kind[keep]})

    return rows.repartition(parts, "h").mapInPandas(run, "h long, at long, start long, run long, kind long")


def region_texts(texts: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """h, at, start and said (the region's bytes; for kind 2 a row for each window, by its own hash and without bytes)."""
    wanted = found.filter("kind > 0").groupBy("at").agg(F.collect_list(F.struct("h", "start", "run", "kind")).alias("rows"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for at, text, rows in zip(batch["at"], batch["text"], batch["rows"], strict=True):
                data = as_bytes(text)
                raw = data.tobytes()
                for r in rows:
                    a, n = int(r["start"]), int(r["run"])
                    if a + n + least - 1 > len(raw):  # of another text with this doc_id
                        continue
                    if r["kind"] == 1:
                        out.append((int(r["h"]), at, a, raw[a : a + n + least - 1]))
                    else:
                        part = data[a : a + n + least - 1]
                        keys = mix(gram_hashes(part, least), 5).view(np.int64)
                        out += [(int(k), at, a + i, b"") for i, k in enumerate(keys)]
            yield pd.DataFrame(out, columns=["h", "at", "start", "said"])

    return texts.select("at", "text").join(wanted.hint("shuffle_hash"), "at").mapInPandas(run, "h long, at long, start long, said binary")


def indexed_repeats(regions: DataFrame, least: int, parts: int, chunk: int) -> DataFrame:
    """at, start, run of windows that stand earlier too, by the suffix order of whole buckets."""

    def settle_chunk(rows: list[tuple]) -> pd.DataFrame:
        said = [r for r in rows if r[3]]
        bare = [r for r in rows if not r[3]]
        at, start = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if said:
            a, s = repeated_windows([bytes(r[3]) for r in said], np.array([r[1] for r in said], np.int64), np.array([r[2] for r in said], np.int64), least)
            at.append(a)
            start.append(s)
        if bare:
            h, a, s = (np.array([r[k] for r in bare], np.int64) for k in range(3))
            turn = np.lexsort((s, a, h))
            h, a, s = h[turn], a[turn], s[turn]
            head = np.maximum.accumulate(np.where(np.concatenate(([True], h[1:] != h[:-1])), np.arange(len(h)), 0))
            later = (a != a[head]) | (s != s[head])
            at.append(a[later])
            start.append(s[later])
        return as_runs(np.concatenate(at), np.concatenate(start))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for row in zip(batch["h"], batch["at"], batch["start"], batch["said"], strict=True):
                if held > chunk and row[0] != rows[-1][0]:
                    yield settle_chunk(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[3]) + 16
        if rows:
            yield settle_chunk(rows)

    ordered = regions.repartition(parts, "h").sortWithinPartitions("h")
    return ordered.mapInPandas(run, "at long, start long, run long")


def remove_repeats(docs: DataFrame, least: int = 100, chunk: int = CHUNK) -> DataFrame:
    """docs columns at, doc_id, text, and n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A null text is empty; texts of fewer than `least` bytes lose nothing. A null doc_id comes before all others. Rows of one
    doc_id are one document: what they say at the same place is one string. An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("at"), F.coalesce("text", F.lit("")).alias("text"))
    found = settle(sift(region_rows(keyed, least), least, parts, chunk))
    texts = keyed.repartition(parts, "at")
    repeats = indexed_repeats(region_texts(texts, found, least), least, parts, chunk)
    gone = found.filter("kind = 0").select("at", "start", "run").union(repeats)
    gone = settle(gone.groupBy("at").agg(F.collect_list(F.struct("start", "run")).alias("gone")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, rows in zip(batch["text"], batch["gone"], strict=True):
                data = as_bytes(text)
                n = len(data)
                cover = np.zeros(n + 1, np.int64)
                if rows is not None:
                    starts = np.array([r["start"] for r in rows])
                    ends = starts + np.array([r["run"] for r in rows]) + least - 1
                    fits = ends <= n
                    np.add.at(cover, starts[fits], 1)
                    np.add.at(cover, ends[fits], -1)
                out_of = np.cumsum(cover)[:n] > 0
                spans = int(out_of[0]) + int((out_of[1:] & ~out_of[:-1]).sum()) if n else 0
                out.append((n, int(out_of.sum()), spans, data[~out_of].tobytes()))
            done = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])
            done.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield done

    last = texts.join(gone.hint("shuffle_hash"), "at", "left")
    return last.select("doc_id", "text", "gone").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def repeat_report(docs: DataFrame, least: int = 100, chunk: int = CHUNK) -> DataFrame:
    found = remove_repeats(docs, least, chunk)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], least: int) -> dict[int, tuple]:
    """What repeat_report must say, from a dictionary of all windows (for tests)."""
    seen: set[bytes] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            w = data[i : i + least]
            if w in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(w)
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and not (i and gone[i - 1]))
        out[doc] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out
