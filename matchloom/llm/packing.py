"""Best-fit packing by hierarchical residual packing.

Texts become token pieces of at most `room` tokens. Each partition packs its pieces by best fit, longest first; bins that
are full enough leave at once, and the others go up a tree, merged as single items and packed again with those of other
partitions, until one level is left. A level keeps only bins with more room than `slack`, so it shrinks fast.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settle

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"
MEMO = 250_000
#: A word of these letters, with at most one mark behind it, needs no normaliser: lower case is all that the tokenizer does to it.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,]?)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def encoder(path: str):
    """ids(text) by the tokenizer at path; words between blanks are looked up in a memo of two bounded generations.

    The tokenizer drops white space and joins nothing across it, so a text's ids are those of its words in order. Words of
    plain letters go straight to its merge model, all others through the whole of it; tests compare with whole texts.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    model, letters = tokenizer.model, byte_letters()
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}

    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def plain(core: str) -> bytes:
        core = core.lower()
        found = young.get(core) or old.get(core)
        if found is None:
            found = pack([t.id for t in model.tokenize("".join([letters[b] for b in core.encode()]))])
        young[core] = found
        return found

    marks = {mark: pack(tokenizer.encode(mark, add_special_tokens=False).ids) for mark in ".,"} | {"": b""}

    def learn(words: set[str]) -> None:
        hard = []
        for word in words:
            if (found := old.get(word)) is not None:
                young[word] = found
            elif m := _PLAIN.fullmatch(word):
                young[word] = plain(m[1]) + marks[m[2]]
            else:
                hard.append(word)
        for word, found in zip(hard, tokenizer.encode_batch_fast(hard, add_special_tokens=False) if hard else [], strict=True):
            young[word] = pack(found.ids)

    def ids(text: str) -> np.ndarray:
        nonlocal young, old
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if len(young) > MEMO:
            old, young = young, {}
        learn(set(words).difference(young))
        return np.frombuffer(b"".join(map(young.__getitem__, words)), "<u4")

    return ids


def _number(level: int, part: int, local: np.ndarray) -> np.ndarray:
    """Bin numbers that no other task or level gives; tasks read settled tables, so a rerun gives the same."""
    return (np.int64(level) << 58) + (np.int64(part) << 32) + local


def filled(sizes: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in it and the bin's whole fill, for each item."""
    bins = best_fit(sizes, room)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(sizes[order])
    used = np.bincount(bins, sizes).astype(np.int64)
    begins = np.concatenate(([0], np.cumsum(used)[:-1])) if len(used) else used
    offsets = np.empty(len(sizes), np.int64)
    offsets[order] = ends - sizes[order] - begins[bins[order]]
    return bins, offsets, used[bins]


def token_pieces(docs: DataFrame, path: str, room: int = 2048) -> DataFrame:
    """The pieces of every document, packed within the partition they are read in.

    Kept of a partition until its end are a few numbers for each piece, which its input split bounds.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids = encoder(path)
        rows, names = [], []
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                found = np.append(ids(text if isinstance(text, str) else ""), np.uint32(0)).astype("<u4")
                for k, start in enumerate(range(0, len(found), room)):
                    part = found[start : start + room]
                    names.append(doc)
                    rows.append((k, start, len(part), zlib.crc32(part.tobytes())))
        if not rows:
            return
        out = pd.DataFrame(np.array(rows, np.int64), columns=["piece", "start", "length", "ids_crc32"])
        out.insert(0, "doc_id", pd.array(names, "Int64"))
        bins, out["offset"], used = filled(out["length"].to_numpy(), room)
        out["bin"], out["used"] = _number(0, TaskContext.get().partitionId(), bins), used
        yield out.astype({"piece": "int32"})[["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "used"]]

    return docs.select("doc_id", "text").mapInPandas(run, PIECE)


def merge_level(items: DataFrame, level: int, groups: int, room: int) -> DataFrame:
    """Packs the items (item, used) of each group anew: item, bin, offset, used (of the bin)."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("item", ignore_index=True)
        bins, offsets, used = filled(rows["used"].to_numpy(), room)
        return pd.DataFrame({"item": rows["item"], "bin": _number(level, int(key[0]), bins), "offset": offsets, "used": used})

    # whole subtrees meet: bins are numbered by the task or group that made them
    place = F.shiftright("item", 32).bitwiseAND(F.lit((1 << 26) - 1)) % groups
    return items.withColumn("group", place).groupBy("group").applyInPandas(run, "item long, bin long, offset long, used long")


def pack_documents(docs: DataFrame, path: str, room: int = 2048, slack: int = 32, fan: int = 8, most: int = 100_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in that sequence.

    slack: a bin with no more free room is final. fan: groups that meet at each level. most: bins that a group of the tree
    takes on average; more bins than that only make more groups, and the tree ends when a level has as many groups as the
    one before. A null or empty text is one piece with the closing id; a repeated doc_id makes pieces of its own for each
    row; an empty table gives no rows; columns beyond doc_id and text are not read.
    """
    pieces = settle(token_pieces(docs, path, room))
    items = pieces.filter((F.col("offset") == 0) & (F.col("used") < room - slack)).select(F.col("bin").alias("item"), "used")
    left, parts = items.agg(F.count("*"), F.countDistinct(F.shiftright("item", 32))).first()
    groups, level, path_to = parts, 0, None
    while left and groups > 1 or level == 0 and left:
        level += 1
        fewer = max(1, -(-groups // fan), -(-left // most))
        if fewer >= groups > 1:
            break
        groups = fewer
        made = settle(merge_level(items, level, groups, room))
        step = made.select("item", "bin", "offset")
        if path_to is None:
            path_to = step
        else:
            up = step.select(F.col("item").alias("via"), F.col("bin").alias("b2"), F.col("offset").alias("o2"))
            path_to = settle(path_to.join(up, path_to["bin"] == up["via"], "left").select("item", F.coalesce("b2", "bin").alias("bin"), (F.col("offset") + F.coalesce("o2", F.lit(0))).alias("offset")))
        items = made.filter((F.col("offset") == 0) & (F.col("used") < room - slack)).select(F.col("bin").alias("item"), "used")
        left = items.count()
    found = pieces.withColumnRenamed("bin", "own").withColumnRenamed("offset", "within")
    if path_to is None:
        found = found.withColumn("bin", F.col("own")).withColumn("offset", F.lit(0))
    else:
        found = found.join(path_to, F.col("own") == F.col("item"), "left")
    where = (F.col("within") + F.coalesce("offset", F.lit(0))).cast("long")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("bin", "own").alias("sequence_id"), where.alias("offset"))


def best_fit(sizes: np.ndarray, room: int) -> np.ndarray:
    """The bin of each item: longest first, each into the fullest bin that takes it. Open bins are kept by their free room."""
    bins = np.empty(len(sizes), np.int64)
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []
    made = 0
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, left = made, room - size
            made += 1
        else:
            free = rooms[at]
            b = by_room[free].pop()
            if not by_room[free]:
                del by_room[free]
                rooms.pop(at)
            left = free - size
        bins[i] = b
        if left:
            if left not in by_room:
                by_room[left] = []
                insort(rooms, left)
            by_room[left].append(b)
    return bins
