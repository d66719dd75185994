"""Periodic runs of words by internal pattern matching.

A run is a maximal stretch of words with smallest period q and at least `exponent` periods. Let b be the power of two with
b <= q < 2b. The run holds a dyadic block (of length b, at a multiple of b), which occurs again q words later: in the
neighbouring window of starts b to 2b - 1 behind it. Its occurrences are an interval of the suffix array; a wavelet tree over
that array answers which of them come next in the window (range successor). As the window is shorter than two blocks,
occurrences in it form one arithmetic progression, known by its first two members and their number, and its members give
the candidate periods. Each is extended to both sides by the longest common extensions of block and occurrence.

All of this is done for the texts of a batch at once: a batch is one sequence of words, in which a text has its own symbols
and ends in a mark, so that nothing matches across texts. The suffix array comes from prefix doubling, whose rank arrays
also name the dyadic blocks and give the common extensions. Work and memory are n log n in the words of a batch; a batch
has about WORDS words, or is one text where that alone has more. No text is cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WORDS = 1 << 17
WORD = re.compile(r"[^\x20\x09-\x0D]+").findall


def block_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Of each k the ranks of the strings of length 2^k at every place: the number of strings that are less.

    symbols: the last one occurs nowhere else. The last array has no equal ranks: it is the inverse of the suffix array.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], symbols[order][1:] != symbols[order][:-1])))
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))
    out, step = [rank.astype(np.int32)], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)  # only places whose string is not alone yet move on
        if not len(open_):
            return out
        old, far = rank[open_], rank[np.minimum(open_ + step, n - 1)]  # a string that is not alone ends before the mark
        at = np.argsort(old * n + far, kind="stable")
        old, far = old[at], far[at]
        group = np.concatenate(([True], old[1:] != old[:-1]))
        new = group | np.concatenate(([True], far[1:] != far[:-1]))
        place = np.arange(len(at))
        start = np.maximum.accumulate(np.where(group, place, 0))
        rank = rank.copy()
        rank[open_[at]] = old + np.maximum.accumulate(np.where(new, place, 0)) - start
        out.append(rank.astype(np.int32))
        step *= 2


class WaveletTree:
    """Over values below their number: of many intervals at once, how many values are less than x, and the k-th least one."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(ones[-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def below(self, left: np.ndarray, right: np.ndarray, x: np.ndarray) -> np.ndarray:
        x = np.minimum(x, (1 << self.bits) - 1)  # no value is greater than this one, which none has unless it is the last
        found = np.zeros(len(x), np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            a, b = ones[left].astype(np.int64), ones[right].astype(np.int64)
            one = (x >> level) & 1 == 1
            found += np.where(one, (right - b) - (left - a), 0)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return found

    def least(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        found = np.zeros(len(k), np.int64)
        for level, ones, zeros in zip(range(self.bits - 1, -1, -1), self.ones, self.zeros, strict=True):
            a, b = ones[left].astype(np.int64), ones[right].astype(np.int64)
            less = (right - b) - (left - a)
            one = k >= less
            found |= one.astype(np.int64) << level
            k = np.where(one, k - less, k)
            left, right = np.where(one, zeros + a, left - a), np.where(one, zeros + b, right - b)
        return found


def extensions(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the strings at i and j (behind i) are equal to the right, and how far those that end before i and j to the left."""
    n = len(ranks[0])
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        r = ranks[k]
        right += (r[np.minimum(i + right, n - 1)] == r[np.minimum(j + right, n - 1)]).astype(np.int64) << k
        a, b = i - left - (1 << k), j - left - (1 << k)
        left += ((a >= 0) & (r[np.maximum(a, 0)] == r[np.maximum(b, 0)])).astype(np.int64) << k
    return right, left


def candidate_periods(ranks: list[np.ndarray], tree: WaveletTree, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of all dyadic blocks of length 2^k that occur again in their window: places, and distances of the occurrences."""
    n, b = len(ranks[0]), 1 << k
    at = np.arange(0, n - b, b)
    left = ranks[k][at].astype(np.int64)
    size = np.bincount(ranks[k], minlength=n)[left]
    at, left, size = (x[size > 1] for x in (at, left, size))
    right = left + size
    before = tree.below(left, right, at + b)
    count = tree.below(left, right, at + 2 * b) - before
    at, left, right, before, count = (x[count > 0] for x in (at, left, right, before, count))
    first = tree.least(left, right, before)
    step = np.zeros(len(at), np.int64)
    more = count > 1
    step[more] = tree.least(left[more], right[more], before[more] + 1) - first[more]
    # a block of period `step` whose stretch reaches the whole progression has no other period there
    reach, _ = extensions(ranks, at[more], at[more] + step[more])
    same = more.copy()
    same[more] = ((first[more] - at[more]) % step[more] == 0) & (reach + step[more] >= first[more] - at[more] + step[more] * (count[more] - 1) + b) & (step[more] < b)
    at, first, step, count = (x[~same] for x in (at, first, step, count))
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    place = np.repeat(at, count)
    return place, np.repeat(first, count) + turn * np.repeat(step, count) - place


def all_runs(symbols: np.ndarray, least: int, exponent: int) -> np.ndarray:
    """Rows (start, length, period) of all runs of symbols, by start and period; the last symbol occurs nowhere else."""
    ranks = block_ranks(symbols)
    values = np.empty(len(symbols), np.int64)
    values[ranks[-1]] = np.arange(len(symbols))
    tree = WaveletTree(values) if len(ranks) > 1 else None
    found = [np.zeros((0, 3), np.int64)]
    for k in range(len(ranks) - 1):  # longer blocks than these occur once
        place, period = candidate_periods(ranks, tree, k)
        right, left = extensions(ranks, place, place + period)
        length = right + left + period
        good = length >= np.maximum(least, exponent * period)
        found.append(np.unique(np.stack([place - left, length, period], 1)[good], axis=0))
    runs = np.concatenate(found)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # a stretch is found with multiples of its period too: the smallest one stays
    again = (runs[1:, :2] == runs[:-1, :2]).all(1)
    runs = runs[np.concatenate(([True], ~again))[: len(runs)]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def text_runs(texts: list[list[str]], least: int, exponent: int) -> list[np.ndarray]:
    """The runs of each text, given as words."""
    names: list[int] = []
    ends, base = [], 0
    for words in texts:  # every text has symbols of its own, and one more at its end
        own: dict[str, int] = {}
        names += [base + own.setdefault(w, len(own)) for w in words]
        base += len(own)
        names.append(base)
        base += 1
        ends.append(len(names))
    if not texts:
        return []
    runs = all_runs(np.array(names, np.int64), least, exponent)
    cuts = np.searchsorted(runs[:, 0], [0, *ends])
    starts = [0, *ends]
    return [runs[a:b] - np.array([s, 0, 0]) for a, b, s in zip(cuts[:-1], cuts[1:], starts, strict=False)]


def without_repeats(words: list[str], runs: np.ndarray) -> str:
    """The words in no run behind its first period, joined by one space."""
    if not len(runs):
        return " ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0))


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """Per document: doc_id, runs (start, length and period in words, by start and period) and collapsed, its text without
    the words of each run behind the run's first period.

    A run has at least `least` words and `exponent` times its period; below three periods it need not hold a block and its
    next occurrence, so fewer are refused. Words are what ASCII white space parts, as they are written. A null text or one
    without words has no runs and collapses to an empty text; a null doc_id stays null; repeated rows come as often as they
    stand there; an empty table gives no rows; other columns are not read. Rows are not shuffled.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not found by their blocks")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch["doc_id"].astype("Int64"), batch["text"].tolist()
            begin = 0
            while begin < len(texts):
                said, total, end = [], 0, begin
                while end < len(texts) and (total < WORDS or end == begin):
                    words = WORD(texts[end]) if isinstance(texts[end], str) else []
                    if said and total + len(words) > WORDS:
                        break
                    said.append(words)
                    total += len(words) + 1
                    end += 1
                found = text_runs(said, least, exponent)
                rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in own.tolist()] for own in found]
                yield pd.DataFrame({"doc_id": ids.iloc[begin:end].array, "runs": rows, "collapsed": [without_repeats(w, r) for w, r in zip(said, found, strict=True)]})
                begin = end

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def brute_force(words: list[str], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """The same runs by trying every period; for tests."""
    found: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))
