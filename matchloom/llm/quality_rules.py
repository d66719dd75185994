"""Quality rules with compression bands.

The bytes of a text are compressed by zstandard as a whole and in fixed chunks, the tail too. Each length has a band of
ratios (compressed to plain size), set around those of text known to be good. A whole-text ratio outside its band rejects
the text, and so do chunks outside theirs that make up more than a given share of its bytes: repeated text compresses too
well, keys and encoded data hardly at all. Hexadecimal digits compress like prose (0.51 to 0.54 from 1.5 KB on) and pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .bytehash import as_bytes, joined_words, span_hashes

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, whole_ratio double, n_chunks long, n_bad_chunks long, kept boolean"


@dataclass(frozen=True)
class Bands:
    """classes: (bytes below which a class holds, least ratio, greatest ratio), for whole texts, chunks and tails.

    A frame alone is over a dozen bytes, so short texts have wide bands. Good texts of twenty words and more, as labelled
    in the given tables, lie in 0.57 to 0.88 below 256 bytes, 0.54 to 0.74 below 512, 0.51 to 0.68 below 1024, 0.45 to
    0.58 below 4096, 0.42 to 0.47 below 16384 and 0.40 to 0.43 beyond; licences and notes of other kinds in 0.33 to 0.58.
    """

    classes: tuple = ((64, 0.0, float("inf")), (128, 0.40, 1.05), (256, 0.30, 0.92), (512, 0.28, 0.80), (1024, 0.28, 0.74), (2048, 0.26, 0.64), (4096, 0.26, 0.62), (16384, 0.22, 0.60), (float("inf"), 0.18, 0.58))
    chunk: int = 4096
    bad_share: float = 0.2
    level: int = 3
    window: int = 8


def compression(data: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks, chunks outside the band of their length, verdict. No bytes: nothing to reject."""
    if not data:
        return 1.0, 0, 0, True

    def judged(part: bytes) -> tuple[float, bool]:
        ratio = len(press.compress(part)) / len(part)
        low, high = next((low, high) for most, low, high in bands.classes if len(part) < most)
        return ratio, low <= ratio <= high

    whole, fine = judged(data)
    parts = [data[s : s + bands.chunk] for s in range(0, len(data), bands.chunk)]
    bad = [len(p) for p in parts if not judged(p)[1]] if len(parts) > 1 else [] if fine else [len(data)]
    return whole, len(parts), len(bad), fine and sum(bad) <= bands.bad_share * len(data)


def counts(text: str | None, window: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text."""
    data = as_bytes(text)
    words, starts, ends = joined_words(data)
    n = len(starts)
    if not n:
        return 0, 0, int(_SYMBOL[data].sum()), 0, 0
    chars = int(((words & 0xC0) != 0x80).sum()) - (n - 1)
    repeats = 0
    if n >= window:
        hashes = span_hashes(words, starts[: n - window + 1], ends[window - 1 :])
        _, back, times = np.unique(hashes, return_inverse=True, return_counts=True)
        again = (times[back] > 1).astype(np.int64)
        cover = np.zeros(n + 1, np.int64)
        cover[: len(again)] += again
        cover[window : window + len(again)] -= again
        repeats = int((np.cumsum(cover)[:n] > 0).sum())
    lines = Counter(line for line in text.split("\n") if line.strip(" \t\n\v\f\r"))
    return n, chars, int(_SYMBOL[data].sum()), sum(lines.values()) - len(lines), repeats


def judge(texts: pd.Series, bands: Bands) -> pd.DataFrame:
    press = zstandard.ZstdCompressor(level=bands.level)
    rows = []
    for text in texts:
        text = text if isinstance(text, str) else None
        n, chars, symbols, dup, repeats = counts(text, bands.window)
        failed = n < 20 or 100 * repeats > 30 * n
        whole, chunks, bad, fine = compression((text or "").encode("utf-8", "surrogatepass"), bands, press)
        rows.append((n, chars, symbols, dup, repeats, failed, whole, chunks, bad, fine and not failed))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in COLUMNS.split(", ")])


def quality_rules(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Per document: counts, base_failed, ratios and kept (false if a base rule or a band rejects it).

    A null or empty text has no words and fails the base rule; repeated rows are judged alike; an empty table gives no
    rows; columns beyond doc_id and text are not read. Every text is read whole and by itself: no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = judge(batch["text"], bands)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id long, {COLUMNS}")
