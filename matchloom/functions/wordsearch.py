"""Which of many words stand in a text, in one pass of numpy over the bytes of some texts at a time."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes searched at once, but for a longer text, which is searched by itself.
BYTES = 1 << 18


def _slots(codes: np.ndarray) -> np.ndarray:
    return (codes * 2654435761 >> 16) & 0xFFFF


class Words:
    """Words to look for. Their first two bytes, then four at most, say where one may stand; there the others are compared."""

    def __init__(self, words: Iterable[str]) -> None:
        self.words = sorted(set(words))
        self.pairs = np.zeros(1 << 16, dtype=bool)
        self.by_size: dict[int, list[tuple[int, bytes, int]]] = {}
        for place, word in enumerate(self.words):
            data = word.encode()
            if not data:
                raise ValueError("an empty word stands everywhere")
            size = min(4, len(data))
            self.pairs[data[0] + 256 * (data[1] if size > 1 else np.arange(256))] = True
            self.by_size.setdefault(size, []).append((place, data, int.from_bytes(data[:size], "little")))
        self.tables = {size: np.zeros(1 << 16, dtype=bool) for size in self.by_size}
        for size, held in self.by_size.items():
            self.tables[size][_slots(np.array([code for _, _, code in held]))] = True

    def in_texts(self, texts: list[bytes]) -> list[list[str]]:
        """The words in each text, inside other words too, in the order of the alphabet. Texts are UTF-8."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        # 0xFF is in no UTF-8 text: no find crosses from one text into the next
        data = np.frombuffer(b"\xff".join(texts) + b"\xff" * 4, dtype=np.uint8)
        wide = data.astype(np.int64)
        places = np.flatnonzero(self.pairs[wide[:-3] | wide[1:-2] << 8])
        codes = wide[places] | wide[places + 1] << 8 | wide[places + 2] << 16 | wide[places + 3] << 24
        pairs = []
        for size, held in self.by_size.items():
            starts = codes & ((1 << 8 * size) - 1)
            likely = np.flatnonzero(self.tables[size][_slots(starts)])
            at, near = places[likely], starts[likely]
            for place, word, code in held:
                here = at[near == code]
                here = here[here + len(word) <= len(data)]
                for k in range(size, len(word)):
                    here = here[data[here + k] == word[k]]
                if len(here):
                    pairs += [(place, row) for row in np.unique(np.searchsorted(ends, here, side="right")).tolist()]
        found: list[list[str]] = [[] for _ in texts]
        for place, row in sorted(pairs):
            found[row].append(self.words[place])
        return found

    def in_column(self, texts: Iterable[str | None]) -> list[list[str]]:
        out: list[list[str]] = []
        held: list[bytes] = []
        size = 0
        for text in texts:
            held.append((text or "").encode())
            size += len(held[-1])
            if size >= BYTES:
                out += self.in_texts(held)
                held, size = [], 0
        return out + self.in_texts(held) if held else out


def words_in(text: Column, words: Iterable[str]) -> Column:
    """Those of the words that stand anywhere in the text, as an array; a NULL text has none."""
    search = Words(words)

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series(search.in_column(texts), dtype=object)

    return found(text)
