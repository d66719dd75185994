"""Token counts by heap-and-linked-list byte-pair merging, without encoding.

A text is a chain of characters. A heap holds the adjacent pairs whose union is a piece, by rank and place; the lowest one
is merged again and again, and its new neighbours are pushed. The count is the number of initial symbols less the number of
merges; no identifier is ever looked up. A character outside the vocabulary takes as many symbols as it has UTF-8 bytes.

No piece holds a space mark behind another character, nor a character that stands in single pieces only. No merge crosses
such a border, so the chain falls into words that merge independently of each other, whose counts are kept.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

SPACE = "▁"  # what the vocabulary writes for a space
KEPT_WORDS, KEPT_CHARS = 1 << 18, 64  # counts that a worker keeps, and the longest word among them


class PieceCounter(dict):
    """Counts by word: a dict that works out what it lacks."""

    def __init__(self, ranks: dict[str, float], spill: bool):
        """ranks: of each piece, the lowest first. spill: unknown characters take their bytes instead of one symbol."""
        super().__init__()
        self.ranks, self.spill = ranks, spill
        bonds = {c for piece in ranks if len(piece) > 1 for c in piece} - {SPACE}
        self.free = not any(SPACE in piece.lstrip(SPACE) for piece in ranks)  # no piece has a space mark further on
        own = "".join(map(re.escape, sorted(bonds)))
        word = f"[{own}]+" if own else "(?!)"
        self.words = re.compile(f"{SPACE}+(?:{word})?|{word}|[^{SPACE}{own}]+").findall

    def __missing__(self, word: str) -> int:
        found = self.symbols(word) - self.merges(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found

    def symbols(self, chain: str) -> int:
        return sum(1 if c in self.ranks or not self.spill else len(c.encode("utf-8", "surrogatepass")) for c in chain)

    def merges(self, chain: str) -> int:
        """How often a pair is merged, the lowest rank first and among equals the leftmost."""
        ranks, last = self.ranks, len(chain)
        part, after, before = list(chain), list(range(1, last + 1)), list(range(-1, last - 1))
        heap = []
        for i in range(last - 1):
            rank = ranks.get(part[i] + part[i + 1])
            if rank is not None:
                heap.append((rank, i, 2))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, left, size = heapq.heappop(heap)
            right = after[left]
            if right == last or not part[left] or len(part[left]) + len(part[right]) != size:
                continue  # one of both was merged with another meanwhile
            done += 1
            part[left] += part[right]
            part[right] = ""
            follow = after[left] = after[right]
            if follow < last:
                before[follow] = left
                rank = ranks.get(part[left] + part[follow])
                if rank is not None:
                    heapq.heappush(heap, (rank, left, size + len(part[follow])))
            ahead = before[left]
            if ahead >= 0:
                rank = ranks.get(part[ahead] + part[left])
                if rank is not None:
                    heapq.heappush(heap, (rank, ahead, len(part[ahead]) + size))
        return done

    def count(self, text: str) -> int:
        if not text:
            return 0
        chain = SPACE + text.replace(" ", SPACE)
        if not self.free:
            return self.symbols(chain) - self.merges(chain)
        return sum(map(self.__getitem__, self.words(chain)))


@lru_cache(maxsize=4)
def counter(path: str) -> PieceCounter:
    """Of a sentencepiece BPE model that leaves characters and spaces as they are and puts one space before a text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    # a dummy space, no folding, no trimming: anything else would have to be done to texts before they are merged
    if model.normalize(" ﬁ  Å ") != f"{SPACE}{SPACE}ﬁ{SPACE}{SPACE}Å{SPACE}":
        raise ValueError("this model changes texts before it encodes them")
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    return PieceCounter({model.id_to_piece(i): -model.get_score(i) for i in plain}, any(map(model.is_byte, range(model.get_piece_size()))))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit), for the vocabulary file at path.

    A row is counted by itself, without a shuffle: repeated rows come as often as they stand there, a null or empty text
    counts 0, a null doc_id stays null, an empty table gives no rows and other columns are not read. A very long word
    costs n log n and memory for its own chain; it is never cut.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            n = [own.count(t) for t in texts]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n]})

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
