"""The tokens of many texts at once, by numpy over their bytes: what ``V.TOKEN_PATTERN`` finds, in lower case."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes cut into tokens at once, but for a longer text, which is cut by itself.
BYTES = 1 << 20

_LETTER, _FOLLOWS = 2, 1
_KIND = np.zeros(256, dtype=np.int8)
_KIND[[*b"0123456789+#.-"]] = _FOLLOWS
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _cut(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    data = np.frombuffer(b"\xff".join([b"", *texts, b""]), dtype=np.uint8)  # 0xFF is in no UTF-8 text
    kind = _KIND[data]
    edges = np.flatnonzero(np.diff((kind > 0).view(np.int8))) + 1
    starts, stops = edges[::2], edges[1::2]
    # a token begins with the first letter of its run
    letters = np.append(np.flatnonzero(kind == _LETTER), len(data))
    starts = letters[np.searchsorted(letters, starts)]
    starts, stops = starts[starts < stops], stops[starts < stops]
    offsets = np.zeros(len(starts) + 1, dtype=np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    at = np.repeat(starts - offsets[:-1], stops - starts) + np.arange(offsets[-1])
    tokens = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[at]]))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return tokens, np.searchsorted(ends, starts - 1, side="right")


def token_parts(texts: pa.Array | pa.ChunkedArray | list) -> Iterator[tuple[slice, pa.Array, np.ndarray]]:
    """(rows, tokens, row of each token) for some texts at a time; rows count from the part's first. NULL has no tokens."""
    held: list[bytes] = []
    size = first = 0
    for text in texts:
        value = text.as_py() if isinstance(text, pa.Scalar) else text
        held.append((value or "").encode())
        size += len(held[-1])
        if size >= BYTES:
            yield slice(first, first + len(held)), *_cut(held)
            first, held, size = first + len(held), [], 0
    if held:
        yield slice(first, first + len(held)), *_cut(held)
