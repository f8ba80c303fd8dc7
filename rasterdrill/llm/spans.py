"""Words of blocks of text for the window, vocabulary and phrase operators.

Texts are cut into blocks as in ``text``; a text far above a block is read in pieces
that end at a byte outside every word, so that temporary arrays follow a piece, not
the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from rasterdrill.llm import text as T

PIECE = 4 << 20


def _cuts(data: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pieces ``[a, b)`` of about ``PIECE`` bytes that no word crosses."""
    a, n = 0, len(data)
    while a < n:
        b = min(a + PIECE, n)
        while b < n and inside[data[b - 1]] and inside[data[b]]:
            out = np.flatnonzero(~inside[data[b : b + PIECE]])
            b = b + int(out[0]) if len(out) else min(b + PIECE, n)
        yield a, b
        a = b


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> T.Words:
    """:func:`text.words`, in pieces where a text is long."""
    if len(data) <= 2 * PIECE or len(offsets) > 2:
        return T.words(data, offsets, inside)
    found = []
    for a, b in _cuts(data, inside):
        w = T.words(data[a:b], np.array([0, b - a]), inside)
        found.append(T.Words(w.start + a, w.end + a, w.text, w.hash))
    return T.Words(*(np.concatenate(x) for x in zip(*found)))


def text_blocks(
    batches: Iterator[pa.RecordBatch], column: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Blocks of rows with the bytes and offsets of their texts; null is empty."""
    for batch in batches:
        data, offsets = T.flat(batch.column(column))
        for a, b in T.blocks(offsets):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs ``[start, end)`` as a binary column."""
    size = end - start
    cuts = np.append(0, np.cumsum(size))
    place = np.repeat(start - cuts[:-1], size) + np.arange(cuts[-1])
    return pa.Array.from_buffers(
        pa.large_binary(), len(start), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(data[place].tobytes())]
    )


def planes(values: np.ndarray) -> bytes:
    """Whole numbers byte plane by byte plane, so that the leading zeros lie together."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(raw: bytes, dtype) -> np.ndarray:
    wide = np.dtype(dtype).itemsize
    return np.frombuffer(raw, np.uint8).reshape(wide, -1).T.copy().view(dtype).ravel()
