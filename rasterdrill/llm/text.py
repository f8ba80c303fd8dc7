"""Words of many texts at once, as numpy over their UTF-8 bytes.

A batch of texts is one byte array with offsets. Words are runs of bytes of a
class, never crossing a text; each word becomes a 64-bit hash, the sum of one
random value per (position, byte), so that two different words meet with a chance
of 2^-64. All of it is a fixed number of numpy passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

# Bytes of text handled at once inside a task; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_VALUES = mix(np.arange(1, 65537, dtype=np.uint64) * _ODD)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts ``[a, b)`` of at most ``BLOCK_BYTES``, or of one text; every text is in one."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + BLOCK_BYTES, "right")) - 1
        b = min(max(b, a + 1), n, a + 65536)
        yield a, b
        a = b


class Words(NamedTuple):
    """Words in order: where each starts and ends in the bytes, and its text's number."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    hash: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> Words:
    """Runs of bytes for which ``inside`` (256 flags) holds."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    held = inside[data]
    first = held.copy()
    first[1:] &= ~held[:-1]
    last = held.copy()
    last[:-1] &= ~held[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] = held[edge]
    last[edge - 1] = held[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, start, "right") - 1
    return Words(start, end, text, hash_runs(data[held], end - start))


def hash_runs(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each run, where ``data`` is the runs one after the other (none empty)."""
    if not len(lengths):
        return np.zeros(0, np.uint64)
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at, lengths)
    value = _VALUES[((place & 255) << 8) | data]
    if lengths.max() > 256:
        value = value * (np.uint64(2) * (place >> 8).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(value, at) + lengths.astype(np.uint64))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Fixed by the contract: words for near-duplicates end at ASCII white space.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

# Fixed by the contract: words for decontamination are ASCII letters, digits and all other bytes.
ALNUM = np.ones(256, bool)
ALNUM[:0x30] = ALNUM[0x3A:0x61] = ALNUM[0x7B:0x80] = False
