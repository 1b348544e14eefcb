"""Vectorised word and shingle hashing over Arrow string arrays.

A word is a maximal run of bytes other than ASCII white space (0x20, 0x09-0x0D); A-Z count as a-z. The bytes of
multi-byte UTF-8 characters are never white space, so byte-wise cutting equals cutting by code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240611))
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
BYTE[SPACE] = 0
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are worked on at a time: some ten temporary numbers stand for each.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts one after another, and the offset of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def text_slices(column, limit: int = SLICE):
    """(first, last, bytes, offsets) of runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    data, offsets = text_bytes(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each word, hash of each word, index of the first word of each text and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = solid[edge]
    starts = np.flatnonzero(begins)
    of = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), of
    lengths = np.diff(starts, append=n)
    s0 = int(starts[0])
    at = np.arange(s0, n, dtype=np.int64) - np.repeat(starts, lengths)
    value = BYTE[data[s0:]] * powers(int(lengths.max()))[at]
    return starts, mix(np.add.reduceat(value, starts - s0)), of


def shingles(hashes: np.ndarray, of: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, index of each text's first): runs of ``n`` words, or the whole of a shorter text."""
    counts = np.diff(of)
    size = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(size)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    text = np.repeat(np.arange(len(counts)), size)
    start = of[:-1][text] + (np.arange(first[-1]) - first[:-1][text])
    width = np.minimum(counts, n)[text]
    p = powers(n + 1, STEP)
    out = p[width - 1] * np.uint64(0xA24BAED4963EE407)
    full = width == n
    if full.all():
        for j in range(n):
            out += hashes[start + j] * p[j]
    else:
        for j in range(n):
            k = j < width
            out[k] += hashes[start[k] + j] * p[j]
    return mix(out), first
