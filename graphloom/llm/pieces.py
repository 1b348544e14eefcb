"""Tokenising by distinct chunks: a bounded cache from chunk hashes to ids, shared by operators 6 and 9.

A chunk starts where no token can cross: at a space between two characters that are not white space, or where the
caller's own rule says. The ids of a text are then those of its chunks, one after another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .textops import BASE, mix, powers

_rng = np.random.Generator(np.random.PCG64(77))
EXACT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLOT_BITS = 21
#: Ids that the cache holds before it starts anew.
ROOM = 24 << 20


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of chunks, those of texts included; neighbours of a cutting space are ASCII or two-byte letters."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        plain = (data > 0x20) & (data < 0x7F)
        lead = (data >= 0xC3) & (data <= 0xDF)
        after = plain.copy()
        after[1:] |= lead[:-1] & (data[1:] >= 0x80)
        before = plain | lead
        cut[1:-1] = (data[1:-1] == 0x20) & after[:-2] & before[2:]
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class ChunkCache:
    """Ids of chunks; ``encode`` gives those of a list of byte strings. Direct-mapped, so its size is bounded."""

    def __init__(self, encode: Callable[[list[bytes]], list], dtype=np.uint16, starts: Callable = chunk_starts):
        self.encode, self.dtype, self.starts = encode, dtype, starts
        self.key = np.zeros(1 << SLOT_BITS, np.uint64)
        self.at = np.zeros(1 << SLOT_BITS, np.int64)
        self.size = np.zeros(1 << SLOT_BITS, np.int32)
        self.flat, self.used = np.zeros(1 << 20, dtype), 0

    def _push(self, ids: np.ndarray) -> int:
        at = self.used
        if at + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), self.dtype)])
        self.flat[at : at + len(ids)] = ids
        self.used += len(ids)
        return at

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, the number of ids of each text)."""
        texts = len(offsets) - 1
        starts = self.starts(data, offsets)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(texts, np.int64)
        if self.used > ROOM:
            self.key[:] = 0
            self.flat, self.used = np.zeros(1 << 20, self.dtype), 0
        sizes = np.diff(starts, append=len(data))
        at = np.arange(len(data), dtype=np.int64) - np.repeat(starts, sizes)
        h = mix(np.add.reduceat(EXACT[data] * powers(int(sizes.max()), BASE)[at], starts))
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != h)
        where, count = self.at[slot], self.size[slot].astype(np.int64)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            rows = miss[first]
            raw = data.tobytes()
            coded = self.encode([raw[s:e] for s, e in zip(starts[rows].tolist(), (starts[rows] + sizes[rows]).tolist(), strict=True)])
            flat, lens = coded
            base = self._push(flat)
            new_at = base + np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
            where[miss], count[miss] = new_at[inverse], lens[inverse]
            self.key[slot[rows]], self.at[slot[rows]], self.size[slot[rows]] = h[rows], new_at, lens
        ends = np.cumsum(count)
        out = self.flat[np.arange(int(ends[-1])) + np.repeat(where - (ends - count), count)]
        of = np.searchsorted(starts, offsets)
        total = np.concatenate([[0], ends])
        return out, total[of[1:]] - total[of[:-1]]
