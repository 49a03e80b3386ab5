"""Blockwise suffix sorting with a difference cover, to a bounded depth.

``classes`` finds which strings of ``LENGTH`` bytes in a block of text are equal. Suffixes are
sorted one bucket at a time. A suffix at i is compared by its bytes up to the next cover position
i + d, then by the rank of the cover position among all of the block's cover positions, then by what
is left: long common prefixes are never read again, and only the cover's ranks (7 of 32 positions)
are held for the whole block. Cover ranks come from prefix doubling in steps of the period, under
which the cover is closed.
"""

from __future__ import annotations

import numpy as np

LENGTH = 100
PERIOD = 32
#: Every difference modulo PERIOD is one of two elements.
COVER = (1, 2, 3, 4, 8, 12, 20)
#: From a position to the next cover position, by the position's remainder.
AHEAD = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
FARTHEST = int(AHEAD.max())
#: Depth to which cover positions are ranked: from any position on, the string's last byte is in reach.
DEPTH = LENGTH - FARTHEST


def _words(data: np.ndarray) -> np.ndarray:
    """Eight bytes from each position on, as big-endian numbers; zeros stand behind the end."""
    padded = np.concatenate((data, np.zeros(LENGTH + 2 * PERIOD, np.uint8)))
    out = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(out)]
    return out


def _head(words: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The size bytes at each position, as numbers of eight bytes."""
    out = []
    for k in range(0, size, 8):
        w = words[at + k]
        if size - k < 8:
            w = w >> np.uint64(8 * (8 - (size - k)))
        out.append(w)
    return out


def _ranked(keys: list[np.ndarray]) -> np.ndarray:
    """Dense ranks of rows of keys, the first key most significant."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), np.int64)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Block:
    """A text whose cover positions are ranked."""

    def __init__(self, data: np.ndarray) -> None:
        self.words = _words(data)
        size = -(-(len(data) + LENGTH) // PERIOD) * PERIOD
        periods = size // PERIOD
        at = (np.arange(periods)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < len(self.words) - LENGTH]
        row = np.full(size + 4 * PERIOD, -1, np.int64)
        row[at] = np.arange(len(at))
        rank, depth = _ranked(_head(self.words, at, PERIOD)), PERIOD
        while 2 * depth <= DEPTH:
            rank, depth = _ranked([rank, self._later(rank, row, at, depth)]), 2 * depth
        if depth < DEPTH:
            rank = _ranked([rank, *_head(self.words, np.minimum(at + depth, len(self.words) - PERIOD), DEPTH - depth)])
        self.rank, self.row = rank, row

    @staticmethod
    def _later(rank: np.ndarray, row: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
        """Rank of the position a step on; -1 behind the end."""
        r = row[at + step]
        return np.where(r >= 0, rank[r], -1)

    def sort(self, at: np.ndarray, bucket: np.ndarray, remainder: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes at the positions by bucket and string, and which equal the one before.

        All positions have the same remainder modulo PERIOD; equal ones keep their order."""
        d = int(AHEAD[remainder])
        keys = [bucket, *_head(self.words, at, d), self.rank[self.row[at + d]], *_head(self.words, at + d + DEPTH, LENGTH - d - DEPTH)]
        order = np.lexsort(keys[::-1])
        same = np.ones(len(order), bool)
        same[:1] = False
        for k in keys:
            s = k[order]
            same[1:] &= s[1:] == s[:-1]
        return order, same
