"""Vectorised hashes of stretches of bytes, and sorts of hashes, for the operators that compare windows."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0xD1342543DE82EF95)
#: Bits of a row's number in ``order_of``'s packed sort.
ROW_BITS = 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_numbers(seed: int = 6) -> np.ndarray:
    """A fixed random 64-bit number for each byte."""
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


class Roller:
    """Hashes of any stretch of a symbol sequence from prefix sums of ``symbol * BASE^position``, modulo 2^64."""

    _powers = np.empty(0, np.uint64)
    _inverse = np.empty(0, np.uint64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols) + 1
        if len(Roller._powers) < n:
            size = max(n, 4096)
            Roller._powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE)]))
            Roller._inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, np.uint64(pow(int(BASE), -1, 1 << 64)))]))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(symbols * Roller._powers[: n - 1])])

    def all(self, length: int) -> np.ndarray:
        """Of every stretch of this length."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * Roller._inverse[:n])

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Roller._inverse[start] + (end - start).astype(np.uint64))


class WordHashes:
    """64-bit hashes of words from their bytes, under keys drawn from ``seed``.

    A word goes in by eight bytes at a time, each time through a keyed mixing
    without loss (exclusive or, shifts, odd products), all words side by side. It is
    no linear form of the bytes, and without the seed no collision can be worked out.
    """

    MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)

    def __init__(self, seed: int, hashes: int = 2):
        self.keys = np.random.default_rng(seed).integers(0, 1 << 64, (hashes, 4), dtype=np.uint64) | np.uint64(1)

    @staticmethod
    def _stir(h: np.ndarray, keys: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(32))) * keys[1]
        h = (h ^ (h >> np.uint64(29))) * keys[2]
        return h ^ (h >> np.uint64(32))

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        """The hash number ``which`` of each stretch of ``data``."""
        keys = self.keys[which]
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))  # eight bytes from every place on
        left = end - start
        h = self._stir(left.astype(np.uint64) * keys[3] + keys[0], keys)
        on, at = np.arange(len(start)), start
        while len(on):
            h[on] = self._stir((h[on] ^ (eight[at] & self.MASKS[np.minimum(left, 8)])) + keys[0], keys)
            more = left > 8
            on, at, left = on[more], at[more] + 8, left[more] - 8
        return h


def order_of(h: np.ndarray) -> np.ndarray:
    """``argsort`` of 64-bit hashes, equal ones together: by their upper bits with the row number below, which sorts several times faster; in full where these bits don't tell different hashes apart."""
    n = len(h)
    if n < 1 << ROW_BITS:
        low = np.uint64((1 << ROW_BITS) - 1)
        packed = np.sort((h & ~low) | np.arange(n, dtype=np.uint64))
        order = (packed & low).astype(np.int64)
        upper, sorted_ = packed >> np.uint64(ROW_BITS), h[order]
        if not ((upper[1:] == upper[:-1]) & (sorted_[1:] != sorted_[:-1])).any():
            return order
    return np.argsort(h)
