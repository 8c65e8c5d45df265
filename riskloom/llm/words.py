"""Words of many texts at once as 64-bit hashes, in numpy over the joined bytes."""

from __future__ import annotations

import numpy as np

from riskloom.llm.common import mixed

#: Six white-space bytes end a word: 0x20 and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_RNG = np.random.default_rng(20240917)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_MULS = _RNG.integers(1, 2**63, size=16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of them."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.ones(size, np.uint64)
            if size > 1:
                p[1:] = np.uint64(b)
                p = np.multiply.accumulate(p)
            _powers[k] = p
    return _powers[0], _powers[1]


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts with A-Z lower-cased.

    starts, ends: byte places in data; hashes: of each word; first: of each text, the index of its first word (one more
    entry at the end).
    """

    def __init__(self, texts: list[bytes]):
        joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.data = data = _TO_LOWER[joined]
        space = _SPACE[data]
        edge = np.empty(len(data), bool)
        edge[0] = not space[0]
        np.logical_and(~space[1:], space[:-1], out=edge[1:])
        self.starts = np.flatnonzero(edge)
        self.ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.r_[0, np.cumsum(sizes)])
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
        self.hashes = mixed((total[self.ends] - total[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def shingles(self, n: int = 5) -> list[np.ndarray]:
        """Of each text, the sorted distinct hashes of its n-word shingles; with fewer words, of the whole sequence."""
        h, out = self.hashes, []
        rolled = np.zeros(0, np.uint64)
        if len(h) >= n:
            rolled = h[: len(h) - n + 1] * _MULS[0]
            for k in range(1, n):
                rolled = rolled + h[k : len(h) - n + 1 + k] * _MULS[k]
            rolled = mixed(rolled)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if b - a >= n:
                out.append(np.unique(rolled[a : b - n + 1]))
            elif b > a:
                short = h[a:b] * _MULS[: b - a]
                out.append(mixed(np.array([short.sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        return out
