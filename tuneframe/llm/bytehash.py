"""Hashes of many parts of one text at once, from prefix sums over its bytes."""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX1
    h = (h ^ (h >> np.uint64(27))) * MIX2
    return h ^ (h >> np.uint64(31))


LETTER = scramble(np.arange(1, 257, dtype=np.uint64) * MULT)


class Powers:
    """Powers of an odd base modulo 2**64 and their inverses, as long as the longest text so far."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            up, down = np.full(n, self.base), np.full(n, self.inverse)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)


POWERS = [Powers(b) for b in BASES]


class Prefix:
    """``part(start, end)``: a hash of the bytes in between, equal for equal bytes wherever they stand."""

    def __init__(self, data: np.ndarray, which: int = 0):
        self.powers = POWERS[which]
        self.powers.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTER[data] * self.powers.up[: len(data)], out=self.sums[1:])

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.powers.down[start]
        return scramble(h + (end - start).astype(np.uint64) * MULT)

    def grams(self, n: int) -> np.ndarray:
        """Of every part of n bytes, in order."""
        count = len(self.sums) - n
        return scramble((self.sums[n:] - self.sums[:count]) * self.powers.down[:count] + np.uint64(n) * MULT)


_BYTES = np.arange(256, dtype=np.uint8)
FOLDED = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
BLANK = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))


def word_hashes(raw: bytes) -> np.ndarray:
    """Hashes of a UTF-8 text's words in order: split at ASCII white space, A-Z lower-cased."""
    data = np.frombuffer(raw, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    edge = np.diff(np.concatenate([[True], BLANK[data], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.zeros(0, np.uint64)
    return Prefix(FOLDED[data]).part(start, end)
