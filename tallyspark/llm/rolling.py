"""Hashes over byte and word arrays, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A 64-bit number for every byte value."""
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of any spans of a byte array: polynomials over the bytes' codes, taken from one running sum."""

    BASE = 0x5851F42D4C957F2D

    def __init__(self, data: np.ndarray, seed: int):
        self._add_up(byte_codes(seed)[data])

    @classmethod
    def of(cls, codes: np.ndarray) -> Spans:
        """The same over an array of 64-bit codes, such as words' hashes."""
        out = cls.__new__(cls)
        out._add_up(codes.copy())
        return out

    def _add_up(self, terms: np.ndarray) -> None:
        n = len(terms)
        terms *= powers(self.BASE, n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(pow(self.BASE, -1, 1 << 64), n + 1)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def gram_hashes(data: np.ndarray, doublings: int, seed: int) -> np.ndarray:
    """The hash of the ``2 ** doublings`` bytes from each position."""
    h, p, step = byte_codes(seed)[data], 0x2545F4914F6CDD1D, 1
    for _ in range(doublings):
        n = len(h) - step
        if n <= 0:
            return np.empty(0, np.uint64)
        g = h[:n] * _U(p)
        g += h[step:]
        h, p, step = g, p * p % (1 << 64), 2 * step
    return mix(h)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """The smallest of ``width`` neighbours from each position."""
    step = 1
    while 2 * step <= width and len(a) > step:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = width - step
    if len(a) <= rest:
        return a[:0]
    return np.minimum(a[: len(a) - rest], a[rest:]) if rest else a


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, and where each begins (and the last ends)."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return data, bounds
