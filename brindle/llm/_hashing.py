"""Vectorised 64-bit hashes. They deal rows and draw samples; equality rests on blake2b."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
#: Words whose hashes are kept at a time, and the longest word kept.
KNOWN, LONGEST_KNOWN = 131_072, 64


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64 bits of blake2b of each word, kept for a bounded number of short words."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= LONGEST_KNOWN:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


class Powers:
    """Powers of the (odd) base of the polynomial hash and of its inverse, as far as asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            inverse = _U(pow(int(BASE), -1, 1 << 64))
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[_U(1)], np.full(n - 1, b, _U)])) for b in (BASE, inverse))
        return self.up, self.down


POWERS = Powers()


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """``sums`` such that ``(sums[b] - sums[a]) * down[a]`` is a hash of ``raw[a:b]`` alone: good to deal rows by, not to
    tell strings apart, since texts can be made whose polynomials agree."""
    up, _ = POWERS.to(len(raw) + 1)
    return np.concatenate([np.zeros(1, _U), np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], dtype=_U)])
