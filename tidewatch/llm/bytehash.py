"""Hashes of many substrings at once, for use inside tasks.

A substring's hash is the sum of table[byte] * BASE ** position modulo 2 ** 64, shifted to position 0 and mixed; two hashes of the same string
are equal wherever it stands, and a prefix sum gives each in constant time. The table's random values stand for the bytes' codes.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[ord("0") : ord("9") + 1] = WORD_BYTES[ord("a") : ord("z") + 1] = WORD_BYTES[0x80:] = True
#: Lower-cases A-Z and turns each byte outside words into a space.
WORDS = bytes(ord(chr(b).lower()) if b < 0x80 and (chr(b).isalnum()) else b if b >= 0x80 else 32 for b in range(256))


def table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


TABLES = {seed: table(seed) for seed in (1, 2)}


@functools.lru_cache(4)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse for i in 0 .. size."""
    both = []
    for x in (BASE, pow(BASE, -1, 2**64)):
        p = np.full(size + 1, np.uint64(x % 2**64))
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def rounded(size: int) -> int:
    return 1 << max(16, int(size).bit_length())


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's last steps (fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """A byte string with the hashes of its substrings."""

    def __init__(self, data: np.ndarray, seed: int = 1):
        power, self.back = powers(rounded(len(data)))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(TABLES[seed][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start])


def words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(WORDS).split()


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(WORDS), np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = data != 32
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return Hashed(data).of(start, end) if len(start) else np.zeros(0, np.uint64)
