"""MD5 of many short texts at once: the draws of columns.hash_text inside Arrow tasks."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np

SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed together (their arrays stay in the cache), and the longest text that one block of the hash holds.
TOGETHER, ONE_BLOCK = 16_384, 55


class Tails:
    """Ends of texts that are hashed with many beginnings; ``hashes(head)`` gives the first and the second 64 bits of every digest, in the order of its hex text."""

    def __init__(self, tails: Sequence[bytes]):
        self.parts = [_Part(tails[i : i + TOGETHER]) for i in range(0, len(tails), TOGETHER)]

    def hashes(self, head: bytes) -> tuple[np.ndarray, np.ndarray]:
        return next(self.each([head]))

    def each(self, heads: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The hashes for one beginning after the other; where ends are few, neighbours of one length are hashed together."""
        if not self.parts:
            yield from ((np.zeros(0, np.uint64), np.zeros(0, np.uint64)) for _ in heads)
            return
        most = max(1, TOGETHER // len(self.parts[0].tails))
        for _, same in itertools.groupby(heads, len):
            same = list(same)
            for i in range(0, len(same), most):
                both = [p.hashes(same[i : i + most]) for p in self.parts]
                for j in range(len(both[0][0])):
                    yield (both[0][0][j], both[0][1][j]) if len(both) == 1 else (np.concatenate([b[0][j] for b in both]), np.concatenate([b[1][j] for b in both]))


class _Part:
    def __init__(self, tails: Sequence[bytes]):
        self.tails, self.words = list(tails), {}
        self.lengths = np.array([len(t) for t in tails])
        self.longest = int(self.lengths.max())

    def block(self, start: int) -> list:
        """The sixteen words of the one block behind ``start`` bytes of beginning; a word that all texts share is a number."""
        if start not in self.words:
            n = len(self.tails)
            raw = np.zeros((n, 64), np.uint8)
            raw[:, start : start + self.longest] = np.frombuffer(b"".join(t.ljust(self.longest, b"\0") for t in self.tails), np.uint8).reshape(n, -1)
            raw[np.arange(n), start + self.lengths] = 0x80
            raw[:, 56:] = ((start + self.lengths) * 8).astype("<u8")[:, None].view(np.uint8)
            words = np.ascontiguousarray(raw.view("<u4").T)
            self.words[start] = [int(w[0]) if (w == w[0]).all() else w for w in words]
        return self.words[start]

    def hashes(self, heads: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One row of hashes for each beginning; all beginnings are of one length."""
        start, m, n = len(heads[0]), len(heads), len(self.tails)
        if start + self.longest > ONE_BLOCK:
            digests = np.frombuffer(b"".join(hashlib.md5(h + t).digest() for h in heads for t in self.tails), ">u8").reshape(m, n, 2)
            return digests[..., 0].astype(np.uint64), digests[..., 1].astype(np.uint64)
        first = np.frombuffer(b"".join(h.ljust(64, b"\0") for h in heads), "<u4").reshape(m, 16).T
        x = []
        for w, f in zip(self.block(start), first, strict=True):
            if (f == f[0]).all():
                x.append(w + int(f[0]) & 0xFFFFFFFF if isinstance(w, int) else np.tile(w + f[0], m))
            else:
                x.append((f[:, None] + (np.full(n, w, np.uint32) if isinstance(w, int) else w)).ravel())
        n *= m
        a, b, c, d = (np.full(n, s, np.uint32) for s in START)
        f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
        for i in range(64):
            if i < 16:
                at = i
                np.bitwise_xor(c, d, out=f)
                np.bitwise_and(f, b, out=f)
                np.bitwise_xor(f, d, out=f)
            elif i < 32:
                at = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_and(f, d, out=f)
                np.bitwise_xor(f, c, out=f)
            elif i < 48:
                at = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                np.bitwise_xor(f, d, out=f)
            else:
                at = 7 * i % 16
                np.invert(d, out=f)
                np.bitwise_or(f, b, out=f)
                np.bitwise_xor(f, c, out=f)
            np.add(f, a, out=f)
            if isinstance(x[at], int):
                np.add(f, np.uint32(x[at] + SINES[i] & 0xFFFFFFFF), out=f)
            else:
                np.add(f, x[at], out=f)
                np.add(f, np.uint32(SINES[i]), out=f)
            np.left_shift(f, np.uint32(TURNS[i]), out=t)
            np.right_shift(f, np.uint32(32 - TURNS[i]), out=f)
            np.bitwise_or(f, t, out=f)
            np.add(b, f, out=a)
            a, b, c, d = d, a, b, c
        a, b, c, d = ((v + np.uint32(s)).byteswap().astype(np.uint64).reshape(m, -1) for v, s in zip((a, b, c, d), START, strict=True))
        return a << np.uint64(32) | b, c << np.uint64(32) | d
