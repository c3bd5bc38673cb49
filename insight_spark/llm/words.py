"""Words of many texts at once: spans, 64-bit hashes and hashes of word runs, as numpy arrays."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


@lru_cache(maxsize=2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of a list of texts in UTF-8.

    data: the texts, one line break between; start, end: each word's bytes in data; first: index of
    each document's first word, with the number of all words last; hash: 64 bits of each word.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        inside = np.concatenate([[False], ~SPACE[raw], [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.start, begins)
        self.hash = self._hash(LOWER[raw] if lower else raw)

    def _hash(self, raw: np.ndarray) -> np.ndarray:
        out, at, n = np.empty(len(self.start), np.uint64), 0, len(self.start)
        while at < n:
            low = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, low + BLOCK, "right")))
            size = int(self.end[to - 1]) - low
            up, down = powers(max(BLOCK, size) + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE_VALUES[raw[low : low + size]] * up[:size], out=total[1:])
            a, b = self.start[at:to] - low, self.end[at:to] - low
            out[at:to] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            at = to
        return out

    def runs(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; those that leave the document mean nothing."""
        size = max(0, len(self.hash) - n + 1)
        out = np.zeros(size, np.uint64)
        factor = np.uint64(1)
        with np.errstate(over="ignore"):
            for k in range(n):
                out += self.hash[k : k + size] * factor
                factor = factor * BASE
        return mix(out + np.uint64(n))

    def shingles(self, doc: int, runs: np.ndarray, n: int) -> np.ndarray:
        """Sorted distinct run hashes of one document; of fewer than n words the whole is the one run."""
        a, b = int(self.first[doc]), int(self.first[doc + 1])
        if b - a >= n:
            found = np.sort(runs[a : b - n + 1])
            return found[np.concatenate([[True], found[1:] != found[:-1]])]
        if a == b:
            return np.empty(0, np.uint64)
        whole = 0
        for h in self.hash[a:b].tolist():
            whole = (whole * int(BASE) + h) & ((1 << 64) - 1)
        return mix(np.array([whole ^ (b - a)], np.uint64))
