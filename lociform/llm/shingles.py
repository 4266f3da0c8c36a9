"""Word shingle sets as sorted 64-bit hashes, and their SetSketch registers."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from lociform.llm.common import utf8

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordHashes(dict):
    """word -> 64-bit hash, forgotten when full so that memory stays bounded."""

    LIMIT = 80_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


WORDS = WordHashes()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles of A-Z lower-cased words.

    Words end at space and bytes 9-13. Fewer words than ``width``: the whole sequence
    is one shingle. No words or a null text: an empty set.
    """
    words = utf8(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    take = min(width, len(h))
    out = np.full(n, take, np.uint64)
    for i in range(take):
        out = mixed(out * M1 + h[i : i + n])
    return np.unique(out)


def set_key(hashes: np.ndarray) -> bytes:
    """128 bits that stand for a set; equal sets, equal keys."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


class SetSketch:
    """SetSketch registers K_i = clip(1 - floor(log_base(min_x E_i(x))), 0, top).

    E_i(x) are independent exponential variables of rate ``rate``, drawn from a hash of
    the element and the register; the registers of a union are the maxima of the
    registers of its parts, and two registers of similar sets agree with a probability
    that grows with their Jaccard similarity.
    """

    def __init__(self, registers: int, base: float = 1.02, rate: float = 20.0, top: int = 2046, seed: int = 7):
        self.m, self.base, self.rate, self.top = registers, base, rate, top
        draw = np.random.Generator(np.random.PCG64(seed))
        self.factors = draw.integers(0, 1 << 32, registers, np.uint64).astype(np.uint32) | np.uint32(1)
        self.adds = draw.integers(0, 1 << 32, registers, np.uint64).astype(np.uint32)

    def of(self, hashes: np.ndarray, block: int = 128) -> np.ndarray:
        """Registers of one set; those of an empty set are 0."""
        least = np.full(self.m, 0xFFFFFFFF, np.uint32)
        low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(hashes), block):
            x = low[at : at + block, None] * self.factors
            x ^= (high[at : at + block, None] + self.adds) * np.uint32(0x85EBCA6B)
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            np.minimum(least, x.min(axis=0), out=least)
        if not len(hashes):
            return np.zeros(self.m, np.uint16)
        value = -np.log1p(-(least.astype(np.float64) + 0.5) / 4294967296.0) / self.rate
        return np.clip(1 - np.floor(np.log(value) / np.log(self.base)), 0, self.top).astype(np.uint16)

    def similarity(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
        """Jaccard similarity by joint maximum likelihood from the counts of equal, larger
        and smaller registers of each row of ``a`` and ``b``, the set sizes being known."""
        equal = (a == b).sum(1)
        more, less = (a > b).sum(1), (a < b).sum(1)
        u = n_a / (n_a + n_b)
        v = 1 - u
        top = np.minimum(u / v, v / u)
        grid = np.linspace(0, 1, 257)[None, :] * top[:, None]
        p = lambda x: -np.log1p(-x * (self.base - 1) / self.base) / np.log(self.base)
        gain = p(np.clip(u[:, None] - v[:, None] * grid, 0, 1))
        loss = p(np.clip(v[:, None] - u[:, None] * grid, 0, 1))
        same = np.clip(1 - gain - loss, 1e-12, 1)
        fit = more[:, None] * np.log(np.maximum(gain, 1e-12)) + less[:, None] * np.log(np.maximum(loss, 1e-12)) + equal[:, None] * np.log(same)
        return grid[np.arange(len(equal)), fit.argmax(1)]


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
