"""Words of a block, and 64-bit hashes of words, n-grams and spans, with NumPy only.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Word hashes are
multilinear in the bytes, span hashes polynomial in the word hashes, both modulo
2**64 and then mixed. Two families of constants give two independent hashes; where
an operator decides by hash alone it uses both, so 128 bits.
"""

from __future__ import annotations

import numpy as np

from waymark.llm.blocks import Block

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
STEP = 2 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def spread(x: np.ndarray) -> np.ndarray:
    """Hashes hashed again: those picked for being small would all fall into the first buckets."""
    return mix(x ^ U(0xA5A5A5A5A5A5A5A5))


def constants(n: int, family: int) -> np.ndarray:
    """Odd 64-bit constants number 0 to n-1 of a family."""
    return mix(np.arange(n, dtype=U) * U(0x9E3779B97F4A7C15) + U(family * 0x632BE59BD9B4E019 % 2**64)) | U(1)


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, family: int):
        self.base = int(constants(1, family)[0])
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(n, base, U)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


POWERS = (Powers(101), Powers(102))


class Spans:
    """Hashes of any run of items from prefix sums."""

    def __init__(self, items: np.ndarray, family: int):
        up, self.down = POWERS[family].get(len(items) + 1)
        self.sums = np.zeros(len(items) + 1, U)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin] + (end - begin).astype(U))


class Words:
    """All words of a block: `doc` of each, `first` word of each document, byte `starts` and `ends`, hashes."""

    def __init__(self, block: Block, lower: bool = False, families: int = 2):
        data = block.bytes
        if lower:
            data = LOWER[data]
        gap = SPACE[data] if len(data) else np.zeros(0, bool)
        edge = np.zeros(len(data) + 1, bool)
        edge[block.offsets] = True  # words end with their document
        word = ~gap
        begin = word.copy()
        begin[1:] &= gap[:-1] | edge[1 : len(data)]
        self.starts = np.flatnonzero(begin)
        end = word.copy()
        if len(data):
            end[:-1] &= gap[1:] | edge[1 : len(data)]
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, block.offsets)
        self.n = len(self.starts)
        self.doc = np.repeat(np.arange(block.n), np.diff(self.first))
        self.lengths = self.ends - self.starts
        self.hashes = [np.zeros(self.n, U) for _ in range(families)]
        # some bytes at a time: a long text's letters need eight-byte numbers each
        cuts = np.searchsorted(self.starts, np.arange(0, len(data) + STEP, STEP)) if families else np.zeros(0, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if a == b:
                continue
            size = self.lengths[a:b]
            part = slice(self.starts[a], self.ends[b - 1])
            letters = data[part][word[part]]
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(len(letters)) - np.repeat(at, size)
            for family in range(families):
                table, by_place = mix(constants(256, 11 + family)), constants(int(size.max()), 21 + family)
                self.hashes[family][a:b] = mix(np.add.reduceat(table[letters] * by_place[place], at) + size.astype(U))

    def left(self) -> np.ndarray:
        """Words from each word to the end of its document, itself included."""
        return self.first[1:][self.doc] - np.arange(self.n)


def grams(hashes: np.ndarray, k: int, family: int) -> np.ndarray:
    """Hash of the k items from each position (the last k-1 positions are left out)."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, U)
    for j, c in enumerate(constants(k, 31 + family)):
        total += hashes[j : j + n] * c
    return mix(total)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` items, by doubling."""
    have = 1
    while have < width and len(x):
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def anchors(order: np.ndarray, width: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Winnowing: for each window start the place of the smallest hash among `width` places, the first at ties.

    Returns anchor places with their first and last window start. Which place a
    window picks depends on nothing outside the window.
    """
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3
    packed = (order & U(0xFFFFFFFF00000000)) | np.arange(len(order), dtype=U)
    place = (sliding_min(packed, width)[starts] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    last = np.append(new[1:], len(starts)) - 1
    return place[new], starts[new], starts[last]


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order that sorts by keys, the first foremost, and where each group of equal keys begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    if len(order):
        new[0] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
    return order, np.flatnonzero(new)


def union(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mask over n places of those inside any [begin, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, begin, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth)[:n] > 0
