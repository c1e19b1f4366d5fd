"""Deep-shallow sorting of many strings at once.

`sort` orders strings (slices of one buffer) inside given groups and reports the
common prefix of neighbours. Shallow part: multikey quicksort down to `SHALLOW` bytes, with eight bytes as one
letter. Each segment of strings that agree so far is parted by a pivot into smaller, equal and larger ones; the equal
move on by one letter, the others are parted again. All segments take their step at once, as array operations. Deep part: strings that still agree are put in a blind trie, whose inner nodes
hold only the length of the common prefix and whose edges hold one byte; a new string
is compared in full with a single leaf, and its place follows from where they part.
"""

from __future__ import annotations

import numpy as np

from waymark.llm.grams import U

SHALLOW = 32


def _words(data: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from `at`, big-endian; zero bytes past the string's end (`left` bytes remain)."""
    out = np.zeros(len(at), U)
    for i in range(8):
        out = (out << U(8)) | np.where(left > i, data[np.minimum(at + i, len(data) - 1)], 0).astype(U)
    return out


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal leading bytes of big-endian words."""
    x = a ^ b
    n = np.zeros(len(x), np.int64)
    for i in range(1, 8):
        n += x < (U(1) << U(64 - 8 * i))
    return np.where(x == 0, 8, n)


def common_prefix(a: bytes, b: bytes) -> int:
    """Equal leading bytes, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class BlindTrie:
    """Strings that share their first `depth` bytes. Node: [depth, {byte: node}], leaf: list of numbers of equal strings."""

    def __init__(self, strings: list[bytes], depth: int):
        self.strings, self.depth = strings, depth
        self.root: list | None = None
        for number in range(len(strings)):
            self._insert(number)

    def _insert(self, number: int) -> None:
        s = self.strings[number]
        if self.root is None:
            self.root = ["leaf", [number]]
            return
        node = self.root
        while node[0] != "leaf":  # blind: bytes between branching points are not looked at
            children = node[1]
            d = node[0]
            byte = s[d] if d < len(s) else -1
            node = children.get(byte) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        if s == other:
            node[1].append(number)
            return
        d = common_prefix(s, other)
        byte, its = (x[d] if d < len(x) else -1 for x in (s, other))
        parent, node, edge = None, self.root, None
        while node[0] != "leaf" and node[0] < d:
            parent, edge = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][edge]
        if node[0] == d:
            node[1][byte] = ["leaf", [number]]
            return
        split = [d, {its: node, byte: ["leaf", [number]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def walk(self) -> tuple[list[int], list[int]]:
        """Numbers in order, and the prefix each shares with the one before (the first: `depth`)."""
        order: list[int] = []
        shared: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, self.depth)]
        while stack:
            node, common = stack.pop()
            if node[0] == "leaf":
                size = len(self.strings[node[1][0]])
                order += node[1]
                shared += [common] + [size] * (len(node[1]) - 1)
            else:
                for i, key in reversed(list(enumerate(sorted(node[1])))):
                    stack.append((node[1][key], node[0] if i else common))
        return order, shared


def _quicksort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, the first `SHALLOW` bytes), and where each segment of strings that agree in these begins."""
    n = len(start)
    order = np.argsort(group, kind="stable")
    begin = np.ones(n + 1, bool)
    begin[1:n] = group[order][1:] != group[order][:-1]
    depth = np.zeros(n, np.int64)  # bytes that the string's segment agrees in; equal strings are at their end
    while True:
        first = np.flatnonzero(begin)
        size = np.diff(first)
        open_ = (size > 1) & (depth[order[first[:-1]]] < SHALLOW)
        if not open_.any():
            return order, begin[:n]
        places = np.flatnonzero(np.repeat(open_, size))
        rows, segment = order[places], np.repeat(np.arange(int(open_.sum())), size[open_])
        at = depth[rows]
        word, ends = _words(data, start[rows] + at, length[rows] - at), np.minimum(length[rows] - at, 8)
        middle = (np.cumsum(size[open_]) - size[open_] + size[open_] // 2)[segment]  # the pivot: the segment's middle string
        larger = (word > word[middle]) | ((word == word[middle]) & (ends > ends[middle]))
        smaller = (word < word[middle]) | ((word == word[middle]) & (ends < ends[middle]))
        kind = segment * 3 + 1 + larger - smaller
        inner = np.argsort(kind, kind="stable")
        order[places] = rows[inner]
        kind = kind[inner]
        begin[places[1:]] |= kind[1:] != kind[:-1]
        equal = ~larger & ~smaller
        depth[rows[equal]] = np.where(ends[equal] < 8, SHALLOW, at[equal] + 8)


def sort(data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, bytes), and the common prefix of each with the one before, -1 at a group's first."""
    n = len(start)
    shared = np.full(n, -1, np.int64)
    if n == 0:
        return np.zeros(0, np.int64), shared
    order, begin = _quicksort(data, start, length, group)
    # common prefixes of neighbours that the shallow part told apart
    left = np.flatnonzero(begin[1:] & (group[order][1:] == group[order][:-1])) + 1
    shared[left] = 0
    for depth in range(0, SHALLOW, 8):
        a, b = order[left - 1], order[left]
        same = np.minimum(_common(*(_words(data, start[x] + depth, length[x] - depth) for x in (a, b))), np.minimum(length[a], length[b]) - depth)
        shared[left] += same
        left = left[same == 8]
    begin_at = np.flatnonzero(begin)
    end_at = np.append(begin_at[1:], n)
    deep = np.flatnonzero(end_at - begin_at > 1)
    raw = data.tobytes() if len(deep) else b""
    for i in deep:
        a, b = begin_at[i], end_at[i]
        rows = order[a:b]
        strings = [raw[s : s + m] for s, m in zip(start[rows].tolist(), length[rows].tolist(), strict=True)]
        places, common = BlindTrie(strings, min(SHALLOW, len(strings[0]))).walk()
        order[a:b] = rows[places]
        shared[a + 1 : b] = common[1:]
    return order, shared
