"""Operator 8, suffix-array dedup over bytes.

A byte goes when a string of `size` bytes that covers it also starts anywhere else in
the corpus, the same document included. Each such string picks, by winnowing, one seed of
`seed` bytes inside it; equal strings pick it at the same place. So:

1. seeds that occur once in the corpus drop out (round one, 64-bit hashes only, which may let some pass);
2. for the others, blocks send the bytes left and right of the seed that its strings span, with 128 bits
   of the seed's BLAKE2 digest, equal contexts of a block once. In the bucket of the seed, deep-shallow sorting
   (`suffixes.sort`) builds two suffix arrays with their common prefixes: of the bytes to
   the right, and of the reversed bytes to the left;
3. a string that begins l bytes before its seed occurs elsewhere iff another context is in
   the same class at depth l to the left and size-seed-l to the right. Classes at any depth
   are the runs of the suffix array whose common prefix reaches it.

The work per context is bounded by `size`, however many contexts share a seed; no pairs are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm import blocks as B
from waymark.llm import grams as G
from waymark.llm import suffixes

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<first:long,last:long>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", _SPANS)])
CHUNK = 2 << 20  # strings of a block that seeds are picked for at once
BLOCK_BYTES = 2 << 20  # a byte needs several eight-byte numbers while seeds are picked
_BYTE = G.mix(G.constants(256, 41))


class _Seeds:
    """Picked seeds of a block: key, place, and the first and last start of the strings that picked them."""

    def __init__(self, block: B.Block, size: int, seed: int, chunk: int):
        self.data = block.bytes
        ends = block.offsets[1:]
        found = [self._picked(block, a, min(a + chunk, len(self.data)), size, seed) for a in range(0, len(self.data), chunk)]
        self.at, self.lo, self.hi, key = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (*(np.zeros(0, np.int64),) * 3, np.zeros(0, G.U))
        self.order = np.argsort(key, kind="stable")
        new = np.ones(len(key), bool)
        new[1:] = key[self.order][1:] != key[self.order][:-1]
        self.begin = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.key = key[self.order][self.begin]
        self.many = np.diff(np.append(self.begin, len(key))) > 1
        self.size, self.seed, self.ends = size, seed, ends


    def _picked(self, block: B.Block, a: int, b: int, size: int, seed: int) -> tuple[np.ndarray, ...]:
        """Seeds of the strings that begin from a up to b. A long text's strings are picked for some at a time; where one seed
        serves both sides of a cut it has two entries, each with strings of its own."""
        end = min(b + size - 1, len(self.data))
        part = self.data[a:end]
        first = np.searchsorted(block.offsets, a, "right") - 1
        last = np.searchsorted(block.offsets, b, "left")
        low = np.maximum(block.offsets[first:last], a)
        count = np.maximum(np.minimum(block.offsets[first + 1 : last + 1] - size + 1, b) - low, 0)
        starts = np.repeat(low - a, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        if len(starts):
            n = len(part)
            up, down = G.POWERS[0].get(n + 1)
            sums = np.zeros(n + 1, G.U)
            np.cumsum(_BYTE[part] * up[:n], out=sums[1:])
            hashes = G.mix((sums[seed:] - sums[:-seed]) * down[: n - seed + 1])
        else:
            hashes = np.zeros(0, G.U)
        at, lo, hi = G.anchors(hashes, size - seed + 1, starts)
        return at + a, lo + a, hi + a, G.spread(hashes[at] if len(at) else hashes)


class _Contexts:
    """Contexts of the seeds that occur more than once in the corpus; equal ones of the block once."""

    def __init__(self, s: _Seeds, shared: np.ndarray):
        take = s.order[shared[s.of]] if len(s.order) else s.order
        group = s.of[shared[s.of]] if len(s.order) else s.order
        self.at, self.left = s.at[take], s.at[take] - s.lo[take]
        self.least = s.at[take] - s.hi[take]  # the fewest bytes left of the seed
        self.right = s.size - s.seed - self.least
        raw = s.data.tobytes()
        seen: dict[tuple[int, int, bytes], int] = {}
        self.of = np.empty(len(take), np.int64)
        self.first: list[int] = []
        for i, (g, a, l, r) in enumerate(zip(group.tolist(), self.at.tolist(), self.left.tolist(), self.right.tolist(), strict=True)):
            number = seen.setdefault((g, l, raw[a - l : a + s.seed + r]), len(seen))
            if number == len(self.first):
                self.first.append(i)
            self.of[i] = number
        first = np.array(self.first, np.int64)
        self.key = s.key[group[first]] if len(first) else s.key[:0]
        self.many = np.bincount(self.of, minlength=len(first)) > 1
        digests = b"".join(hashlib.blake2b(raw[a : a + s.seed], digest_size=16).digest() for a in self.at[first].tolist())
        self.digest = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        self.pieces = [(raw[a - l : a][::-1], raw[a + s.seed : a + s.seed + r]) for a, l, r in zip(self.at[first].tolist(), self.left[first].tolist(), self.right[first].tolist(), strict=True)]


def _seen_twice(block_of: list[int], payloads: list[tuple]):
    n = [len(p[0]) for p in payloads]
    key, many = (np.concatenate([p[i] for p in payloads]) for i in (0, 1))
    order, begin = G.groups(key)
    size = np.diff(np.append(begin, len(order)))
    twice = np.empty(len(key), bool)
    twice[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], begin), size)
    at = 0
    for block, count in zip(block_of, n, strict=True):
        mine = np.flatnonzero(twice[at : at + count])
        at += count
        if len(mine):
            yield block, B.pack(mine.astype(np.uint32))


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def covered(key: np.ndarray, left: list[bytes], right: list[bytes], many: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the most and the fewest bytes left of the seed among its strings that occur elsewhere
    (-1, -1: none does). Strings span `span` bytes besides the seed; `many`: the same context occurs again in its block."""
    most, fewest = np.full(len(key), -1, np.int64), np.full(len(key), -1, np.int64)
    l_size, r_size = (np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right))
    whole = many.copy()
    sorted_ = []
    for strings, size in ((left, l_size), (right, r_size)):
        data = np.frombuffer(b"".join(strings) or b"\0", np.uint8)
        sorted_.append(suffixes.sort(data, np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else size, size, key))
    (lo, ls), (ro, rs) = sorted_
    # equal whole contexts: every string of theirs occurs elsewhere
    same_l, same_r = (_equal(o, s, z) for (o, s), z in zip(sorted_, (l_size, r_size), strict=True))
    order, begin = G.groups(same_l, same_r)
    size = np.diff(np.append(begin, len(order)))
    twin = np.empty(len(key), bool)
    twin[order] = np.repeat(size > 1, size)
    whole |= twin
    most[whole], fewest[whole] = l_size[whole], span - r_size[whole]
    # one of each set of equal contexts stands for it; groups of one context are done
    stand = np.sort(order[begin])
    k_order, k_begin = G.groups(key[stand])
    k_size = np.diff(np.append(k_begin, len(stand)))
    alone = np.empty(len(stand), bool)
    alone[k_order] = np.repeat(k_size == 1, k_size)
    stand = stand[~alone]
    if not len(stand):
        return most, fewest
    inside = np.zeros(len(key), bool)
    inside[stand] = True
    for depth in range(span + 1):
        mine = stand[(l_size[stand] >= depth) & (r_size[stand] >= span - depth)]
        if len(mine) < 2:
            continue
        o, b = G.groups(_classes(lo, ls, depth)[mine], _classes(ro, rs, span - depth)[mine])
        n = np.diff(np.append(b, len(o)))
        hit = mine[o[np.repeat(n > 1, n)]]
        hit = hit[~whole[hit]]
        most[hit] = np.maximum(most[hit], depth)
        fewest[hit] = np.where(fewest[hit] < 0, depth, np.minimum(fewest[hit], depth))
    return most, fewest


def _equal(order: np.ndarray, shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number per class of equal strings of a group."""
    out = np.empty(len(order), np.int64)
    z = size[order]
    new = np.ones(len(order), bool)
    new[1:] = (shared[1:] < z[1:]) | (z[1:] != z[:-1])
    out[order] = np.cumsum(new)
    return out


def repeated_bytes(docs: DataFrame, size: int = 200, seed: int = 100, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan_bits: int | None = None) -> DataFrame:
    """Per document: bytes of its UTF-8 text, how many are covered by a string of `size` bytes that also starts
    anywhere else, the number of maximal removed runs, the SHA-256 of what stays, and the runs (last exclusive).

    One row per input row, whatever the id (null and repeated ids too); other columns are ignored.
    A null text counts as empty. Texts shorter than `size` stay whole. An empty table gives no rows.
    """
    if not 0 < seed <= size:
        raise ValueError("seed must be between 1 and size")
    blocks = B.build(docs, id_col, text_col, BLOCK_BYTES)
    way = B.post(blocks, fan_bits=fan_bits)
    n_buckets = way.n_buckets

    def seeds(block: B.Block):
        s = _Seeds(block, size, seed, chunk)
        edge = B.bounds(s.key, n_buckets)
        for bucket in edge.used():
            a, b = edge[bucket], edge[bucket + 1]
            yield bucket, B.pack(s.key[a:b], s.many[a:b])

    def shared_of(s: _Seeds, answers: dict[int, tuple]) -> np.ndarray:
        shared = np.zeros(len(s.key), bool)
        edge = B.bounds(s.key, n_buckets)
        for bucket, (mine,) in ((k, v) for k, v in answers.items() if k < B.SECOND):
            shared[edge[bucket] + mine] = True
        return shared

    def contexts(block: B.Block, answers: dict[int, tuple]):
        s = _Seeds(block, size, seed, chunk)
        c = _Contexts(s, shared_of(s, answers))
        edge = B.bounds(c.key, n_buckets)
        for bucket in edge.used():
            a, b = edge[bucket], edge[bucket + 1]
            pieces = c.pieces[a:b]
            ends = np.cumsum([[len(x), len(y)] for x, y in pieces], axis=0)
            yield bucket, B.pack(c.digest[a:b], c.many[a:b], b"".join(x for x, _ in pieces), b"".join(y for _, y in pieces), ends)

    def sort_contexts(block_of: list[int], payloads: list[tuple]):
        digest, many = (np.concatenate([p[i] for p in payloads]) for i in (0, 1))
        order, begin = G.groups(digest[:, 0], digest[:, 1])
        key = np.empty(len(digest), np.int64)
        key[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        left, right = [], []
        for _, _, x, y, ends in payloads:
            for data, out, column in ((x, left, 0), (y, right, 1)):
                cuts = [0, *ends[:, column].tolist()]
                out.extend(data[a:b] for a, b in zip(cuts, cuts[1:], strict=False))
        most, fewest = covered(key, left, right, many, size - seed)
        at = 0
        for block, p in zip(block_of, payloads, strict=True):
            mine = slice(at, at + len(p[0]))
            at += len(p[0])
            hit = np.flatnonzero(most[mine] >= 0)
            if len(hit):
                yield block, B.pack(hit.astype(np.uint32), most[mine][hit].astype(np.uint16), fewest[mine][hit].astype(np.uint16))

    def result(block: B.Block, answers: dict[int, tuple]) -> pa.Table:
        s = _Seeds(block, size, seed, chunk)
        c = _Contexts(s, shared_of(s, answers))
        edge = B.bounds(c.key, n_buckets)
        most, fewest = np.full(len(c.key), -1, np.int64), np.zeros(len(c.key), np.int64)
        for bucket, (hit, m, f) in ((k - B.SECOND, v) for k, v in answers.items() if k >= B.SECOND):
            most[edge[bucket] + hit], fewest[edge[bucket] + hit] = m, f
        gone = np.flatnonzero(most[c.of] >= 0) if len(c.of) else c.of
        begin = c.at[gone] - most[c.of[gone]]
        end = c.at[gone] + size - fewest[c.of[gone]]
        return _rows(block, begin, end)

    answers = B.materialize(B.answer(B.ask(blocks, seeds, way), _seen_twice, way), "answers")
    late = B.second(B.answer(B.ask_again(blocks, answers, contexts, way), sort_contexts, way))
    return B.finish(blocks, answers.unionByName(late), result, SCHEMA, _ARROW)


def _rows(block: B.Block, begin: np.ndarray, end: np.ndarray) -> pa.Table:
    removed = G.union(len(block.bytes), begin, end)
    count = np.concatenate(([0], np.cumsum(removed)))
    n_removed = count[block.offsets[1:]] - count[block.offsets[:-1]]
    shas, spans = [], []
    for i in range(block.n):
        a, b = block.offsets[i], block.offsets[i + 1]
        if n_removed[i]:
            mask = removed[a:b]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            spans.append([{"first": int(x), "last": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)])
            shas.append(hashlib.sha256(block.bytes[a:b][~mask].tobytes()).hexdigest())
        else:
            spans.append([])
            shas.append(hashlib.sha256(block.text(i)).hexdigest())
    return pa.table({"doc_id": block.ids.cast(pa.int64()), "n_bytes": np.diff(block.offsets), "n_removed": n_removed, "n_spans": pa.array([len(x) for x in spans], pa.int64()), "kept_sha256": shas, "spans": pa.array(spans, _SPANS)})
