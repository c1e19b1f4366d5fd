"""Operator 9, substring dedup: seed and extend.

A passage of at least `window` words counts as repeated when the same words start
in a document with a smaller id. Seeds are word `seed`-grams picked by winnowing:
each run of `window` words picks its smallest-hash seed, so two equal runs pick
the same seed at the same place. Joining documents on seeds therefore finds every
repeat. Documents that share a seed are joined in its bucket, in two rounds:

* whole spans first. A seed's span covers all runs that picked it. Where an equal span starts in a document
  with a smaller id, all of it is repeated, and nothing needs extending;
* seeds whose spans differ are extended. Blocks send the words left and right of the seed (their hashes); in the bucket
  matches grow from the seed word by word both ways: texts that agree on l words to the left and window - seed - l
  to the right share a run, and the smallest id among them owns it.

Runs that are repeated merge with their neighbours (`grams.union`), which leaves the maximal repeats of at least `window` words.
Only the smallest id per (seed, span) leaves a block, and only it is extended, so
copies cost one entry per block, and no pairs are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import blocks as B
from waymark.llm import grams as G
from waymark.llm.scratch import materialize

SCHEMA = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<first:long,last:long>>"
_ARROW = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])


class _Seeds:
    """Seeds of a block with the runs that picked them, one group per (seed, span)."""

    def __init__(self, block: B.Block, window: int, seed: int):
        self.words = w = G.Words(block)
        self.window = window
        self.ids = block.id_order()
        starts = np.flatnonzero(w.left() >= window) if w.n else np.zeros(0, np.int64)
        hashes = G.grams(w.hashes[0], seed, 0)
        at, self.lo, self.hi = G.anchors(hashes, window - seed + 1, starts)
        self.at = at
        self.doc = w.doc[at] if len(at) else at
        key = G.spread(hashes[at])
        self.spans = (G.Spans(w.hashes[0], 0), G.Spans(w.hashes[1], 1))
        span = G.mix(self.spans[1].hash(self.lo, self.hi + window) + (at - self.lo).astype(G.U))
        self.own = self.ids[self.doc]
        self.order, self.begin = G.groups(key, span, self.own)
        self._group(key, span)

    def _group(self, key: np.ndarray, span: np.ndarray) -> None:
        k, s = key[self.order], span[self.order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        self.begin = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1  # group of each seed in self.order
        self.key, self.span = k[self.begin], s[self.begin]
        self.least = self.own[self.order][self.begin]


def _payloads(key: np.ndarray, span: np.ndarray, least: np.ndarray, n_buckets: int):
    """Keys are sorted; ids travel as places in a table of the payload's own ids."""
    edge = B.bounds(key, n_buckets)
    for bucket in edge.used():
        a, b = edge[bucket], edge[bucket + 1]
        ids, place = np.unique(least[a:b], return_inverse=True)
        yield bucket, B.pack(key[a:b], span[a:b], ids, place.astype(np.uint32 if len(ids) > 65535 else np.uint16))


def _owners(block_of: list[int], payloads: list[tuple]):
    """To each block: entries whose span starts in a smaller id elsewhere, with that id, and entries to look at again."""
    n = [len(p[0]) for p in payloads]
    key, span = np.concatenate([p[0] for p in payloads]), np.concatenate([p[1] for p in payloads])
    least = np.concatenate([p[2][p[3]] for p in payloads])
    order, begin = G.groups(key, span)
    size = np.diff(np.append(begin, len(order)))
    owner = np.minimum.reduceat(least[order], begin)
    k = key[order][begin]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = np.flatnonzero(new)
    spans = np.diff(np.append(first, len(begin)))
    low, high = np.minimum.reduceat(owner, first), np.maximum.reduceat(owner, first)
    mixed = np.repeat((spans > 1) & (low < high), spans)
    owner_of, mixed_of = np.empty(len(order), np.int64), np.empty(len(order), bool)
    owner_of[order], mixed_of[order] = np.repeat(owner, size), np.repeat(mixed, size)
    mixed_of &= least == owner_of
    at = 0
    for block, count in zip(block_of, n, strict=True):
        mine = slice(at, at + count)
        at += count
        smaller, again = np.flatnonzero(owner_of[mine] < least[mine]), np.flatnonzero(mixed_of[mine])
        if len(smaller) or len(again):
            yield block, B.pack(smaller.astype(np.uint32), owner_of[mine][smaller], again.astype(np.uint32))


def _read(answers: dict[int, tuple], edge: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner, again = least.copy(), np.zeros(len(least), bool)
    for bucket, (smaller, owners, more) in ((b, a) for b, a in answers.items() if b < B.SECOND):
        at = edge[bucket]
        owner[at + smaller] = owners
        again[at + more] = True
    return owner, again


class _Contexts:
    """The seeds to extend: one entry per (seed, span), with the words on both sides that its runs reach."""

    def __init__(self, seeds: _Seeds, again: np.ndarray, seed: int):
        self.reach = reach = seeds.window - seed
        self.group = np.flatnonzero(again)  # seeds.key ascends, so do the entries' keys
        first = seeds.order[seeds.begin[self.group]] if len(self.group) else seeds.order[:0]
        self.key, self.least = seeds.key[self.group], seeds.least[self.group]
        at = seeds.at[first]
        self.left, self.right = at - seeds.lo[first], seeds.hi[first] + seeds.window - at - seed
        h = seeds.words.hashes[0]
        step = np.arange(reach)
        end = max(len(h) - 1, 0)
        #: hashes of the words to the left, nearest first, and to the right; 0 beyond the span
        self.words = [
            np.where(step < self.left[:, None], h[np.clip(at[:, None] - 1 - step, 0, end)], G.U(0)) if len(at) else np.zeros((0, reach), G.U),
            np.where(step < self.right[:, None], h[np.clip(at[:, None] + seed + step, 0, end)], G.U(0)) if len(at) else np.zeros((0, reach), G.U),
        ]

    def payloads(self, n_buckets: int):
        edge = B.bounds(self.key, n_buckets)
        for bucket in edge.used():
            mine = slice(edge[bucket], edge[bucket + 1])
            yield bucket, B.pack(self.key[mine], self.least[mine], self.left[mine].astype(np.uint32), self.right[mine].astype(np.uint32), *(w[mine] for w in self.words))


def _grown(start: np.ndarray, size: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Per depth 0, 1, ...: a class number for entries that agree on the seed and so many words on this side, -1 where the span is shorter."""
    classes = [start]
    for depth in range(1, words.shape[1] + 1):
        out = np.full(len(start), -1, np.int64)
        inside = np.flatnonzero(size >= depth)
        order, begin = G.groups(classes[-1][inside], words[inside, depth - 1])
        out[inside[order]] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        classes.append(out)
    return classes


def _extend(block_of: list[int], payloads: list[tuple]):
    """To each block, per entry and words left of the seed: does the run that begins there also start in a smaller id?"""
    key, least, left, right, before, after = (np.concatenate([p[i] for p in payloads]) for i in range(6))
    reach = before.shape[1]
    seeds = np.unique(key, return_inverse=True)[1]
    to_left, to_right = _grown(seeds, left, before), _grown(seeds, right, after)
    gone = np.zeros((len(key), reach + 1), bool)
    for l in range(reach + 1):
        inside = np.flatnonzero((left >= l) & (right >= reach - l))
        if not len(inside):
            continue
        order, begin = G.groups(to_left[l][inside], to_right[reach - l][inside])
        owner = np.minimum.reduceat(least[inside][order], begin)
        gone[inside[order], l] = least[inside][order] > np.repeat(owner, np.diff(np.append(begin, len(order))))
    at = 0
    for block, p in zip(block_of, payloads, strict=True):
        mine = gone[at : at + len(p[0])]
        at += len(p[0])
        some = np.flatnonzero(mine.any(axis=1))
        if len(some):
            yield block, B.pack(some.astype(np.uint32), np.packbits(mine[some], axis=1))


def repeated_passages(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, fan_bits: int | None = None) -> DataFrame:
    """Per document: its words, how many lie in a run of `window` words that also starts in a document with a
    smaller id, the SHA-256 of the words that stay (joined by one space), and the removed spans (word numbers, last exclusive).

    One row comes back per input row, whatever the id, with the number in `row_col`, if named, as `row`; other columns are ignored. A null
    or empty text has no words (and the hash of the empty string). Rows with equal ids never
    remove each other's words; a null id counts as larger than any other. An empty table gives no rows.
    """
    if not 0 < seed <= window:
        raise ValueError("seed must be between 1 and window")
    blocks = B.build(docs, id_col, text_col, row_col=row_col)
    way = B.post(blocks, fan_bits=fan_bits)
    n_buckets = way.n_buckets

    def first(block: B.Block):
        s = _Seeds(block, window, seed)
        yield from _payloads(s.key, s.span, s.least, n_buckets)

    def contexts(block: B.Block, answers: dict[int, tuple]):
        s = _Seeds(block, window, seed)
        yield from _Contexts(s, _read(answers, B.bounds(s.key, n_buckets), s.least)[1], seed).payloads(n_buckets)

    def result(block: B.Block, answers: dict[int, tuple]) -> pa.Table:
        s = _Seeds(block, window, seed)
        owner, more = _read(answers, B.bounds(s.key, n_buckets), s.least)
        gone = s.order[s.own[s.order] > owner[s.of]] if len(s.order) else s.order
        begin, end = [s.lo[gone]], [s.hi[gone] + window]
        c = _Contexts(s, more, seed)
        edge = B.bounds(c.key, n_buckets)
        runs = np.zeros((len(s.begin), c.reach + 1), bool)
        for bucket, (some, bits) in ((b - B.SECOND, a) for b, a in answers.items() if b >= B.SECOND):
            runs[c.group[edge[bucket] + some]] = np.unpackbits(bits, axis=1, count=c.reach + 1).astype(bool)
        # all places of an extended entry that have its smallest id; those with larger ids are gone already
        late = np.flatnonzero((s.own[s.order] == s.least[s.of]) & runs.any(axis=1)[s.of]) if len(s.order) else s.order
        which, l = np.nonzero(runs[s.of[late]])
        start = s.at[s.order[late[which]]] - l
        removed = G.union(s.words.n, np.concatenate((*begin, start)), np.concatenate((*end, start + window)))
        return _rows(block, s.words, removed)

    answers = B.materialize(B.answer(B.ask(blocks, first, way), _owners, way), "answers")
    late = B.second(B.answer(B.ask_again(blocks, answers, contexts, way), _extend, way))
    found = B.finish(blocks, answers.unionByName(late), result, SCHEMA, _ARROW)
    return found if row_col else found.drop("row")


def _rows(block: B.Block, words: G.Words, removed: np.ndarray) -> pa.Table:
    shas, spans = [], []
    count = np.concatenate(([0], np.cumsum(removed))) if len(removed) else np.zeros(1, np.int64)
    n_removed = count[words.first[1:]] - count[words.first[:-1]]
    for i in range(block.n):
        kept = block.text(i).split()
        cut = []
        if n_removed[i]:
            mask = removed[words.first[i] : words.first[i + 1]]
            turn = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
            cut = [{"first": int(a), "last": int(b)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            kept = [w for w, gone in zip(kept, mask.tolist(), strict=True) if not gone]
        spans.append(cut)
        shas.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table({"row": block.rows, "doc_id": block.ids.cast(pa.int64()), "n_words": np.diff(words.first), "n_removed": n_removed, "kept_sha256": shas, "spans": pa.array(spans, _ARROW.field("spans").type)})


def removed_texts(docs: DataFrame, window: int = 13, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the texts that stay: words joined by one space. A null text becomes empty.

    Rows are told apart by a number of their own, so rows that repeat an id or have none get their own text back; the smaller id still owns a passage.
    """
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")), "numbered")
    found = repeated_passages(numbered.select("row", F.col(f"doc.{id_col}").alias("id"), F.col(f"doc.{text_col}").alias("text")), window, seed, "id", "text", "row")
    joined = numbered.join(found.select(F.col("row").alias("_row"), "spans"), F.col("row") == F.col("_row"))
    words = F.filter(F.split(F.coalesce(F.col(f"doc.{text_col}"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    keep = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: ~F.exists("spans", lambda s: (x.i >= s.first) & (x.i < s.last)))
    text = F.array_join(F.transform(keep, lambda x: x.w), " ")
    return joined.select(*(text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
