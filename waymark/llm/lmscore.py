"""Operator 1, language-model scoring: stupid backoff over the corpus's own counts.

Score of a word after its context: count(context word) / count(context) when the n-gram is
in the model, else `backoff` times the score after a context one word shorter, down to
count(word) / all words. The model holds unigrams and the n-grams that occur at least
`min_count` times (the usual pruning; without it no n-gram of a corpus scored by
its own counts could ever back off).

Plan, over blocks of documents (`blocks`), which explode their n-grams of all orders:

1. Which n-grams occur twice anywhere? Blocks send short fingerprints of their distinct n-grams, some bits more than the
   corpus has words; a fingerprint that comes from one place only belongs to an n-gram of count one. It is not in the model
   and is nobody's context that matters, as a known n-gram's context occurs at least as often as itself. Exact: two
   n-grams with one fingerprint are both asked for.
2. The others, with their counts in the block, go to the count table, which is partitioned by n-gram hash (64 bits, and 32
   more as a check). It sums counts over blocks, and totals join back to the asking block. Orders take rounds of their own.
3. Each occurrence takes its log score; scores are summed per document.

An n-gram leaves a block once, so frequent ones are one row per block, whatever their share of all words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import blocks as B
from waymark.llm import grams as G

SCHEMA = "doc_id long, n_words long, n_backoffs long, log_score double, mean_log_score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_backoffs", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
SPARE_BITS = 4  # of a fingerprint, beyond one bit pattern per n-gram of the corpus: one in 16 is asked for in vain


def _hashes(words: G.Words, k: int, family: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams inside one document, and the word each ends at."""
    at = np.flatnonzero(np.arange(words.n) - words.first[:-1][words.doc] >= k - 1) if words.n else np.zeros(0, np.int64)
    return (G.grams(words.hashes[0], k, family + k)[at - k + 1] if words.n else np.zeros(0, G.U)), at


def _prints(block: B.Block, order: int, bits: int, n_buckets: int):
    """Per bucket and order: ascending fingerprints, how many, and which of them occur more than once in the block."""
    words, shift = G.Words(block, families=1), G.U(64 - bits)
    found = []
    for k in range(2, order + 1):
        prints, count = np.unique(_hashes(words, k)[0] >> shift, return_counts=True)
        found.append((prints, count > 1, B.bounds(prints << shift, n_buckets)))
    for bucket in sorted({b for *_, e in found for b in e.used()}):
        cut = [(p[e[bucket] : e[bucket + 1]], m[e[bucket] : e[bucket + 1]]) for p, m, e in found]
        yield bucket, B.pack(*((B.planes(p), len(p), np.packbits(m)) for p, m in cut))


def _repeated(block_of: list[int], payloads: list[tuple]):
    """To each block and order one bit per fingerprint: does it occur twice anywhere?"""
    told: list[list[np.ndarray]] = [[] for _ in payloads]
    for parts in zip(*payloads, strict=True):
        prints = np.concatenate([B.unplanes(p[0]) for p in parts])
        many = np.concatenate([np.unpackbits(p[2], count=p[1]) for p in parts]).astype(bool)
        order, begin = G.groups(prints)
        size = np.diff(np.append(begin, len(order)))
        twice = np.zeros(len(prints), bool)
        if len(prints):
            twice[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], begin), size)
        at = 0
        for i, p in enumerate(parts):
            told[i].append(np.packbits(twice[at : at + p[1]]))
            at += p[1]
    for block, bits in zip(block_of, told, strict=True):
        yield block, B.pack(*bits)


class _Grams:
    """Distinct k-grams of a block, sorted by hash; `of` is the entry of the k-gram that ends at each of the words `place`.

    `asked` are the entries whose count the block cannot know by itself.
    """

    def __init__(self, words: G.Words, k: int, bits: int, answers: dict[int, tuple], n_buckets: int):
        hashes, self.place = _hashes(words, k)
        self.k, self.words = k, words
        self.key, self.first, self.of, self.count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        self.asked = np.ones(len(self.key), bool)
        if k > 1 and bits:
            shift = G.U(64 - bits)
            prints = self.key >> shift
            new = np.ones(len(prints), bool)
            new[1:] = prints[1:] != prints[:-1]
            edge = B.bounds(prints[new] << shift, n_buckets)
            twice = np.zeros(int(new.sum()), bool)
            for bucket, told in ((b, a) for b, a in answers.items() if b < B.SECOND):
                a, b = edge[bucket], edge[bucket + 1]
                twice[a:b] = np.unpackbits(told[k - 2], count=b - a)
            self.asked = twice[np.cumsum(new) - 1]

    def entries(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, check (half of another hash) and count of what is asked for."""
        check = _hashes(self.words, self.k, 80)[0][self.first[self.asked]]
        return self.key[self.asked], (check >> G.U(32)).astype(np.uint32), self.count[self.asked]


def _sum(block_of: list[int], payloads: list[tuple]):
    key = np.concatenate([B.unplanes(p[0]) for p in payloads])
    check, count = (np.concatenate([p[i] for p in payloads]) for i in (1, 2))
    order, begin = G.groups(key, check)
    total = np.empty(len(key), np.int64)
    total[order] = np.repeat(np.add.reduceat(count[order].astype(np.int64), begin), np.diff(np.append(begin, len(order))))
    at = 0
    for block, p in zip(block_of, payloads, strict=True):
        mine = total[at : at + len(p[2])]
        at += len(p[2])
        yield block, B.pack(_narrow(mine))


def _narrow(count: np.ndarray) -> np.ndarray:
    most = count.max(initial=0)
    return count.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.int64)


def stupid_backoff(docs: DataFrame, order: int = 2, min_count: int = 2, backoff: float = 0.4, id_col: str = "doc_id", text_col: str = "text", fan_bits: int | None = None) -> DataFrame:
    """Per document: words, words scored after a shorter context than they had, the sum of natural-log scores, and the mean
    (null without words). Words are `[^\\x20\\x09-\\x0D]+`, unchanged; contexts do not cross documents.

    One row per input row; null ids and repeated rows are kept (and counted); a null text has no words and
    score 0; other columns are ignored; an empty table gives no rows.
    """
    if order < 1 or not 0 < backoff <= 1 or min_count < 1:
        raise ValueError("order and min_count start at 1, backoff lies in (0, 1]")
    blocks = B.build(docs, id_col, text_col)
    way = B.post(blocks, fan_bits=fan_bits)
    n_buckets = way.n_buckets

    def words(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array([G.Words(B.Block(blob.as_py()), families=0).n], pa.int64())], ["n"])

    all_words = blocks.select("blob").mapInArrow(words, "n long").agg(F.sum("n")).first()[0] or 0
    # without pruning every n-gram is in the model, so all are asked for
    bits = min(64, (all_words * (order - 1)).bit_length() + SPARE_BITS) if min_count > 1 and order > 1 else 0
    rounds = [(1, 2), *((k,) for k in range(3, order + 1))] if order > 1 else [(1,)]

    def grams(ks: tuple[int, ...]):
        """Orders of one round share a payload; several rounds, each written and its shuffle dropped, bound the disk that is held at once."""

        def question(block: B.Block, answers: dict[int, tuple]):
            words = G.Words(block, families=1)
            key, check, count = (np.concatenate(x) for x in zip(*(_Grams(words, k, bits, answers, n_buckets).entries() for k in ks), strict=True))
            order_ = np.argsort(key, kind="stable")
            key, check, count = key[order_], check[order_], count[order_]
            edge = B.bounds(key, n_buckets)
            for bucket in edge.used():
                mine = slice(edge[bucket], edge[bucket + 1])
                yield bucket, B.pack(B.planes(key[mine]), check[mine], _narrow(count[mine]))

        return question

    def totals(found: list[_Grams], answers: dict[int, tuple]) -> list[np.ndarray]:
        """The corpus count of every entry; what was not asked for occurs once."""
        out = [np.ones(len(g.key)) for g in found]
        for number, ks in enumerate(rounds, 1):
            told = [a[0] for b, a in sorted(answers.items()) if b // B.SECOND == number]
            told = np.concatenate(told) if told else np.zeros(0)
            keys = np.concatenate([found[k - 1].key[found[k - 1].asked] for k in ks])
            back = np.empty(len(keys))
            back[np.argsort(keys, kind="stable")] = told
            at = 0
            for k in ks:
                n = int(found[k - 1].asked.sum())
                out[k - 1][found[k - 1].asked] = back[at : at + n]
                at += n
        return out

    def result(block: B.Block, answers: dict[int, tuple]) -> pa.Table:
        w = G.Words(block, families=1)
        found = [_Grams(w, k, bits, answers, n_buckets) for k in range(1, order + 1)]
        total = totals(found, answers)
        score = np.log(total[0][found[0].of] / all_words) if w.n else np.zeros(0)
        used, had = np.ones(w.n, np.int64), np.ones(w.n, np.int64)
        for k in range(2, order + 1):
            this, shorter = found[k - 1], found[k - 2]
            at = this.place
            score[at] += np.log(backoff)
            had[at] = k
            count = total[k - 1][this.of]
            # the context is the (k-1)-gram that ends one word earlier
            context = total[k - 2][shorter.of][np.searchsorted(shorter.place, at - 1)]
            known = count >= min_count
            score[at[known]] = np.log(count[known] / context[known])
            used[at[known]] = k
        n = np.diff(w.first)
        total_score = np.add.reduceat(np.append(score, 0.0), w.first[:-1]) if block.n else np.zeros(0)
        total_score = np.where(n > 0, total_score, 0.0)
        short = np.concatenate(([0], np.cumsum(used < had)))
        mean = pa.array(total_score / np.maximum(n, 1), mask=n == 0)
        return pa.table({"doc_id": block.ids.cast(pa.int64()), "n_words": n, "n_backoffs": short[w.first[1:]] - short[w.first[:-1]], "log_score": total_score, "mean_log_score": mean})

    repeated = blocks.sparkSession.createDataFrame([], B.MESSAGE)
    if bits:
        repeated = B.materialize(B.answer(B.ask(blocks, lambda block: _prints(block, order, bits, n_buckets), way), _repeated, way), "repeated")
    answers = repeated
    for number, ks in enumerate(rounds, 1):
        told = B.answer(B.ask_again(blocks, repeated, grams(ks), way), _sum, way)
        answers = answers.unionByName(B.second(B.materialize(told, "counts"), number))
    return B.finish(blocks, answers, result, SCHEMA, _ARROW)
