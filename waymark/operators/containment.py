"""Texts of similar size of which one holds most word n-grams of the other, in four shuffles of packed numbers.

* Blocks of texts send each bucket of 64-bit n-gram hashes their (n-gram, text) entries, each once, as steps of ascending numbers.
* Buckets number the n-grams that two texts or more hold and send only those on to the part of their text.
* Parts drop each text whose shared n-grams are too few for any pair, and put the others' in order, rarest first. Of texts that form a pair,
  the first ones (enough that a pair must meet there) have an n-gram in common.
* Texts that meet so are linked to the smallest key of the n-gram, never to each other; what is linked, directly or not, comes to one cell, which
  counts shared n-grams of its candidates exactly. Cells of too many n-grams are dealt into slices, each two of which meet.

N-grams are equal when their hashes are; a wrong count needs equal hashes of different n-grams inside one pair of texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.dedup import groups_of

U = np.uint64
#: n-grams of a block, a bucket and a cell; bytes of text hashed at once
BLOCK, BUCKET, CELL, STEP = 2_000_000, 2_000_000, 2_000_000, 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _constants(n: int, family: int) -> np.ndarray:
    return _mix(np.arange(n, dtype=U) * U(0x9E3779B97F4A7C15) + U(family * 0x632BE59BD9B4E019 % 2**64)) | U(1)


def _pack(*arrays: np.ndarray) -> bytes:
    """Eight-byte numbers by byte planes: high planes are mostly zero and vanish."""
    planes = [np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8).T).tobytes() for a in (np.ascontiguousarray(a) for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(planes))


def _unpack(payload: bytes) -> list[np.ndarray]:
    planes = pickle.loads(zstandard.ZstdDecompressor().decompress(payload))
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(np.int64).ravel() for p in planes]


def _steps(ordered: np.ndarray) -> np.ndarray:
    return np.diff(ordered, prepend=ordered.dtype.type(0))


def word_grams(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n words from each place, all in one line of one text. Words are runs of a-z, lines end at \\n."""
    letter = (data >= 97) & (data <= 122)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # words end with their text
    begin, end = letter.copy(), letter.copy()
    begin[1:] &= ~letter[:-1] | edge[1:-1]
    end[:-1] &= ~letter[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if len(starts) < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    hashes, table = np.zeros(len(starts), U), _mix(_constants(256, 1))
    cuts = np.searchsorted(starts, np.arange(0, len(data) + STEP, STEP))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a < b:
            size, part = ends[a:b] - starts[a:b], slice(starts[a], ends[b - 1])
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            letters = data[part][letter[part]]
            place = np.arange(len(letters)) - np.repeat(at, size)
            hashes[a:b] = _mix(np.add.reduceat(table[letters] * _constants(int(size.max()), 2)[place], at) + size.astype(U))
    text = np.searchsorted(offsets, starts, "right") - 1
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    m = len(starts) - n + 1
    total = np.zeros(m, U)
    for j, c in enumerate(_constants(n, 3)):
        total += hashes[j : j + m] * c
    whole = (text[:m] == text[n - 1 :]) & (line[:m] == line[n - 1 :])
    return _mix(total)[whole], text[:m][whole]


def _part(keys: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(U) ^ U(0xA5A5A5A5A5A5A5A5)) >> U(64 - bits)).astype(np.int64)


def _distinct(gram: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in order, each once; the keys of what was left out."""
    order = np.lexsort((key, gram))
    gram, key = gram[order], key[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])
    return gram[new], key[new], *np.unique(key[~new], return_counts=True)


def _cuts(ordered: np.ndarray, n: int) -> list[int]:
    return np.searchsorted(ordered, np.arange(n + 1)).tolist()


def _blocks(batches: Iterator[pa.RecordBatch], n: int, bits: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        gram, key, _, _ = _distinct(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        keys, sizes = np.unique(key, return_counts=True)
        order = np.argsort(_part(keys, bits), kind="stable")
        keys, sizes = keys[order], sizes[order]
        at, of = _cuts((gram >> U(64 - bits)).astype(np.int64), 1 << bits), _cuts(_part(keys, bits), 1 << bits)
        base, rows = np.array([key.min(initial=2**62)]), range(1 << bits)
        some = [b for b in rows if at[b] < at[b + 1] or of[b] < of[b + 1]]
        payloads = [_pack(base, _steps(gram[at[b] : at[b + 1]]), key[at[b] : at[b + 1]] - base, keys[of[b] : of[b + 1]], sizes[of[b] : of[b + 1]]) for b in some]
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])

    for batch in batches:
        texts, keys = batch.column(1).cast(pa.large_binary()), batch.column(0).to_numpy(zero_copy_only=False)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        first = 0
        while first < len(keys):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + STEP, "right")) - 1)
            gram, text = word_grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], n)
            held.append((gram, keys[first:last][text]))
            first = last
            if sum(len(g) for g, _ in held) >= BLOCK:
                yield sent()
    if held:
        yield sent()


def _bucket(table: pa.Table, bits: int) -> pa.Table:
    parts = [_unpack(p.as_py()) for p in table["payload"]]
    gram = np.concatenate([np.cumsum(p[1].view(U)) for p in parts])
    key = np.concatenate([p[2] + p[0] for p in parts])
    gram, key, twice, times = _distinct(gram, key)
    starts = np.flatnonzero(np.concatenate((np.ones(1, bool), gram[1:] != gram[:-1]))) if len(gram) else np.zeros(0, np.int64)
    df = np.diff(starts, append=len(gram))
    shared = np.repeat(df > 1, df)
    rank, df, key = np.repeat(np.cumsum(df > 1) - 1, df)[shared], np.repeat(df, df)[shared], key[shared]
    # sizes of the texts of this bucket's part, and what other blocks had counted again of any text
    keys, sizes = np.concatenate([*(p[3] for p in parts), twice]), np.concatenate([*(p[4] for p in parts), -times])
    part, of = _part(key, bits), _part(keys, bits)
    order, order_of = np.argsort(part, kind="stable"), np.argsort(of, kind="stable")
    rank, df, key, keys, sizes = rank[order], df[order], key[order], keys[order_of], sizes[order_of]
    at, at_of = _cuts(part[order], 1 << bits), _cuts(of[order_of], 1 << bits)
    some = [p for p in range(1 << bits) if at[p] < at[p + 1] or at_of[p] < at_of[p + 1]]
    number = np.array([table["bucket"][0].as_py()])
    base = np.array([key.min(initial=2**62)])
    payloads = [_pack(number, base, _steps(rank[at[p] : at[p + 1]]), key[at[p] : at[p + 1]] - base, df[at[p] : at[p + 1]], keys[at_of[p] : at_of[p + 1]], sizes[at_of[p] : at_of[p + 1]]) for p in some]
    return pa.table({"part": pa.array(some, pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _texts(table: pa.Table, least: Fraction) -> pa.Table:
    """Texts that hold more than `least` of their n-grams in common with others; those n-grams, rarest first."""
    parts = [_unpack(p.as_py()) for p in table["payload"]]
    gram = np.concatenate([(p[0] << 32) + np.cumsum(p[2]) for p in parts])
    key, df = np.concatenate([p[3] + p[1] for p in parts]), np.concatenate([p[4] for p in parts])
    keys, where = np.unique(np.concatenate([p[5] for p in parts]), return_inverse=True)
    sizes = np.zeros(len(keys), np.int64)
    np.add.at(sizes, where, np.concatenate([p[6] for p in parts]))
    order = np.lexsort((gram, df, key))
    gram, key = gram[order], key[order]
    found = np.bincount(np.searchsorted(keys, key), minlength=len(keys))
    need = sizes * least.numerator // least.denominator + 1
    stays = (found >= need) & (found > 0)
    gram = gram[np.repeat(stays, found)]
    ends = np.concatenate(([0], np.cumsum(found[stays])))
    grams = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends * 8), pa.py_buffer(gram)]).cast(pa.binary())
    return pa.table({"key": keys[stays], "n": sizes[stays], "first": (found - need + 1)[stays], "found": found[stays], "grams": grams})


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, len(batch), 2000):
            rows = batch.slice(low, 2000)
            first = rows.column(1).to_numpy()
            gram = np.concatenate([np.frombuffer(g.as_buffer(), np.int64, m) for g, m in zip(rows.column(2), first.tolist(), strict=True)])
            key = np.repeat(rows.column(0).to_numpy(), first)
            order = np.argsort(gram, kind="stable")
            gram, key = gram[order], key[order]
            buckets = np.unique(gram >> 32)
            at = [*np.searchsorted(gram >> 32, buckets).tolist(), len(gram)]
            payloads = [_pack(_steps(gram[a:b]), key[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _stars(table: pa.Table) -> pa.Table:
    """Each text of an n-gram with its smallest; each such link once."""
    parts = [_unpack(p.as_py()) for p in table["payload"]]
    gram, key, _, _ = _distinct(np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts]))
    new = np.concatenate((np.ones(1, bool), gram[1:] != gram[:-1]))
    low = key[np.flatnonzero(new)][np.cumsum(new) - 1]
    a, b, _, _ = _distinct(low[low != key], key[low != key])
    return pa.table({"a": a, "b": b})


def _cell(table: pa.Table, containment: Fraction, ratio: Fraction) -> pa.Table:
    """Pairs of the cell; in a cell of two slices only those across."""
    table = table.sort_by([("n", "ascending"), ("key", "ascending")])
    keys, n, found = (table[c].to_numpy() for c in ("key", "n", "found"))
    side, cross = table["side"].to_numpy(), table["i"][0].as_py() != table["j"][0].as_py()
    ids, gram = np.unique(np.concatenate([np.frombuffer(g.as_buffer(), np.int64) for g in table["grams"]]), return_inverse=True)
    text = np.repeat(np.arange(len(n)), found)
    df = np.bincount(gram, minlength=len(ids))
    order = np.lexsort((gram, df[gram], text))  # rarest of the cell first: an order that all texts share
    gram = gram[order]
    starts = np.concatenate(([0], np.cumsum(found)))
    share = containment * ratio
    small = np.maximum(0, found - n * containment.numerator // containment.denominator)  # a pair shares more than that of the smaller
    large = np.maximum(0, found - n * share.numerator // share.denominator)
    lead = (np.arange(len(gram)) - starts[text]) < large[text]
    by = np.argsort(gram[lead], kind="stable")
    post, at = text[lead][by], np.searchsorted(gram[lead][by], np.arange(len(ids) + 1))
    # larger texts come later; the last one whose size is near enough
    until = np.searchsorted(n, (n * ratio.denominator + ratio.numerator - 1) // ratio.numerator, "left")
    mark, out = np.zeros(len(ids), bool), []
    for a in range(len(n)):
        if not small[a]:
            continue
        own = gram[starts[a] : starts[a + 1]]
        lists = [post[at[g] : at[g + 1]] for g in own[: small[a]].tolist() if at[g + 1] - at[g] > 1]
        if not lists:
            continue
        near = np.concatenate(lists)
        near = near[(near > a) & (near < until[a])]
        if cross:
            near = near[side[near] != side[a]]
        near = np.unique(near)
        if not len(near):
            continue
        mark[own] = True
        for some in np.array_split(near, 1 + int(found[near].sum()) // CELL):
            if len(some):
                heads = np.concatenate(([0], np.cumsum(found[some])[:-1]))
                spots = np.repeat(starts[some] - heads, found[some]) + np.arange(int(found[some].sum()))
                shared = np.add.reduceat(mark[gram[spots]].astype(np.int64), heads)
                good = shared * containment.denominator > containment.numerator * n[a]
                out.append((np.full(good.sum(), keys[a]), keys[some[good]], shared[good]))
        mark[own] = False
    a, b, shared = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "shared": shared})


def contained_pairs(texts: DataFrame, key: str, text: str, fold: Callable[[Column], Column], n: int, containment: float, size_ratio: float, bucket: int = BUCKET, cell: int = CELL) -> DataFrame:
    """texts (key long, text, folded to words of a-z by `fold`) -> pairs a < b of keys with the count of distinct n-grams that both hold: more than `containment` of the
    smaller's, which has more than `size_ratio` of the larger's. Rows of one key are one text."""
    part, whole = Fraction(str(size_ratio)), Fraction(str(containment))
    texts = texts.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).filter("key is not null and text is not null")
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, (letters // 7 // bucket).bit_length())
    folded = texts.select("key", fold(F.col("text")).alias("text"))
    sent = folded.mapInArrow(lambda batches: _blocks(batches, n, bits), "bucket int, payload binary")
    shared = sent.groupBy("bucket").applyInArrow(lambda t: _bucket(t, bits), "part int, payload binary")
    schema = "key long, n long, first long, found long, grams binary"
    held = _kept(shared.groupBy("part").applyInArrow(lambda t: _texts(t, part * whole), schema))
    firsts = held.select("key", "first", "grams").mapInArrow(_firsts, "bucket int, payload binary")
    links = firsts.groupBy("bucket").applyInArrow(_stars, "a long, b long").distinct()
    grouped = held.join(groups_of(links, "a", "b"), F.col("key") == F.col("node")).select("group", "key", "n", "found", "grams")
    weight = grouped.groupBy(F.col("group").alias("_g")).agg(F.sum("found").alias("_w"))
    cells = max(1, letters // 7 // 2 // cell)  # about an eighth of all n-grams comes so far
    dealt = grouped.join(weight, F.col("group") == F.col("_g"))
    dealt = dealt.withColumn("slices", F.ceil(F.col("_w") / cell).cast("int")).withColumn("side", F.pmod(F.xxhash64("key"), "slices").cast("int"))
    dealt = dealt.withColumn("cell", F.when(F.col("slices") > 1, F.col("group")).otherwise(-1 - F.pmod(F.xxhash64("group"), F.lit(cells))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = dealt.select("cell", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), (F.col("slices") > 1).alias("split"), "side", "key", "n", "found", "grams")
    return dealt.groupBy("cell", "split", "i", "j").applyInArrow(lambda t: _cell(t, whole, part), "a long, b long, shared long")


def _kept(rows: DataFrame) -> DataFrame:
    return rows.checkpoint() if rows.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else rows.persist()
