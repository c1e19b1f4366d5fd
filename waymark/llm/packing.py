"""Operator 5, best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most `capacity` (`pieces`). Full pieces are sequences of their own.
The others are dealt into shards by row number; a shard is one packing problem of bounded size. `ISLANDS`
islands work on each shard with populations of their own:

* an individual gives each piece a bin. The first is best-fit decreasing, others best-fit random orders;
* crossover injects whole well-filled bins of one parent into the other, removes the other's bins that
  share a piece with them or are poorly filled, and puts the displaced pieces back by best fit, longest first: a piece with one or two others that fill
  a bin exactly, which no fit can better, else into the fullest bin that has room;
* after each of `EPOCHS` epochs an island's best individual migrates to the next island of its shard;
* an island stops early at the lower bound, ceil(tokens / capacity), or when `PATIENCE` children in a row save no bin.

The best island's packing stands. Bins that stayed poorly filled, a few per shard, are dissolved and packed again across
shards, level by level, until one shard holds them or nothing is gained.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.blocks import _cut, pack, unpack
from waymark.llm.scratch import materialize
from waymark.llm.tokens import encoder

CAPACITY = 2048
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION, PATIENCE = 8192, 2, 3, 40, 4, 6
WELL_FILLED, POOR = 0.98, 0.97

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; the first piece of a cut document is the short one. A null text is empty: just `end_id`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string()).fill_null("")
            numbers = batch.column(0).to_pylist()
            for a, b in _cut(np.asarray(pa.compute.binary_length(texts)), 8 << 20):
                ids, ends = code.encode(texts.slice(a, b - a))
                out: list[tuple] = []
                for i in range(b - a):
                    own = np.append(ids[ends[i] : ends[i + 1]], np.uint32(end_id)).astype("<u4")
                    size, at = (len(own) - 1) % capacity + 1, 0
                    for piece in range(-(-len(own) // capacity)):
                        part = own[at : at + size].tobytes()
                        out.append((numbers[a + i], piece, at, size, zlib.crc32(part), part))
                        at, size = at + size, capacity
                columns = list(zip(*out, strict=True))
                kinds = [*_PIECE.types, pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                names = [*_PIECE.names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays if with_ids else arrays[:-1], names if with_ids else names[:-1])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


# ---- one shard ----------------------------------------------------------------------------------------


def best_fit(length: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], capacity: int) -> None:
    """Put items, in the given order, into the fullest bin that has room, else a new one. Changes bins and room."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, free in enumerate(room):
        if free > 0:
            by_room.setdefault(free, []).append(b)
            mask |= 1 << free
    sizes = length[items].tolist()
    for item, size in zip(items.tolist(), sizes, strict=True):
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            held = by_room[free]
            b = held.pop()
            if not held:
                mask &= ~(1 << free)
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins[item] = b
        free -= size
        room[b] = free
        if free:
            by_room.setdefault(free, []).append(b)
            mask |= 1 << free


def _fresh(length: np.ndarray, order: np.ndarray, capacity: int) -> np.ndarray:
    bins = np.empty(len(length), np.int32)
    best_fit(length, order, bins, [], capacity)
    return bins


def fitness(length: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """Fewer bins first; then fuller ones (the mean squared fill, as usual for grouping problems)."""
    fill = np.bincount(bins, weights=length)
    return (-len(fill), float((fill**2).sum()))


def complete(length: np.ndarray, items: np.ndarray, bins: np.ndarray, room: list[int], capacity: int, rng: np.random.Generator) -> None:
    """Put items (longest first) into new bins that they fill exactly in ones, twos or threes, the rest by `best_fit`. Changes bins and room."""
    sizes = length[items]
    waiting: dict[int, deque[int]] = {}
    for item, size in zip(items.tolist(), sizes.tolist(), strict=True):
        waiting.setdefault(size, deque()).append(item)
    count = np.bincount(sizes, minlength=capacity + 1)
    left = []
    for item, size in zip(items.tolist(), sizes.tolist(), strict=True):
        if bins[item] >= 0:
            continue
        waiting[size].popleft()
        count[size] -= 1
        free = capacity - size
        if free == 0 or count[free]:
            partners = (free,) if free else ()
        else:
            half = free // 2
            pair = (count[1 : half + 1] > 0) & (count[free - 1 : free - half - 1 : -1] > 0)
            if half and free == 2 * half and count[half] < 2:
                pair[half - 1] = False
            found = np.flatnonzero(pair)
            if not len(found):
                left.append(item)
                continue
            one = int(found[rng.integers(len(found))]) + 1
            partners = (one, free - one)
        bins[item] = len(room)
        for partner in partners:
            bins[waiting[partner].pop()] = len(room)
            count[partner] -= 1
        room.append(0)
    best_fit(length, np.array(left, np.int64), bins, room, capacity)


def crossover(length: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(giver, weights=length)
    good = np.flatnonzero(fill >= WELL_FILLED * capacity)
    injected = np.zeros(len(fill), bool)
    injected[rng.choice(good, (len(good) + 1) // 2, replace=False) if len(good) else [int(fill.argmax())]] = True
    moved = injected[giver]
    broken = np.bincount(taker, weights=length) < WELL_FILLED * capacity
    broken[taker[moved]] = True
    stays = ~moved & ~broken[taker]
    child = np.full(len(length), -1, np.int32)
    _, child[moved] = np.unique(giver[moved], return_inverse=True)
    n = int(injected.sum())
    if stays.any():
        _, own = np.unique(taker[stays], return_inverse=True)
        child[stays] = own + n
        n += int(own.max()) + 1
    room = (capacity - np.bincount(child[child >= 0], weights=length[child >= 0], minlength=n)).astype(np.int64).tolist()
    displaced = np.flatnonzero(child < 0)
    complete(length, displaced[np.argsort(-length[displaced], kind="stable")], child, room, capacity, rng)
    return child


def evolve(length: np.ndarray, population: list[np.ndarray], capacity: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    if not population:
        population = [_fresh(length, np.argsort(-length, kind="stable"), capacity)]
    least = -(-int(length.sum()) // capacity)
    for _ in range(POPULATION - len(population)):
        if population[0].max() + 1 > least:
            population.append(_fresh(length, rng.permutation(len(length)), capacity))
    scores = [fitness(length, p) for p in population]
    idle = 0
    for _ in range(GENERATIONS):
        best = max(scores)[0]
        if -best <= least or len(population) < 2 or idle == PATIENCE:
            break
        a, b = rng.choice(len(population), 2, replace=False)
        child = crossover(length, population[a], population[b], capacity, rng)
        score = fitness(length, child)
        idle = 0 if score[0] > best else idle + 1
        worst = min(range(len(scores)), key=scores.__getitem__)
        if score > scores[worst] and score not in scores:
            population[worst], scores[worst] = child, score
    order = sorted(range(len(scores)), key=scores.__getitem__, reverse=True)[:POPULATION]
    return [population[i] for i in order]


_KEY = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending")]
STATE = "shard long, island int, blob binary"
_STATE = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("blob", pa.binary())])


def _level(rows: DataFrame, level: int, n_shards: int, capacity: int) -> DataFrame:
    """rows with shard -> rows with bin, fill and offset."""

    def start(table: pa.Table) -> pa.Table:
        shard, island = table["shard"][0].as_py(), table["island"][0].as_py()
        length = np.sort(table["length"].to_numpy())[::-1].copy()
        found = evolve(length, [], capacity, seed=shard * 1000 + island)
        return _state(shard, island, length, found)

    def _state(shard: int, island: int, length: np.ndarray, found: list[np.ndarray]) -> pa.Table:
        """The island's population, and its best individual for the next island."""
        own = [shard], [island], [pack(length, found)]
        elite = [shard], [(island + 1) % ISLANDS], [pack(length, found[:1])]
        return pa.table([pa.array(a + b, k) for a, b, k in zip(own, elite, _STATE.types, strict=True)], schema=_STATE)

    def migrate(epoch: int):
        def work(table: pa.Table) -> pa.Table:
            shard, island = table["shard"][0].as_py(), table["island"][0].as_py()
            states = sorted((unpack(b.as_py()) for b in table["blob"]), key=lambda s: -len(s[1]))
            length = states[0][0]
            people: list[np.ndarray] = []
            for _, found in states:
                people += [p for p in found if not any(np.array_equal(p, q) for q in people)]
            return _state(shard, island, length, evolve(length, people, capacity, seed=shard * 1000 + island + 100 * epoch))

        return work

    def place(key: tuple, table: pa.Table, states: pa.Table) -> pa.Table:
        length, best = None, None
        for blob in states["blob"]:
            length, found = unpack(blob.as_py())
            best = max([*found, *([] if best is None else [best])], key=lambda p: fitness(length, p))
        table = table.sort_by(_KEY)
        bins = best.astype(np.int64)
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(length[order])
        first = np.concatenate(([0], np.flatnonzero(np.diff(bins[order])) + 1))
        base = np.repeat(np.concatenate(([0], sums[first[1:] - 1])), np.diff(np.append(first, len(order))))
        offset = np.empty(len(order), np.int64)
        offset[order] = sums - length[order] - base
        fill = np.bincount(bins, weights=length).astype(np.int64)
        shard = table["shard"][0].as_py()
        sequence = pa.array((level << 58) + (shard << 24) + bins)
        return table.drop_columns(["shard"]).append_column("sequence_id", sequence).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill[bins]))

    islands = rows.select("shard", "length", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"))
    states = islands.groupBy("shard", "island").applyInArrow(start, STATE)
    for epoch in range(1, EPOCHS):
        states = states.groupBy("shard", "island").applyInArrow(migrate(epoch), STATE)
    joined = rows.groupBy("shard").cogroup(states.groupBy("shard"))
    return joined.applyInArrow(place, PIECE + ", sequence_id long, offset long, fill long")


def assign(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces (PIECE columns) with sequence_id and offset. `cut_pieces` should be a written table: rows are dealt by row number."""
    spark = cut_pieces.sparkSession
    numbered = cut_pieces.withColumn("_row", F.monotonically_increasing_id())
    full = numbered.filter(F.col("length") == capacity).select(*_PIECE.names, (F.lit(7 << 58).cast("long") + F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = numbered.filter(F.col("length") < capacity)
    parts, level = [full], 1
    count = rest.count()
    while count and level < 6:
        n = -(-count // SHARD)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("_row"), F.lit(n))).select(*_PIECE.names, "shard")
        placed = materialize(_level(dealt, level, n, capacity), f"level{level}")
        if n == 1:
            parts.append(placed.drop("fill"))
            break
        parts.append(placed.filter(F.col("fill") >= POOR * capacity).drop("fill"))
        rest = placed.filter(F.col("fill") < POOR * capacity).withColumn("_row", F.monotonically_increasing_id())
        left = rest.count()
        if left > 0.9 * count:
            parts.append(rest.drop("fill", "_row"))
            break
        count, level = left, level + 1
    else:
        if count:
            parts.append(rest.select(*_PIECE.names, "sequence_id", "offset"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p.select(*out.columns))
    return out if parts else spark.createDataFrame([], PIECE)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Every input row is packed, rows that repeat an id and rows without one too; a null or empty text is the end token alone.
    Sequences have no gaps from 0 and hold at most `capacity` tokens. Other columns are ignored; an empty table gives no rows.
    """
    return assign(materialize(pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The training sequences themselves: (sequence_id, n_tokens, ids as little-endian unsigned 32-bit integers)."""
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").alias("text")), "rows")
    cut_pieces = materialize(pieces(numbered, tokenizer, capacity, id_col="row", with_ids=True), "pieces")
    placed = assign(cut_pieces.drop("ids"), capacity)  # doc_id is the row's number: it names one row, whatever ids repeat or are missing
    joined = placed.join(cut_pieces.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    packed = joined.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return packed.select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x.ids)).alias("ids"))
