"""Question-and-answer rounds between blocks of documents and hash buckets.

Several operators must know, for each of very many short keys of a text (word
n-grams, seeds), what the whole corpus holds under that key. One row per key
occurrence would cost several times the corpus in shuffles and lets a frequent
key flood one task. Here

* documents are packed once into compressed blocks of a few MB, written to shared
  storage (`build`); block numbers are therefore fixed, whatever is retried later;
* `ask` turns each block into one payload per bucket. A payload holds every key
  of the block at most once (map-side combining), so a key that a third of all
  documents hold reaches its bucket once per block;
* `answer` sees all payloads of a bucket and returns one payload per asking block;
* `apply` joins blocks with their answers, to ask again or to make result rows.

Buckets and blocks are bounded in bytes; their numbers grow with the corpus, and the number of pairs of them with its square.
So payloads travel one by one only while there are few buckets. Beyond 2**`FAN_BITS` of them they travel in
bundles, by as many hops as the bucket's number has digits of `FAN_BITS` bits: a block makes one bundle per first digit; a hop
collects bundles of many blocks for one digit, deals their payloads by the next digit, and bundles those again. A
hop therefore has at most 2**`FAN_BITS` rows per block, in proportion to the corpus. Answers go back the same way (`Post`).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import materialize

BLOCK_BYTES = 4 << 20
BUCKET_TEXT_BYTES = 12 << 20
FAN_BITS = 9

MESSAGE = "bucket int, block long, payload binary"


def pack(*arrays: object) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, protocol=5))


def unpack(payload: bytes) -> tuple:
    return pickle.loads(_raw(payload))


_ZSTD = b"\x28\xb5\x2f\xfd"  # fixed value: how a zstd frame begins


def _raw(payload: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(payload) if payload[:4] == _ZSTD else payload


def planes(ordered: np.ndarray) -> np.ndarray:
    """Ascending uint64 numbers as the eight byte planes of their steps: high planes are zero and vanish in `pack`."""
    steps = np.diff(ordered, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T)


def unplanes(steps: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(steps.T).view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


class bounds:
    """Ascending uint64 keys cut into buckets, equal key ranges; their number is a power of two. `x[bucket]` is where a bucket begins."""

    def __init__(self, keys: np.ndarray, n_buckets: int):
        self.keys, self.n, self.bits = keys, n_buckets, _bits(n_buckets)
        assert n_buckets == 1 << self.bits

    def __getitem__(self, bucket: int) -> int:
        if bucket >= self.n:
            return len(self.keys)
        return int(np.searchsorted(self.keys, np.uint64(int(bucket) << (64 - self.bits)))) if bucket else 0

    def used(self) -> list[int]:
        """Buckets that hold a key; the work does not grow with the number of buckets."""
        return np.unique(self.keys >> np.uint64(64 - self.bits)).tolist() if self.bits else [0] * bool(len(self.keys))


class Block:
    """Documents of one block: ids, and texts as one byte buffer."""

    def __init__(self, blob: bytes):
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)) as reader:
            self._load(pa.Table.from_batches(reader))

    def _load(self, batch: pa.Table) -> None:
        batch = batch.combine_chunks()
        self.batch = batch
        self.ids, text, *row = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in batch.columns)
        self.n = len(text)
        #: a number of its own for each row of the corpus, whatever its id
        self.rows = row[0].to_numpy() if row else np.arange(self.n)
        text = text.cast(pa.large_binary()).fill_null(b"")
        buffers = text.buffers()
        self.offsets = np.frombuffer(buffers[1], dtype=np.int64)[text.offset : text.offset + self.n + 1] if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.bytes = data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]

    @classmethod
    def of(cls, ids: pa.Array, texts: pa.Array) -> Block:
        """A block from columns, without packing."""
        block = cls.__new__(cls)
        block._load(pa.table({"id": ids, "text": texts.cast(pa.large_string())}))
        return block

    def id_order(self) -> np.ndarray:
        """Ids as integers; a missing id counts as larger than any other."""
        return self.ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()

    def text(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()


def _cut(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += int(size) + 64
    if begin < len(sizes):
        yield begin, len(sizes)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """Blocks of whole documents: (block, n_docs, n_bytes, blob). Every row is kept, nulls included. Rows get numbers of their own, or those in `row_col`."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        row = part << 36
        for batch in batches:
            table = pa.table({"id": batch.column(0), "text": batch.column(1).cast(pa.large_string()), "row": batch.column(2) if row_col else np.arange(row, row + len(batch))})
            row += len(batch)
            lengths = np.asarray(pa.compute.binary_length(table["text"]).fill_null(0)) if len(table) else np.zeros(0, np.int64)
            for a, b in _cut(lengths, block_bytes):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table.slice(a, b - a))
                blob = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict({"block": pa.array([(part << 32) + made], pa.int64()), "n_docs": pa.array([b - a], pa.int32()), "n_bytes": pa.array([int(lengths[a:b].sum())], pa.int64()), "blob": pa.array([blob], pa.binary())})
                made += 1

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).cast("long").alias("row")] if row_col else []))
    return materialize(rows.mapInArrow(make, "block long, n_docs int, n_bytes long, blob binary"), "blocks", "uncompressed")


def _bits(n: int) -> int:
    return max(0, (n - 1).bit_length())


class Route:
    """From `n_from` places to `n_to`. After hop h a message is where the first h digits of its destination and the first, h digits fewer, of its origin say."""

    def __init__(self, n_from: int, n_to: int, fan_bits: int):
        self.from_bits, self.to_bits, self.fan = _bits(n_from), _bits(n_to), fan_bits
        self.hops = max(1, -(-self.to_bits // fan_bits))

    def at(self, hop: int, to: int, origin: int) -> int:
        known = hop * self.fan
        left = max(0, self.from_bits - known)
        return (to >> (self.to_bits - known)) << left | origin >> (self.from_bits - left)


class Post:
    """The numbers of blocks and buckets, and the ways between them. Spread block numbers serve as their addresses."""

    def __init__(self, n_blocks: int, n_buckets: int, fan_bits: int):
        self.n_blocks, self.n_buckets = n_blocks, n_buckets
        self.ask, self.answer = Route(n_blocks, n_buckets, fan_bits), Route(n_buckets, n_blocks, fan_bits)

    def address(self, block: int) -> int:
        bits = _bits(self.n_blocks)
        return (block * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> (64 - bits) if bits else 0

    def place(self, back: bool, hop: int, bucket: int, block: int) -> int:
        return self.answer.at(hop, self.address(block), bucket) if back else self.ask.at(hop, bucket, self.address(block))


def post(blocks: DataFrame, text_per_bucket: int | None = None, fan_bits: int | None = None) -> Post:
    """Buckets in proportion to the bytes of text, at least one per shuffle partition."""
    total, n = blocks.agg(F.sum("n_bytes"), F.count("*")).first()
    least = max(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // (text_per_bucket or BUCKET_TEXT_BYTES)), 1)
    return Post(n, 1 << _bits(least), fan_bits or FAN_BITS)


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["bucket", "block", "payload"])


Row = tuple[int, int, bytes]  # bucket, block, payload
HOP = "at long, bundle binary"
_HOP = pa.schema([("at", pa.int64()), ("bundle", pa.binary())])
_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("payload", pa.binary())])


def _bundles(rows: Iterable[Row], key: Callable[[int, int], object]) -> dict[object, bytes]:
    held: dict[object, list[Row]] = {}
    for bucket, block, payload in rows:
        held.setdefault(key(bucket, block), []).append((bucket, block, _raw(payload)))
    return {k: zstandard.ZstdCompressor(level=1).compress(pickle.dumps(v, protocol=5)) for k, v in held.items()}


def _open(bundle: bytes) -> list[Row]:
    return pickle.loads(_raw(bundle))


def _sent(rows: Iterable[Row], way: Post, back: bool) -> pa.Table:
    """What leaves one block or bucket: its payloads, or bundles of them for the first hop."""
    route = way.answer if back else way.ask
    if route.hops == 1:
        held = list(rows)
        return pa.Table.from_batches([_batch(held)] if held else [], schema=_SCHEMA)
    return _hop_table(_bundles(rows, lambda bucket, block: way.place(back, 1, bucket, block)))


def _hop_table(bundles: dict[object, bytes]) -> pa.Table:
    return pa.table([pa.array(list(bundles), pa.int64()), pa.array(list(bundles.values()), pa.binary())], schema=_HOP)


def _travel(sent: DataFrame, way: Post, back: bool) -> DataFrame:
    """Bundles go hop by hop; at the last, all payloads that one hop has for a bucket (or block) are one row, under the number -1 of whence they come."""
    route = way.answer if back else way.ask
    if route.hops == 1:
        return sent

    def hop(number: int):
        def run(table: pa.Table) -> pa.Table:
            rows = (row for bundle in table.column("bundle") for row in _open(bundle.as_py()))
            return _hop_table(_bundles(rows, lambda bucket, block: way.place(back, number, bucket, block)))

        return run

    def deliver(table: pa.Table) -> pa.Table:
        rows = (row for bundle in table.column("bundle") for row in _open(bundle.as_py()))
        arrived = _bundles(rows, lambda bucket, block: block if back else bucket)
        rows = [(-1, to, b) if back else (to, -1, b) for to, b in arrived.items()]
        return pa.Table.from_batches([_batch(rows)] if rows else [], schema=_SCHEMA)

    for number in range(2, route.hops):
        sent = sent.groupBy("at").applyInArrow(hop(number), HOP)
    return sent.groupBy("at").applyInArrow(deliver, MESSAGE)


def ask(blocks: DataFrame, question: Callable[[Block], Iterable[tuple[int, bytes]]], way: Post) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = ((bucket, block, payload) for bucket, payload in question(Block(blob.as_py())))
                yield from _sent(rows, way, False).to_batches(max_chunksize=1000)

    return _travel(blocks.select("block", "blob").mapInArrow(run, MESSAGE if way.ask.hops == 1 else HOP), way, False)


def answer(questions: DataFrame, reply: Callable[[list[int], list[tuple]], Iterable[tuple[int, bytes]]], way: Post, back: bool = True) -> DataFrame:
    """reply(blocks, payloads) gives (block, payload) for those blocks that get one. `back`: these are blocks that asked, not other numbers."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        rows: list[tuple[int, bytes]] = []
        for block, payload in zip(table.column("block").to_pylist(), table.column("payload"), strict=True):
            rows += [(block, payload.as_py())] if block >= 0 else [(b, p) for _, b, p in _open(payload.as_py())]
        rows.sort(key=lambda row: row[0])
        told = ((bucket, b, p) for b, p in reply([b for b, _ in rows], [unpack(p) for _, p in rows]))
        if back:
            return _sent(told, way, True)
        held = list(told)
        return pa.Table.from_batches([_batch(held)] if held else [], schema=_SCHEMA)

    told = questions.groupBy("bucket").applyInArrow(run, HOP if back and way.answer.hops > 1 else MESSAGE)
    return _travel(told, way, True) if back else told


def _joined(blocks: DataFrame, answers: DataFrame, work: Callable, schema: str) -> DataFrame:
    left = blocks.select("block", "blob").groupBy("block")
    return left.cogroup(answers.groupBy("block")).applyInArrow(work, schema)


def ask_again(blocks: DataFrame, answers: DataFrame, question: Callable[[Block, dict[int, tuple]], Iterable[tuple[int, bytes]]], way: Post) -> DataFrame:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _sent([], way, False)
        block = left.column("block")[0].as_py()
        rows = ((b, block, p) for b, p in question(Block(left.column("blob")[0].as_py()), _answers(right)))
        return _sent(rows, way, False)

    return _travel(_joined(blocks, answers, run, MESSAGE if way.ask.hops == 1 else HOP), way, False)


def _answers(table: pa.Table) -> dict[int, tuple]:
    out = {}
    for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True):
        if bucket >= 0:
            out[bucket] = unpack(payload.as_py())
        else:
            out |= {b - (bucket + 1) * SECOND: unpack(p) for b, _, p in _open(payload.as_py())}
    return out


def finish(blocks: DataFrame, answers: DataFrame, result: Callable[[Block, dict[int, tuple]], pa.Table], schema: str, empty: pa.Schema) -> DataFrame:
    """One table of result rows per block. Answers of a second round use buckets shifted by `SECOND`."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return empty.empty_table()
        return result(Block(left.column("blob")[0].as_py()), _answers(right)).cast(empty)

    return _joined(blocks, answers, run, schema)


SECOND = 1 << 27


def second(answers: DataFrame, later: int = 1) -> DataFrame:
    """Answers of a later round: their buckets are shifted by `SECOND` for each round before it, those of bundles when they are opened."""
    bucket = F.col("bucket")
    return answers.withColumn("bucket", F.when(bucket < 0, bucket - later).otherwise(bucket + F.lit(later * SECOND)).cast("int"))
