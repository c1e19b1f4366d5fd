"""Operator 3, exact dedup: owners in Patricia tries.

Texts are partitioned by (length, content hash), in partitions of bounded bytes; each inserts whole byte strings into
a compressed radix trie, whose terminal nodes hold the identifier that stays and the number
of rows. Equality is decided by the trie, byte by byte. Blocks of input rows first merge their
own equal texts, so a text that a third of all rows hold is shipped once per task's batch.

A trie that outgrows its memory spills by subtree: below its first branching point the largest subtree is cut off, and its strings, with those that
come later, leave the task as rows. They are written with the round's owners to shared storage and are the next
round's input, over twice as many partitions, until none is left. No task keeps a file of its own.

Rows then learn their owner by an equi-join on (length, SHA-256); the owner side is unique per key,
so Spark can split a hot key of the row side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import materialize
from waymark.llm.suffixes import common_prefix

MEMORY = 96 << 20
PARTITION = 48 << 20  # bytes of text, at most about so many in a partition of the first round
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


NODE = 200  # bytes a node counts besides its edge label


class Patricia:
    """Compressed radix trie over byte strings. A node is [children by first byte, value]; a child is (edge label, node)."""

    def __init__(self, merge):
        self.merge, self.root, self.size = merge, [{}, None], 0

    def insert(self, key: bytes, value) -> None:
        node, at = self.root, 0
        while at < len(key):
            child = node[0].get(key[at])
            if child is None:
                leaf = [{}, None]
                node[0][key[at]] = (key[at:], leaf)
                self.size += len(key) - at + NODE
                node, at = leaf, len(key)
                break
            label, below = child
            if key.startswith(label, at):
                node, at = below, at + len(label)
                continue
            common = common_prefix(label, key[at : at + len(label)])
            middle = [{label[common]: (label[common:], below)}, None]
            node[0][key[at]] = (label[:common], middle)
            self.size += NODE
            node, at = middle, at + common
        node[1] = value if node[1] is None else self.merge(node[1], value)

    def items(self) -> Iterator[tuple[bytes, object]]:
        return _items(self.root, b"")

    def cut(self) -> tuple[bytes, list] | None:
        """Take the largest subtree below the first branching point away: the prefix all its strings share, and its top node."""
        node, prefix = self.root, b""
        while node[1] is None and len(node[0]) == 1:
            label, node = next(iter(node[0].values()))
            prefix += label
        if not node[0]:
            return None  # a single string
        sizes = {byte: _size(label, below) for byte, (label, below) in node[0].items()}
        byte = max(sizes, key=sizes.get)
        label, below = node[0].pop(byte)
        self.size -= sizes[byte]
        return prefix + label, below


def _size(label: bytes, node: list) -> int:
    total, stack = len(label) + NODE, [node]
    while stack:
        for edge, below in stack.pop()[0].values():
            total += len(edge) + NODE
            stack.append(below)
    return total


def _items(node: list, prefix: bytes) -> Iterator[tuple[bytes, object]]:
    stack = [(node, prefix)]
    while stack:
        node, prefix = stack.pop()
        if node[1] is not None:
            yield prefix, node[1]
        stack += [(below, prefix + label) for label, below in node[0].values()]


class SpillingTrie:
    """A Patricia trie within `memory` bytes. Strings of subtrees that were cut off come back from `insert`."""

    def __init__(self, merge, memory: int = MEMORY):
        self.memory, self.trie = memory, Patricia(merge)
        self.gone: dict[int, set[bytes]] = {}  # prefixes of cut subtrees by length

    def insert(self, key: bytes, value) -> Iterator[tuple[bytes, object]]:
        """Strings (with their values) that have no place here."""
        if any(key[:n] in prefixes for n, prefixes in self.gone.items()):
            yield key, value
            return
        self.trie.insert(key, value)
        if self.trie.size > self.memory:
            while self.trie.size > self.memory // 2 and (taken := self.trie.cut()):
                prefix, node = taken
                self.gone.setdefault(len(prefix), set()).add(prefix)
                yield from _items(node, prefix)

    def items(self) -> Iterator[tuple[bytes, object]]:
        return self.trie.items()


def _merge(keep: str):
    pick = min if keep == "smallest" else max

    def merge(a: tuple, b: tuple) -> tuple:
        ids = [x[0] for x in (a, b) if x[0] is not None]
        return (pick(ids) if ids else None, a[1] + b[1])

    return merge


OWNERS = "length long, sha256 string, keep_id long, group_size long, text binary"


def exact_owners(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, memory: int = MEMORY) -> DataFrame:
    """One row per distinct text: (length, sha256, keep_id, group_size). Null texts are empty texts; A-Z fold to a-z if `fold_case`."""
    merge = _merge(keep)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple] = {}
        size = 0
        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                text = text or b""
                text = text.translate(_FOLD) if fold_case else text
                if (old := held.get(text)) is None:
                    held[text] = (number, 1)
                    size += len(text) + 100
                else:
                    held[text] = merge(old, (number, 1))
                if size > MEMORY // 4:
                    yield from _texts(held)
                    held, size = {}, 0
        yield from _texts(held)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, rows, size = SpillingTrie(merge, memory), [], 0
        for batch in batches:
            for text, number, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for spilled, (a, n) in trie.insert(text, (number, count)):
                    rows.append((len(spilled), None, a, n, spilled))
                    size += len(spilled)
                    if size > 8 << 20:
                        yield _owners(rows)
                        rows, size = [], 0
        for text, (number, count) in trie.items():
            rows.append((len(text), hashlib.sha256(text).hexdigest(), number, count, None))
            if len(rows) >= 10_000:
                yield _owners(rows)
                rows = []
        yield _owners(rows)

    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    texts = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(distinct, "text binary, id long, n long")
    owners = None
    while True:
        made = materialize(texts.repartition(parts, F.length("text"), F.xxhash64("text")).mapInArrow(own, OWNERS), "owners")
        done = made.filter("sha256 is not null").drop("text")
        owners = done if owners is None else owners.unionByName(done)
        texts = made.filter("sha256 is null").select("text", F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
        if not texts.limit(1).count():
            return owners
        parts *= 2


def _texts(held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())], ["text", "id", "n"])


def _owners(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["length", "sha256", "keep_id", "group_size", "text"])


def fold(text, fold_case: bool = True):
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.translate(text, UPPER, LOWER) if fold_case else text


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", fold_case: bool = True, columns: tuple[str, ...] | None = None) -> DataFrame:
    """All rows with keep_id, group_size, kept and text_sha256 (of the folded text in UTF-8).

    Of equal texts the row with the smallest (or largest) id stays; of several rows with that very id all count as kept
    (drop repeated rows first if ids repeat). A null id never stays unless the whole group has none,
    in which case all of it is kept with keep_id null. Null texts equal the empty text.
    Input columns named like a result column are replaced. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    owners = exact_owners(docs, keep, id_col, text_col, fold_case).select(F.col("length").alias("_len"), F.col("sha256").alias("_sha"), F.col("keep_id").alias("_keep"), F.col("group_size").alias("_size"))
    names = [c for c in (columns or docs.columns) if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    folded = fold(F.col(text_col), fold_case)
    rows = docs.select(*names, F.octet_length(folded).cast("long").alias("_l"), F.sha2(folded.cast("binary"), 256).alias("text_sha256"))
    joined = rows.join(owners, (F.col("_l") == F.col("_len")) & (F.col("text_sha256") == F.col("_sha")))
    return joined.select(*names, F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col(id_col).cast("long").eqNullSafe(F.col("_keep")).alias("kept"), "text_sha256")
