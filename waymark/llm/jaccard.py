"""Operator 7, n-gram Jaccard join by vertical partitioning.

Documents are sets of word `k`-grams (A-Z in lower case). Two of them link when their Jaccard similarity reaches `percent`.

1. Global order. n-grams that more than a few documents hold come last, all others first, each
   part by hash. (The list of frequent ones is bounded, see `_frequent`. It shapes the order only, never the result.)
2. Candidates. Sets that link share an n-gram among the first n - ceil(percent * n) + 1 of each, in that order,
   and the first they share lies early enough in both for the needed overlap (positional filter). Buckets of n-grams
   hold these prefixes. Documents with equal sets are one class with one representative from
   here on. A short posting list gives its passing pairs; a long one (a group of near copies) first links all to one
   centre; only what its components leave apart is compared later.
3. Vertical partitioning. Candidate pairs are dealt to cells, with each set a cell needs once. The order is cut into
   fragments; sets travel cut into them, and each fragment of a cell is counted by itself, in a task of its own, with an inverted
   index. That gives partial overlaps, which a shuffle sums per pair. (What long lists leave apart is chosen pair by pair as components grow, so there
   the fragments of a cell are counted one after the other, and a pair is dropped when the rest cannot save it.)
4. Links are closed to components. Copies get their representative's component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm import blocks as B
from waymark.llm import grams as G
from waymark.llm.components import components
from waymark.llm.scratch import materialize

FRAGMENTS = 4
COUNTED = 0.45
FREQUENT = 1 << 20
SHORT_LIST = 24
PAIRS_PER_CELL = 4_000
GRAMS_PER_CELL = 4_000_000
GRAMS_PER_FRAGMENT = 500_000
SLICE = 4_000
ROWS = 4_000
SALTS = 16
PREFIX_TEXT = 40 << 20


class Sets:
    """Distinct n-grams of each document of a block: `gram`, `doc` sorted by document, `first` of each document, sizes, digests."""

    def __init__(self, block: B.Block, k: int):
        w = G.Words(block, lower=True, families=1)
        n_words = np.diff(w.first)
        count = np.maximum(n_words - k + 1, 0)
        ends = np.cumsum(count)
        gram = G.grams(w.hashes[0], k, 60)[np.repeat(w.first[:-1] - (ends - count), count) + np.arange(count.sum())]
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        if len(short):
            whole = G.Spans(w.hashes[0], 0).hash(w.first[short], w.first[short + 1])
            gram = np.insert(gram, (ends - count)[short], G.mix(whole + G.U(77)))
            count[short] = 1
            ends = np.cumsum(count)
        for a, b in zip((ends - count).tolist(), ends.tolist(), strict=True):
            gram[a:b].sort()
        doc = np.repeat(np.arange(block.n), count)
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
        self.gram, self.doc = gram[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(block.n + 1))
        self.size = np.diff(self.first)
        self.node = block.rows
        self.ids = block.ids.cast(pa.int64())

    @cached_property
    def digest(self) -> list[np.ndarray]:
        """Equal sets have equal digests (2 x 64 bits and the size)."""
        return [self._sum(G.mix(self.gram + G.U(c))) + self.size.astype(G.U) for c in (1234567, 7654321)]

    def _sum(self, x: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, G.U), np.cumsum(x, dtype=G.U)))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def leads(self) -> np.ndarray:
        """Per document: has it a set, and the smallest node of its class of equal sets in the block?"""
        some = np.flatnonzero(self.size > 0)
        order = some[np.lexsort((self.node[some], self.digest[1][some], self.digest[0][some]))]
        new = np.ones(len(order), bool)
        a, b = (d[order] for d in self.digest)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        out = np.zeros(len(self.size), bool)
        out[order[new]] = True
        return out


class Heavy:
    """Membership in an ascending list of 32-bit numbers; a bitmap of their upper 24 bits turns most others away."""

    def __init__(self, halves: np.ndarray):
        self.halves = halves

    @cached_property
    def seen(self) -> np.ndarray:  # made where it is used, not sent
        seen = np.zeros(1 << 24, bool)
        seen[self.halves >> 8] = True
        return seen

    def holds(self, halves: np.ndarray) -> np.ndarray:
        out = self.seen[halves >> 8]
        maybe = np.flatnonzero(out)
        at = np.searchsorted(self.halves, halves[maybe])
        out[maybe] = self.halves[np.minimum(at, len(self.halves) - 1)] == halves[maybe] if len(maybe) else False
        return out


def _needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with any linking set."""
    return -(-n * percent // 100)


def passes(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Sizes n, m; ranks i, j of the first shared n-gram: can the overlap still suffice?"""
    overlap = -(-(n + m) * percent // (100 + percent))
    return np.minimum(n - i, m - j) >= overlap


def _prefixes(s: Sets, heavy: Heavy, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, doc, rank) of the prefixes, in the global order, of the documents that lead their class."""
    late = heavy.holds((s.gram >> G.U(32)).astype(np.uint32))
    early = np.concatenate(([0], np.cumsum(~late)))
    begin, n_early = early[s.first[:-1]], early[s.first[1:]] - early[s.first[:-1]]
    before = early[:-1] - begin[s.doc]  # early ones before this one in its document
    rank = np.where(late, n_early[s.doc] + np.arange(len(s.gram)) - s.first[s.doc] - before, before)
    keep = (rank < (s.size - _needed(s.size, percent) + 1)[s.doc]) & s.leads()[s.doc]
    return s.gram[keep], s.doc[keep], rank[keep]


def _pairs_of_list(node: np.ndarray, size: np.ndarray, rank: np.ndarray, percent: int):
    """All passing pairs of one short posting list."""
    order = np.lexsort((node, size))
    node, size, rank = node[order], size[order], rank[order]
    for a in range(len(node) - 1):
        b = slice(a + 1, int(np.searchsorted(size, size[a] * 100 // percent, "right")))
        other = node[b][passes(size[a], size[b], rank[a], rank[b], percent)]
        if len(other):
            yield np.minimum(node[a], other), np.maximum(node[a], other)


def _centre(node: np.ndarray, size: np.ndarray, rank: np.ndarray, percent: int):
    c = np.lexsort((node, rank))[0]
    ok = passes(size[c], size, rank[c], rank, percent) & (node != node[c])
    return np.minimum(node[c], node[ok]), np.maximum(node[c], node[ok])


PAIRS, LIST = 0, 1


def _lists(percent: int):
    def reply(block_of: list[int], payloads: list[tuple]):
        gram = np.concatenate([p[0] for p in payloads])
        node, size, d0 = (np.concatenate([p[i][p[4]] for p in payloads]) for i in (1, 2, 3))
        rank = np.concatenate([p[5] for p in payloads]).astype(np.int64)
        order, begin = G.groups(gram, d0, node)
        g, d = gram[order], d0[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        rows = order[new]  # one entry per (gram, class): its smallest node
        begin = np.flatnonzero(np.concatenate(([True], gram[rows][1:] != gram[rows][:-1])))
        end = np.append(begin[1:], len(rows))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        two = np.flatnonzero(end - begin == 2)
        if len(two):
            a, b = rows[begin[two]], rows[begin[two] + 1]
            ok = passes(size[a], size[b], rank[a], rank[b], percent)
            found.append((np.minimum(node[a], node[b])[ok], np.maximum(node[a], node[b])[ok]))
        for i in np.flatnonzero(end - begin > 2):
            mine = rows[begin[i] : end[i]]
            if len(mine) <= SHORT_LIST:
                found += _pairs_of_list(node[mine], size[mine], rank[mine], percent)
            else:
                found.append(_centre(node[mine], size[mine], rank[mine], percent))
                yield LIST, B.pack(node[mine], size[mine], rank[mine])
        if found:
            x, y = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            yield PAIRS, B.pack(*np.unique(np.stack((x, y)), axis=1))

    return reply


def _pair_rows(payloads: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload in batch.column(0):
                x, y = unpack_pairs(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    return payloads.select("payload").mapInArrow(run, "x long, y long")


def unpack_pairs(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    x, y = B.unpack(payload)
    return x, y


class Part:
    """The inverted index of one fragment of the global order over the sets of a cell."""

    def __init__(self, gram: np.ndarray, first: np.ndarray, low: int, high: int):
        inside = gram >= G.U(low)
        if high < 2**64:
            inside &= gram < G.U(high)
        at = np.flatnonzero(inside)
        self.first = np.searchsorted(at, first)
        own = gram[at]
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        new = np.ones(len(own), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.number = np.empty(len(own), np.int32)
        self.number[order] = np.cumsum(new) - 1
        self.holders = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(self.first))[order]
        self.at = np.append(np.flatnonzero(new), len(own))

    def overlaps(self, x: int, others: np.ndarray) -> np.ndarray:
        """How many n-grams of this fragment x shares with each of the others."""
        g = self.number[self.first[x] : self.first[x + 1]]
        if not len(g):
            return np.zeros(len(others), np.int64)
        n = self.at[g + 1] - self.at[g]
        ends = np.cumsum(n)
        places = np.repeat(self.at[g] - (ends - n), n) + np.arange(ends[-1])
        return np.bincount(self.holders[places], minlength=len(self.first) - 1)[others]


class Cell:
    """Sets of one cell, or of one fragment of it: the n-grams of each set that the payloads hold, and its full size."""

    def __init__(self, payloads: pa.ChunkedArray):
        nodes, sizes, counts, grams = [], [], [], []
        for payload in payloads:
            node, size, count, gram = B.unpack(payload.as_py())
            nodes.append(node)
            sizes.append(size)
            counts.append(count)
            grams.append(gram)
        self.node, self.size = np.concatenate(nodes), np.concatenate(sizes).astype(np.int64)
        self.order = np.argsort(self.node)
        self.first = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
        self.gram = np.concatenate(grams)
        self.kept: list[Part] = []

    def index(self, nodes: np.ndarray) -> np.ndarray:
        return self.order[np.searchsorted(self.node, nodes, sorter=self.order)]

    def need(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        return -(-(self.size[x] + self.size[y]) * percent // (100 + percent))

    def partial(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Overlaps of the pairs (x ascending) in the n-grams held here."""
        part, total = Part(self.gram, self.first, 0, 2**64), np.zeros(len(x), np.int64)
        cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))).tolist() + [len(x)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            total[a:b] = part.overlaps(int(x[a]), y[a:b])
        return total

    def links(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Those of `others` that link with x, for callers that choose pairs as they go: the indexes of all fragments are kept."""
        if not self.kept:
            n = max(FRAGMENTS, -(-len(self.gram) // GRAMS_PER_FRAGMENT))
            self.kept = [Part(self.gram, self.first, f * 2**64 // n, (f + 1) * 2**64 // n) for f in range(n)]
            self.gram = self.gram[:0]
        need, total, left = self.need(np.int64(x), others, percent), np.zeros(len(others), np.int64), self.size[x]
        for part in self.kept:
            total += part.overlaps(x, others)
            left = left - (part.first[x + 1] - part.first[x])
            alive = total + left >= need
            if not alive.all():
                others, total, need = others[alive], total[alive], need[alive]
                if not len(others):
                    break
        return others


class Forest:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, a: int) -> int:
        while self.root[a] != a:
            self.root[a] = self.root[self.root[a]]
            a = self.root[a]
        return a


def _sent(blocks: DataFrame, nodes: DataFrame, wanted: DataFrame, k: int, fragments: int = 1) -> DataFrame:
    """wanted (_n, cell), distinct -> the sets of these nodes, one payload per block, cell and fragment of the global order
    (bucket: cell * fragments + fragment; fragments are equal ranges of hashes)."""
    requests = wanted.join(nodes, F.col("_n") == F.col("node")).select("block", F.col("cell").alias("bucket"), F.col("node").cast("string").cast("binary").alias("payload"))

    def segments(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return B._SCHEMA.empty_table()
        block = left.column("block")[0].as_py()
        s = Sets(B.Block(left.column("blob")[0].as_py()), k)
        where = {int(n): i for i, n in enumerate(s.node.tolist())}
        by_cell: dict[int, list[int]] = {}
        for cell, node in zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist(), strict=True):
            by_cell.setdefault(cell, []).append(where[int(node)])
        cuts = [G.U(f * 2**64 // fragments) for f in range(fragments)]
        rows = []
        for cell, docs in by_cell.items():
            parts = [s.gram[s.first[i] : s.first[i + 1]] for i in docs]
            edges = [[*np.searchsorted(x, cuts).tolist(), len(x)] for x in parts]
            for f in range(fragments):
                mine = [x[e[f] : e[f + 1]] for x, e in zip(parts, edges, strict=True)]
                rows.append((cell * fragments + f, block, B.pack(s.node[docs], s.size[docs], np.array([len(x) for x in mine]), np.concatenate(mine))))
        return pa.Table.from_batches([B._batch(rows)] if rows else [], schema=B._SCHEMA)

    return B._joined(blocks, requests, segments, B.MESSAGE)


_LINKS = pa.schema([("x", pa.int64()), ("y", pa.int64())])
_PARTIAL = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("shared", pa.int64()), ("need", pa.int64())])


def _verify(pairs: DataFrame, nodes: DataFrame, blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (x, y) -> those that link. Each fragment of a cell is a task's work of its own; it gives partial overlaps per pair, and a shuffle sums them."""
    pairs = materialize(pairs, "pairs")
    both = pairs.select(F.col("x").alias("_n"), F.col("y").alias("_o")).union(pairs.select(F.col("y").alias("_n"), F.col("x").alias("_o")))
    least = both.groupBy("_n").agg(F.min("_o").alias("_m")).join(nodes, F.col("_n") == F.col("node"))
    least = materialize(least.select("_n", F.least("_n", "_m").alias("label"), "size"), "least")
    n_pairs, n_grams = pairs.count(), least.agg(F.sum("size")).first()[0] or 0
    cells = max(1, -(-n_pairs // PAIRS_PER_CELL), -(-n_grams // GRAMS_PER_CELL))
    # pairs around one smallest neighbour go to one cell, so that a set is sent to few cells; larger groups are dealt
    # by x, and an x with very many partners is salted over several cells
    left, right = (least.select(F.col("_n").alias(f"_{c}"), F.col("label").alias(f"l{c}"), F.col("size").alias(f"s{c}")) for c in "xy")
    named = pairs.join(left, F.col("x") == F.col("_x")).join(right, F.col("y") == F.col("_y")).select("x", "y", F.least("lx", "ly").alias("label"), "sy")
    named = materialize(named, "named")
    load = F.greatest(F.count("*") / (PAIRS_PER_CELL // 4), F.sum("sy") / (GRAMS_PER_CELL // 4))
    large = named.groupBy(F.col("label").alias("_l")).agg(load.alias("_load")).filter("_load > 1").select("_l")
    degree = named.groupBy(F.col("x").alias("_x")).agg(F.ceil(load).cast("int").alias("_salt")).filter("_salt > 1")
    dealt = named.join(large, F.col("label") == F.col("_l"), "left").join(degree, F.col("x") == F.col("_x"), "left")
    key = F.when(F.col("_l").isNull(), F.xxhash64("label")).otherwise(F.xxhash64("x", F.pmod(F.xxhash64("y"), F.coalesce("_salt", F.lit(1)))))
    celled = dealt.select("x", "y", F.pmod(key, F.lit(cells)).cast("int").alias("cell"))
    wanted = celled.select(F.col("x").alias("_n"), "cell").union(celled.select(F.col("y").alias("_n"), "cell")).distinct()

    def count_fragment(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _PARTIAL.empty_table()
        cell = Cell(right.column("payload"))
        x, y = (cell.index(left.column(c).to_numpy()) for c in ("x", "y"))
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        shared = cell.partial(x, y)
        some = np.flatnonzero(shared)
        x, y = x[some], y[some]
        return pa.table([pa.array(c, pa.int64()) for c in (cell.node[x], cell.node[y], shared[some], cell.need(x, y, percent))], schema=_PARTIAL)

    sent = _sent(blocks, nodes, wanted, k, FRAGMENTS)
    fragment = F.explode(F.sequence(F.lit(0), F.lit(FRAGMENTS - 1)))
    dealt = celled.withColumn("_f", fragment).select("x", "y", (F.col("cell") * FRAGMENTS + F.col("_f")).alias("bucket"))
    partial = dealt.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(count_fragment, "x long, y long, shared long, need long")
    return partial.groupBy("x", "y").agg(F.sum("shared").alias("_s"), F.first("need").alias("_need")).filter("_s >= _need").select("x", "y")


def _told(rows: DataFrame, lists: DataFrame, key: str) -> DataFrame:
    """rows (list, _n, ...) joined with one row per list (`key`): a list's row stands SALTS times, so that the members of a long list spread over as many keys."""
    salted = lists.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(SALTS))).join(salted, (F.col("list") == F.col(key)) & (F.col("_salt") == F.col("_s"))).drop("_salt", "_s")


def _left_apart(lists: DataFrame, found: DataFrame, nodes: DataFrame, blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between different components inside long lists.

    A cell compares only what is not yet connected there, and returns a spanning forest. Lists of one group of near copies share
    most members, so they share cells, of about `ROWS` memberships each. A list beyond `SLICE` sets is dealt to tiles: its largest component
    (whose members need not be compared with each other) in slices against slices of all others, and those against each other.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                node, size, rank = B.unpack(payload.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), number), pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(rank, pa.int64())], ["list", "_n", "size", "rank"])

    rows = lists.select("list", "payload").mapInArrow(members, "list long, _n long, size long, rank long")
    labelled = materialize(rows.join(found, F.col("_n") == F.col("node"), "left").select("list", "_n", "size", "rank", F.coalesce("component", "_n").alias("label")), "labelled")
    parts = labelled.groupBy("list", "label").agg(F.count("*").alias("_c"))
    apart = parts.groupBy(F.col("list").alias("_l")).agg(F.sum("_c").alias("_all"), F.max(F.struct("_c", "label")).alias("_top")).filter("_top._c < _all")
    rows = _told(labelled, apart, "_l")
    rows = rows.select("list", "_n", "size", "rank", "label", "_all", F.col("_top._c").alias("_most"), (F.col("label") == F.col("_top.label")).alias("_major"))
    rows = materialize(rows, "apart")
    columns = ("list", "_n", "size", "rank", "label")
    # lists of a group share nearly all members: two steps of minimum labels give most of them one name
    few = rows.filter(F.col("_all") <= SLICE)
    least = few.groupBy(F.col("_n").alias("_m")).agg(F.min("list").alias("_least"))
    group = few.join(least, F.col("_n") == F.col("_m")).groupBy(F.col("list").alias("_l")).agg(F.min("_least").alias("group"), F.first("_all").alias("_rows"))
    cells = group.groupBy(F.col("group").alias("_g")).agg(F.ceil(F.sum("_rows") / ROWS).alias("_cells"))
    place = group.join(cells, F.col("group") == F.col("_g")).select("_l", F.xxhash64("group", F.pmod(F.xxhash64("_l"), F.col("_cells"))).alias("_cell"))
    small = _told(few, place, "_l").select("_cell", *columns)
    # tiles: (0, p, j) others p against the largest component's slice j; (1, p, q) others among themselves
    many = rows.filter(F.col("_all") > SLICE).withColumn("_p", F.ceil((F.col("_all") - F.col("_most")) / SLICE).cast("int")).withColumn("_q", F.ceil(F.col("_most") / SLICE).cast("int"))
    own = F.pmod(F.xxhash64("_n"), F.when(F.col("_major"), F.col("_q")).otherwise(F.col("_p"))).cast("int")
    all_p, all_q = (F.sequence(F.lit(0), F.col(c) - 1) for c in ("_p", "_q"))

    def tile(kind: int, p, q):
        return F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"))

    def tiles(i):
        across = F.transform(all_q, lambda j: tile(0, i, j))
        among = F.transform(all_p, lambda j: tile(1, F.least(i, j), F.greatest(i, j)))
        return F.when(F.col("_major"), F.transform(all_p, lambda j: tile(0, j, i))).otherwise(F.concat(across, among))

    large = many.withColumn("_t", F.explode(F.element_at(F.transform(F.array(own), tiles), 1)))
    large = large.select(F.xxhash64("list", "_t.kind", "_t.p", "_t.q").alias("_cell"), *columns)
    dealt = small.unionByName(large).select(F.col("_cell").bitwiseAND(F.lit(2**31 - 1)).cast("int").alias("cell"), *columns)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _LINKS.empty_table()
        cell = Cell(right.column("payload"))
        at, lists_, size, rank, label = (left.column(c).to_numpy() for c in ("_n", "list", "size", "rank", "label"))
        at = cell.index(at)
        forest = Forest(len(cell.node))
        seen: dict[int, int] = {}
        for i, c in zip(at.tolist(), label.tolist(), strict=True):  # what is connected already
            forest.root[forest.find(i)] = forest.find(seen.setdefault(c, i))
        order = np.lexsort((rank, size, lists_))
        at, lists_, size, rank = at[order], lists_[order], size[order], rank[order]
        cuts = np.flatnonzero(np.concatenate(([True], lists_[1:] != lists_[:-1]))).tolist() + [len(lists_)]
        out: list[tuple[int, int]] = []
        tried: dict[int, set[int]] = {}
        for a, b in zip(cuts, cuts[1:], strict=False):
            roots = np.array([forest.find(i) for i in at[a:b].tolist()])
            for i in range(a, b - 1):
                last = int(np.searchsorted(size[a:b], size[i] * 100 // percent, "right")) + a
                span = slice(i + 1, last)
                ok = passes(size[i], size[span], rank[i], rank[span], percent) & (roots[i + 1 - a : last - a] != roots[i - a])
                if not ok.any():
                    continue
                x = int(at[i])
                done = tried.setdefault(x, set())
                others = [j for j in at[span][ok].tolist() if j not in done and forest.find(j) != forest.find(x)]
                if not others:
                    continue
                done.update(others)
                for j in cell.links(x, np.array(others), percent).tolist():
                    p, q = forest.find(x), forest.find(j)
                    if p != q:
                        forest.root[q] = p
                        out.append((cell.node[x], cell.node[j]))
        return pa.table([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], schema=_LINKS)

    sent = _sent(blocks, nodes, dealt.select("_n", "cell").distinct(), k)
    return dealt.groupBy("cell").cogroup(sent.withColumn("cell", F.col("bucket")).groupBy("cell")).applyInArrow(compare, "x long, y long")


def _frequent(blocks: DataFrame, k: int, way: B.Post) -> np.ndarray:
    """Upper halves of the hashes of n-grams that more than SHORT_LIST documents hold.

    Only the share COUNTED of all hashes is counted, from below: prefixes take the smallest hashes, so they seldom reach beyond it. At
    most FREQUENT of them (or one per bucket), the most frequent of each bucket, come to the driver (four bytes each).
    """
    below = G.U(int(COUNTED * 2**64))

    def halves(block: B.Block):
        s = Sets(block, k)
        half, df = np.unique((s.gram[s.leads()[s.doc] & (s.gram < below)] >> G.U(32)).astype(np.uint32), return_counts=True)
        edge = B.bounds(half.astype(G.U) << G.U(33), way.n_buckets)  # halves below 0.45 spread over nearly all buckets
        for bucket in edge.used():
            mine = slice(edge[bucket], edge[bucket + 1])
            more = np.flatnonzero(df[mine] > 1)
            yield bucket, B.pack(half[mine], more.astype(np.uint32), df[mine][more].astype(np.uint32))

    def total(block_of: list[int], payloads: list[tuple]):
        half = np.concatenate([p[0] for p in payloads])
        df = np.concatenate([_filled(len(p[0]), p[1], p[2]) for p in payloads])
        order, begin = G.groups(half)
        sums = np.add.reduceat(df[order], begin)
        often = np.flatnonzero(sums > SHORT_LIST)
        often = often[np.argsort(-sums[often], kind="stable")][: max(1, FREQUENT // way.n_buckets)]
        yield 0, B.pack(half[order][begin][often])

    found = B.answer(B.ask(blocks, halves, way), total, way, back=False).select("payload").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint32), *(B.unpack(r.payload)[0] for r in found)]))


def _filled(n: int, where: np.ndarray, value: np.ndarray) -> np.ndarray:
    out = np.ones(n, np.int64)
    out[where] = value
    return out


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", fan_bits: int | None = None) -> DataFrame:
    """Per document: doc_id, n_shingles (distinct word k-grams), component_id (the smallest doc_id reachable by links, itself included).

    A text of fewer than k words is its whole word sequence as one n-gram; one without words (or null) has an empty set and
    links with nothing. Every row is a document of its own, whatever its id: rows that repeat an id are compared each by its own text, rows without an id
    link as others do and never name a component (null where no member has an id). One row per input row; other columns are ignored; an empty
    table gives no rows.
    """
    blocks = B.build(docs, id_col, text_col)
    way = B.post(blocks, PREFIX_TEXT, fan_bits)
    n_buckets = way.n_buckets

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                block = B.Block(blob.as_py())
                s = Sets(block, k)
                arrays = [pa.array(np.full(block.n, number), pa.int64()), s.ids, pa.array(s.node, pa.int64()), pa.array(s.size, pa.int64()), pa.array(s.digest[0].view(np.int64), pa.int64()), pa.array(s.digest[1].view(np.int64), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["block", "doc_id", "node", "size", "d0", "d1"])

    described = blocks.select("block", "blob").mapInArrow(describe, "block long, doc_id long, node long, size long, d0 long, d1 long")
    described = materialize(described, "described")

    heavy = Heavy(_frequent(blocks, k, way))

    def prefixes(block: B.Block):
        s = Sets(block, k)
        gram, doc, rank = _prefixes(s, heavy, percent)
        gram = G.spread(gram)
        order = np.argsort(gram, kind="stable")
        gram, doc, rank = gram[order], doc[order], rank[order]
        edge = B.bounds(gram, n_buckets)
        for bucket in edge.used():
            mine = slice(edge[bucket], edge[bucket + 1])
            docs_here, place = np.unique(doc[mine], return_inverse=True)
            narrow = rank[mine].astype(np.uint16 if rank[mine].max() < 65536 else np.uint32)
            yield bucket, B.pack(gram[mine], s.node[docs_here], s.size[docs_here], s.digest[0][docs_here], place.astype(np.uint16 if len(docs_here) < 65536 else np.uint32), narrow)

    answers = materialize(B.answer(B.ask(blocks, prefixes, way), _lists(percent), way, back=False), "lists")
    pairs = _pair_rows(answers.filter(F.col("block") == PAIRS)).distinct()
    nodes = described.filter("size > 0").select("node", "block", "size")
    links = materialize(_verify(pairs, nodes, blocks, k, percent), "links")
    lists = answers.filter(F.col("block") == LIST).withColumn("list", F.xxhash64("payload"))
    if lists.limit(1).count():
        rest = _left_apart(lists, components(links.toDF("a", "b")), nodes, blocks, k, percent)
        links = links.unionByName(materialize(rest, "rest"))
    links = links.toDF("a", "b")
    # copies: equal sets share a class; its smallest node stood for it. A class may hold a third of all rows: its leader is one row per salt
    some = described.filter("size > 0").withColumn("salt", F.pmod("node", F.lit(SALTS)))
    leader = some.groupBy("d0", "d1", "size").agg(F.min("node").alias("_lead"), F.count("*").alias("_rows")).filter("_rows > 1")
    leader = leader.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    same = [F.col(f"s.{c}") == F.col(f"l.{c}") for c in ("d0", "d1", "size", "salt")]
    spread = some.alias("s").join(leader.alias("l"), same[0] & same[1] & same[2] & same[3])
    links = links.unionByName(spread.filter("node <> _lead").select(F.col("_lead").alias("a"), F.col("node").alias("b")))
    found = materialize(components(links), "components")
    names = found.join(described.select(F.col("node").alias("_n"), "doc_id"), F.col("node") == F.col("_n")).groupBy(F.col("component").alias("_c")).agg(F.min("doc_id").alias("_name"))
    named = found.join(names, F.col("component") == F.col("_c")).select(F.col("node").alias("_n"), "component", "_name")
    joined = described.join(named, F.col("node") == F.col("_n"), "left")
    return joined.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("_name")).alias("component_id"))
