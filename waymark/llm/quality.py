"""Operator 10, quality rules with adaptive thresholds.

`measure` counts words, symbols, repeated lines and repeated word windows of each text. A fixed base rule
rejects texts that are too short or repeat themselves. For the rest, limits are not fixed: per
language and source they come from quantile sketches of the corpus itself, so a source that writes in longer
words or more symbols is judged by its own habits.

The sketch is a log-linear histogram (16 buckets per power of two, exact below 32): a quantile's error is at
most one sixteenth of its value, and two sketches merge by adding counts, in any order and with
the same result. As rows (language, source, metric, bucket, n) they are built with map-side combining and
merged upwards where a group is small: (language, source), then language, then everything.

A text fails when a metric lies further from its group's median than `reach` times the spread on that side, the
distance from the median to a far quantile. Many metrics are 0 for most texts of a group, so their spread may be 0; it counts
as one unit at least, and the unit is the group's own too: one symbol (or repeated line) in a text of its median length, or,
for word length, the sketch's resolution at its median. No limit is a constant.
Documents that failed the base rule do not shape the sketches. Repeated word windows have no limit here: the base rule has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm import grams as G
from waymark.llm.blocks import Block
from waymark.llm.scratch import materialize

SYMBOLS = b"#*$%&|<>"
MIN_GROUP = 200
#: metric: (as an integer expression, far quantiles below and above in per cent, reach, unit as an expression of medians). Null quantile: no limit on that side.
METRICS = {
    "word_length": ("100 * word_chars div n_words", 10, 90, 6, "word_length_50 div 16"),
    "symbols": ("10000 * n_symbols div n_words", None, 75, 4, "10000 div greatest(words_50, 1)"),
    "dup_lines": ("10000 * n_dup_lines div greatest(n_lines, 1)", None, 75, 4, "10000 div greatest(lines_50, 1)"),
}
#: sketched for their medians only
SIZES = {"words": "n_words", "lines": "n_lines"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
WINDOW = 8


def _per_doc(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(mask)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def count(block: Block) -> dict[str, np.ndarray]:
    w = G.Words(block)
    data = block.bytes
    out = {"n_words": np.diff(w.first), "word_chars": _per_doc(~G.SPACE[data] & ((data & 0xC0) != 0x80), block.offsets), "n_symbols": _per_doc(_SYMBOL[data], block.offsets)}
    dup, lines = np.zeros(block.n, np.int64), np.zeros(block.n, np.int64)
    for i in range(block.n):
        spoken = [x for x in block.text(i).split(b"\n") if x and not x.isspace()]
        lines[i], dup[i] = len(spoken), len(spoken) - len(set(spoken))
    out |= {"n_dup_lines": dup, "n_lines": lines}
    starts = np.flatnonzero(w.left() >= WINDOW) if w.n else np.zeros(0, np.int64)
    if len(starts):
        one, two = (G.grams(h, WINDOW, 7)[starts] for h in w.hashes)
        key = one + w.doc[starts].astype(G.U) * G.U(0x9E3779B97F4A7C15)
        order = np.argsort(G.mix(key), kind="stable")
        k, t, d = key[order], two[order], w.doc[starts][order]
        same = (k[1:] == k[:-1]) & (t[1:] == t[:-1]) & (d[1:] == d[:-1])
        twice = np.zeros(len(starts), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        begin = starts[twice]
        out["n_repeat_words"] = _per_doc(G.union(w.n, begin, begin + WINDOW), w.first)
    else:
        out["n_repeat_words"] = np.zeros(block.n, np.int64)
    return out


def measure(docs: DataFrame, text_col: str = "text", columns: tuple[str, ...] | None = None, keep_text: bool = False) -> DataFrame:
    """`columns` of docs (and the text, as `_text`, if wanted) with the counts; a null text has none of anything."""
    columns = tuple(columns or [c for c in docs.columns if c != text_col and c not in COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 1000
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                text = piece.column(piece.num_columns - 1)
                found = count(Block.of(pa.nulls(len(text), pa.int64()), text))
                arrays = [*piece.columns[: len(schema) - len(COUNTS)], *(pa.array(found[c], pa.int64()) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    rows = docs.select(*columns, F.col(text_col).cast("string").alias("_text"))
    schema = T.StructType([*rows.schema.fields[: None if keep_text else -1], *(T.StructField(c, T.LongType()) for c in COUNTS)])
    return rows.mapInArrow(run, schema)


def bucket(v: Column) -> Column:
    shift = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (shift * 16 + F.call_function("shiftright", v, shift)).cast("long")


def top_of(b: Column) -> Column:
    """The largest value of a bucket."""
    shift = F.floor(b / 16).cast("int") - 1
    return F.when(b < 32, b).otherwise(F.call_function("shiftleft", b - 16 * shift + 1, shift) - 1).cast("long")


def sketched() -> dict[str, str]:
    return {m: e[0] for m, e in METRICS.items()} | SIZES


def wanted_quantiles() -> list[tuple[str, int]]:
    far = [(m, q) for m, (_, low, high, _, _) in METRICS.items() for q in sorted({50} | {x for x in (low, high) if x is not None})]
    return far + [(m, 50) for m in SIZES]


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents that pass the base rule."""
    values = F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.expr(f"cast({e} as long)")).alias("bucket")) for m, e in sketched().items()])
    rows = measured.filter(~F.col("base_failed")).select("lang", "source", F.inline(values))
    return rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total and, per metric, the quantiles its limits need."""
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "metric")
    merged = merged.withColumn("_upto", F.sum("n").over(run.orderBy("bucket"))).withColumn("_all", F.sum("n").over(run))

    def at(metric: str, q: int) -> Column:
        # the smallest value that q per cent do not exceed, rounded up to its bucket's top
        reached = (F.col("metric") == metric) & (F.col("_upto") * 100 >= F.col("_all") * q)
        return top_of(F.min(F.when(reached, F.col("bucket")))).alias(f"{metric}_{q}")

    return merged.groupBy(*keys).agg(F.max("_all").alias("total"), *(at(m, q) for m, q in wanted_quantiles()))


def limits(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Per (lang, source): the quantiles of the finest level that has `min_group` documents (the coarsest always serves)."""
    pair, lang, everything = quantiles(sketch, ["lang", "source"]), quantiles(sketch, ["lang"]), quantiles(sketch, [])
    names = [c for c in pair.columns if c not in ("lang", "source", "total")]
    joined = pair.alias("p").join(lang.alias("l"), F.col("p.lang").eqNullSafe(F.col("l.lang"))).crossJoin(everything.alias("a"))  # one row
    pick = [F.when(F.col("p.total") >= min_group, F.col(f"p.{c}")).when(F.col("l.total") >= min_group, F.col(f"l.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in names]
    return joined.select("p.lang", "p.source", *pick)


def failures() -> dict[str, Column]:
    """Per metric: does the value lie beyond a limit of its group?"""
    out = {}
    for m, (expression, low, high, reach, unit) in METRICS.items():
        value, middle, bad = F.expr(expression), F.col(f"{m}_50"), F.lit(False)
        if high is not None:
            bad = bad | (value > middle + reach * F.greatest(F.col(f"{m}_{high}") - middle, F.expr(unit)))
        if low is not None:
            bad = bad | (value < middle - reach * F.greatest(middle - F.col(f"{m}_{low}"), F.expr(unit)))
        out[m] = bad
    return out


def verdict() -> Column:
    bad = F.lit(False)
    for one in failures().values():
        bad = bad | one
    return ~bad


def judge(docs: DataFrame, min_group: int = MIN_GROUP, min_words: int = 20, max_repeat_pct: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", columns: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """`columns` (and the text, as `_text`, if wanted) with the counts, base_failed and kept.

    One row per input row, equal ids and repeated rows included; a null text fails the base rule; null languages
    and sources are groups of their own; other columns are ignored; an empty table gives no rows.
    """
    extra = [c for c in columns if c not in (lang_col, source_col)]
    rows = measure(docs.select(*extra, F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")), "text", (*extra, "lang", "source"), keep_text)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    rows = materialize(rows.withColumn("base_failed", failed), "measured")
    level = materialize(limits(sketches(rows), min_group), "limits")
    joined = rows.alias("d").join(level.alias("t"), F.col("d.lang").eqNullSafe(F.col("t.lang")) & F.col("d.source").eqNullSafe(F.col("t.source")), "left")
    kept = F.when(F.col("base_failed"), False).otherwise(verdict())
    return joined.select(*(F.col(f"d.{c}") for c in (*extra, *["_text"] * keep_text)), *(c for c in COUNTS if c != "n_lines"), "base_failed", kept.alias("kept"))
