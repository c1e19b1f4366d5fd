"""Joins and windows over time: as-of, interval, nearest, ticks, islands, runs.

All of them are equi-joins or one window over (key, time), so that Spark shuffles once by key and sorts; none
compares all pairs of a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], until: str | None = None) -> DataFrame:
    """left with the `values` of the last right row at or before its time (right rows win at equal times).

    Union and one running window instead of a theta join. `until`: a right column after which its row no longer holds (exclusive).
    Several right rows at one time: the one with the largest values.
    """
    picks = [*values, *([until] if until else [])]
    a = left.select("*", F.lit(1).alias("_side"), F.lit(None).alias("_v"))
    b = right.select(*[F.col(c) for c in [*keys, on]], F.lit(0).alias("_side"), F.struct(*picks).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(on, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_last", F.last("_v", ignorenulls=True).over(order)).filter("_side = 1")
    holds = F.col("_last").isNotNull() if until is None else F.coalesce(F.col(on) < F.col(f"_last.{until}"), F.col("_last").isNotNull() & F.col(f"_last.{until}").isNull())
    return filled.select(*left.columns, *[F.when(holds, F.col(f"_last.{v}")).alias(v if v not in left.columns else f"right_{v}") for v in values])


def interval_join(points: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, begin: str, end: str, width: int) -> DataFrame:
    """Points inside [begin, end) of spans with equal keys: an equi-join on keys and a time bucket of `width`, then a filter.

    A span is copied to each bucket it touches, so `width` should be near the usual span length.
    """
    p = points.withColumn("_bucket", F.floor(F.col(at) / width))
    s = spans.filter(F.col(end) > F.col(begin)).withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))
    return p.join(s, [*keys, "_bucket"]).filter((F.col(at) >= F.col(begin)) & (F.col(at) < F.col(end))).drop("_bucket")


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, other: str, within: int, value: str) -> DataFrame:
    """left with the value and distance of the nearest right row within +-within (ties: the earlier, then the smaller value); nulls without one."""
    numbered = left.withColumn("_row", F.monotonically_increasing_id())
    spread = numbered.withColumn("_bucket", F.explode(F.array(*[F.floor(F.col(at) / within) + d for d in (-1, 0, 1)])))
    r = right.select(*keys, F.col(other).alias("_o"), F.col(value).alias("_v"), F.floor(F.col(other) / within).alias("_bucket"))
    hits = spread.join(r, [*keys, "_bucket"]).filter(F.abs(F.col(at) - F.col("_o")) <= within)
    best = hits.groupBy("_row").agg(F.min(F.struct(F.abs(F.col(at) - F.col("_o")).alias("d"), F.col("_o").alias("o"), F.col("_v").alias("v"))).alias("_b"))
    return numbered.join(best, "_row", "left").select(*left.columns, F.col("_b.v").alias("nearest"), F.col("_b.d").alias("distance"))


def ticks(spans: DataFrame, begin: str, end: str, step: int, name: str = "tick") -> DataFrame:
    """A row per multiple of step in [begin, end]; none if the span holds none (a descending sequence would make some up)."""
    first, last = F.ceil(F.col(begin) / step) * step, F.floor(F.col(end) / step) * step
    return spans.withColumn(name, F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))))


def islands(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows per key; a run starts where `breaks` is true (or null, as at the first row). `breaks` may use F.lag(...).over(window_of)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = rows.withColumn("_break", F.coalesce(breaks, F.lit(True)).cast("int"))
    return flagged.withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def window_of(keys: Sequence[str], order: Sequence[str | Column]):
    return Window.partitionBy(*keys).orderBy(*order)


def forward_fill(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    w = window_of(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(column, F.last(column, ignorenulls=True).over(w))


def next_boundary(rows: DataFrame, keys: Sequence[str], order: Sequence[str], is_start: Column, at: str, name: str = "next_start") -> DataFrame:
    w = window_of(keys, order).rowsBetween(1, Window.unboundedFollowing)
    return rows.withColumn(name, F.min(F.when(is_start, F.col(at))).over(w))


def monotone(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, strict: bool = True) -> DataFrame:
    """Rows whose value exceeds (or reaches) all before: exactly those a sequential keep-if-larger pass accepts."""
    before = F.max(column).over(window_of(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    keep = F.col(column) > before if strict else F.col(column) >= before
    return rows.withColumn("_keep", before.isNull() | keep).filter("_keep").drop("_keep")


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, floor: float, least: int, peak: float) -> DataFrame:
    """Runs of at least `least` consecutive rows with value >= floor whose largest value reaches peak."""
    w = window_of(keys, order)
    on = F.col(value) >= floor
    numbered = islands(rows.withColumn("_on", on), keys, order, F.lag("_on").over(w).isNull() | (F.col("_on") != F.lag("_on").over(w)))
    return numbered.filter("_on").groupBy(*keys, "island").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"), F.max(value).alias("peak")).filter((F.col("n") >= least) & (F.col("peak") >= peak)).drop("island")


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(window_of(keys, order))).filter(F.col(name) <= k)


def round_robin(rows: DataFrame, tier: str, group: str, order: Sequence[str]) -> DataFrame:
    """Interleave groups within a tier: the first of each group, then the second of each..."""
    return rows.withColumn("turn", F.row_number().over(window_of([tier, group], order)))


def cap(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], size: str, most: float) -> DataFrame:
    """Rows whose running size within the key stays at or below most."""
    w = window_of(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_run", F.sum(size).over(w)).filter(F.col("_run") <= most).drop("_run")


def mode_first(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """The most frequent value per key, at ties the one seen first."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return counted.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct(F.col("n"), -F.col("_first"))).alias("_m")).select(*keys, f"_m.{value}", "_m.n")
