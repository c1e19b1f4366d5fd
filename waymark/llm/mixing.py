"""Operator 2, mixing sources to target weights by hash-threshold histograms.

Each source gets a share of the budget by weight, at most `max_repeats` times its own size; what a
capped source cannot use is shared again by weight among the others. That is water filling: with
sources sorted by cap / weight, the capped ones are a prefix, found with running sums.

A source's target is whole passes over it plus a remainder. Which documents make up the remainder
follows from a hash of the id: those below a threshold. Thresholds come from nested
histograms: tokens summed by source and hash bucket; running sums show the bucket in which the
remainder ends; only that bucket is split further, `LEVELS` times, down to single hash values. Then
the documents are filtered by threshold; nothing is sorted. All of it is DataFrame work in the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.scratch import materialize

BITS, LEVELS = 13, 4  # 52 bits of MD5
FEW_SOURCES, SALT = 100_000, 64  # rows of one line each that may be broadcast; beyond it, salts


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash52(number: Column) -> Column:
    """The first 13 hex digits of the MD5 of the id's decimal digits (null id: of the empty string)."""
    return F.conv(F.substring(F.md5(F.coalesce(number.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> those with weight and target. Sources by code point, null last, take the weights in turn."""
    total = Window.partitionBy()
    ranked = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    rows = sizes.withColumn("_n", F.row_number().over(ranked) - 1)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("_cap", F.col("source_size") * max_repeats)
    rows = rows.withColumn("_budget", F.floor(F.sum("source_size").over(total) * F.lit(share)))
    by_level = Window.orderBy((F.col("_cap") / F.col("weight")).asc(), "_n")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    # what is left for this source and all that cap later, if all before it are at their caps
    rows = rows.withColumn("_left", F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    rows = rows.withColumn("_weights", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    wide = [F.col(c).cast("decimal(38,0)") for c in ("_cap", "_weights", "_left", "weight")]  # 10^13 words times the weights of many sources pass 2^63
    rows = rows.withColumn("_full", wide[0] * wide[1] <= wide[2] * wide[3])
    rows = rows.withColumn("_rank", F.row_number().over(by_level))
    level = rows.filter(~F.col("_full")).orderBy("_rank").limit(1).select(F.col("_left").alias("_l"), F.col("_weights").alias("_w"))
    rows = rows.join(level, how="left")
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("weight") * F.col("_l").cast("double") / F.col("_w").cast("double"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _with_source(docs: DataFrame, sources: DataFrame, few: bool, more: Sequence[Column] = ()) -> DataFrame:
    """docs (alias d) joined with one row per source (alias s): by broadcast if there are few, else each source's row SALT times, so that a hot source spreads over SALT keys."""
    same = F.col("d.source").eqNullSafe(F.col("s.source"))
    for condition in more:
        same = same & condition
    if few:
        return docs.alias("d").join(F.broadcast(sources).alias("s"), same)
    salted = docs.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "h"), F.lit(SALT)))
    copies = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    return salted.alias("d").join(copies.alias("s"), same & (F.col("d._salt") == F.col("s._salt")))


def thresholds(docs: DataFrame, wanted: DataFrame, few: bool = True) -> DataFrame:
    """docs (doc_id, source, size, h); wanted (source, remainder, less than the source's size) -> (source, bound).

    Documents with h < bound sum to about the remainder. In each level's histogram the remainder ends in the
    first bucket whose running sum exceeds it; the next level splits that bucket only. At single hash values,
    the last one is taken if that comes nearer.
    """
    state = wanted.select("source", F.col("remainder").cast("double").alias("_need"), F.lit(0).cast("long").alias("_prefix"))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = F.shiftright("d.h", shift + BITS) == F.col("s._prefix")
        sums = _with_source(docs, state, few, [inside]).groupBy("s.source", "s._need", F.shiftright("d.h", shift).alias("_prefix")).agg(F.sum("d.size").alias("_sum"))
        run = Window.partitionBy("source").orderBy("_prefix")
        sums = sums.withColumn("_upto", F.sum("_sum").over(run)).filter(F.col("_upto") > F.col("_need"))
        first = F.min_by(F.struct((F.col("_need") - (F.col("_upto") - F.col("_sum"))).alias("_need"), "_prefix", "_sum"), "_prefix")
        state = sums.groupBy("source").agg(first.alias("e")).select("source", "e.*")
    nearer = F.col("_sum") - F.col("_need") <= F.col("_need")
    return state.select("source", (F.col("_prefix") + F.when(nearer, 1).otherwise(0)).alias("bound"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), share: float = 1.0, max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, source, size (words), source_size, target (its source's) and taken, the words the mix takes, repeats counted.

    Reruns agree: nothing depends on row order or partitioning. A null source is a source of its own, last
    in order. Documents without words (null or empty text) take nothing; a source without words has target 0.
    Rows with equal ids have equal hashes, so they are taken or left together, each as a row of its own.
    Other columns are ignored; an empty table gives no rows.
    """
    number = F.col(id_col).cast("long")
    rows = materialize(docs.select(number.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), hash52(number).alias("h")), "sizes")
    plan = materialize(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats), "targets")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("full", full).withColumn("remainder", F.col("target") - F.col("full") * F.col("source_size"))
    few = plan.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    bounds = thresholds(rows.filter("size > 0"), plan.filter("source_size > 0"), few)
    plan = plan.alias("p").join(bounds.alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")), "left").select("p.*", F.coalesce("b.bound", F.lit(0)).alias("bound"))
    joined = _with_source(rows, plan, few)
    taken = F.col("size") * (F.col("full") + F.when(F.col("h") < F.col("bound"), 1).otherwise(0))
    return joined.select("doc_id", "d.source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def repeat_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each document as often as the mix takes it, rows that repeat an id and rows without one too.

    How often is the same for all rows with words of one id and source, so one count for each such pair serves them all.
    """
    times = (F.col("taken") / F.col("size")).cast("int")
    counts = mixed.filter("size > 0 and taken > 0").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), times.alias("_times")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & F.col(source_col).cast("string").eqNullSafe(F.col("_source"))
    joined = docs.filter(F.col(text_col).rlike(r"[^\x20\x09-\x0D]")).join(counts, same)
    return joined.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS n FROM d GROUP BY source),
s1 AS (SELECT *, n % 3 + 1 AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS budget FROM s0),
s2 AS (SELECT *, row_number() OVER (ORDER BY cap / weight, n) AS r,
              budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l,
              sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM s1),
lv AS (SELECT l, w FROM s2 WHERE NOT cap * w <= l * weight ORDER BY r LIMIT 1),
s3 AS (SELECT s2.*, CASE WHEN cap * s2.w <= s2.l * weight THEN cap::DOUBLE ELSE weight * lv.l::DOUBLE / lv.w::DOUBLE END AS target FROM s2 LEFT JOIN lv ON true),
s4 AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS times FROM s3),
s5 AS (SELECT *, target - times * source_size AS need FROM s4),
run AS (SELECT doc_id, source, size, h, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY source, h) AS here FROM d)
SELECT doc_id, run.source AS source, size, source_size, target,
       (size * (times + CASE WHEN upto <= need OR (upto - here <= need AND upto - need <= need - (upto - here)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run JOIN s5 ON run.source IS NOT DISTINCT FROM s5.source
"""
