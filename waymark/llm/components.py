"""Connected components of a table of links, by minimum labels in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.scratch import materialize


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """links (a long, b long) -> (node, component): the smallest node that each linked node can reach.

    Alternating large-star and small-star steps: each node hands its neighbours to the smallest one it knows. Every round
    rewrites the links (written to shared storage) and at most a logarithmic number of rounds in the longest
    path is needed; a hot node is a group key with partial aggregation, never a collected list.
    """
    links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    links = materialize(links, "links")
    mark = _mark(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("_n")).agg(F.least(F.min("b"), F.col("_n")).alias("_m"))
        # large star: neighbours larger than the node go to its smallest neighbour
        large = both.filter("b > a").join(least, F.col("a") == F.col("_n")).select(F.col("_m").alias("a"), "b").filter("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        down = large.groupBy(F.col("b").alias("_n")).agg(F.min("a").alias("_m"))
        small = large.join(down, F.col("b") == F.col("_n"))
        links = materialize(small.select(F.col("_m").alias("a"), F.col("a").alias("b")).union(small.select(F.col("_m").alias("a"), "b")).filter("a <> b").distinct(), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
