"""Operator 4, URL filters: a trie over reversed host labels and path segments.

A rule names a host and the beginning of a path. It fits its host, all subdomains, and every
path that starts with its path (as text: `/en/7` fits `/en/712`). The longest rule that fits decides, by
the length of host and path together; at equal length the longer host; allow beats block for
one and the same host and path.

Rule sets up to `MAX_RULES_BYTES` are compiled into a trie that is broadcast to the executors
(the size is checked); beyond it the same verdicts come from an equi-join of the URLs' host suffixes with
the rules, sharded by host.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.exactdup import LOWER, UPPER

MAX_RULES_BYTES = 32 << 20
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nodes are dicts: host labels from the last to the first, then path segments. A rule is kept at the node of its
    last whole segment under the beginning of the segment that follows it."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in sorted(rules):  # allow before block: the first of equals stays
            node = self.root
            for label in reversed(host.translate(_LOW).split(".")):
                node = node.setdefault(label, {})
            *whole, begin = path.split("/")
            paths = node.setdefault(_PATHS, {})
            for segment in whole:
                paths = paths.setdefault(segment, {})
            paths.setdefault(_RULES, {}).setdefault(begin, (host + path, verdict, len(host) + len(path), len(host)))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        best, node = None, self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            paths = node.get(_PATHS)
            for segment in segments:
                if paths is None:
                    break
                for begin, rule in paths.get(_RULES, {}).items():
                    if segment.startswith(begin) and (best is None or rule[2:] > best[2:]):
                        best = rule
                paths = paths.get(segment)
        return best and best[:2]


_PATHS, _RULES = 0, 1  # no label or segment: those are strings
_LOW = str.maketrans(UPPER, LOWER)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT, url_col: str = "url", columns: tuple[str, ...] = ("page_id",), max_rules_bytes: int = MAX_RULES_BYTES) -> DataFrame:
    """`columns` of pages with host, path, rule and verdict.

    A null URL or one without `://` has empty host and path, fits no rule and gets the default. Host: after the first
    `://` up to `/`, `?`, `#` or the end, A-Z in lower case; path: then up to `?`, `#` or the end. One row per input row; other columns are ignored.
    """
    if any(v not in ("allow", "block") for v, _, _ in rules):
        raise ValueError("verdicts are allow or block")
    rows = pages.select(*columns, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if sum(len(h) + len(p) + 200 for _, h, p in rules) > max_rules_bytes:
        return _by_join(rows, rules, default)
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [trie.value.find(h, p) if h else None for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            arrays = [*batch.columns, pa.array([f and f[0] for f in found], pa.string()), pa.array([f[1] if f else default for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, "rule", "verdict"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kept}, rule string, verdict string")


def _by_join(rows: DataFrame, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    spark = rows.sparkSession
    table = spark.createDataFrame([(h.translate(_LOW), p, h + p, v) for v, h, p in rules], "_host string, _path string, rule string, _verdict string")
    numbered = rows.withColumn("_row", F.monotonically_increasing_id())
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    places = numbered.withColumn("_suffix", F.explode(suffixes)).filter("host != ''")
    hits = places.join(table, (F.col("_suffix") == F.col("_host")) & F.col("path").startswith(F.col("_path")))
    rank = Window.partitionBy("_row").orderBy(F.desc(F.length("rule")), F.desc(F.length("_host")), "_verdict")
    best = hits.withColumn("_n", F.row_number().over(rank)).filter("_n = 1").select(F.col("_row").alias("_hit"), "rule", "_verdict")
    joined = numbered.join(best, F.col("_row") == F.col("_hit"), "left")
    return joined.select(*rows.columns, "rule", F.coalesce("_verdict", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
m AS (SELECT page_id, host, path, h || p AS rule, verdict,
             row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST, length(h) DESC) AS n
      FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
