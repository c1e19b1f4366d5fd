from pyspark.sql import functions as F

from waymark.operators import temporal as T


def test_asof_is_inclusive_and_ends(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 5, "x", 9), ("a", 2, "w", None)], "k string, t long, v string, until long")
    plain = T.asof_join(left, right, ["k"], "t", ["v"])
    assert {(r.k, r.t): r.v for r in plain.collect()} == {("a", 1): None, ("a", 5): "x", ("a", 9): "x", ("b", 5): None}
    ended = T.asof_join(left, right, ["k"], "t", ["v"], until="until")
    assert {(r.k, r.t): r.v for r in ended.collect()}["a", 9] is None


def test_interval_join_crosses_buckets(spark):
    points = spark.createDataFrame([(1, i) for i in range(0, 50, 5)], "k int, t long")
    spans = spark.createDataFrame([(1, 7, 33, "s"), (1, 10, 10, "empty")], "k int, a long, b long, n string")
    assert sorted(r.t for r in T.interval_join(points, spans, ["k"], "t", "a", "b", 10).collect()) == [10, 15, 20, 25, 30]


def test_ticks_of_an_empty_span(spark):
    spans = spark.createDataFrame([(1, 4), (5, 25)], "a long, b long")
    assert [r.tick for r in T.ticks(spans, "a", "b", 10).collect()] == [10, 20]


def test_monotone_equals_a_sequential_pass(spark):
    values = [3, 1, 4, 4, 5, 2, 6]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v int").withColumn("k", F.lit(1))
    kept, top = [], None
    for v in values:
        if top is None or v > top:
            kept.append(v)
            top = v
    assert [r.v for r in T.monotone(rows, ["k"], ["i"], "v").orderBy("i").collect()] == kept


def test_results_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select((F.col("id") % 7).alias("k"), F.col("id").alias("t"), (F.col("id") * 37 % 11).alias("v"))
    seen = set()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for n in ("1", "4", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        w = T.window_of(["k"], ["t"])
        got = T.islands(rows, ["k"], ["t"], F.col("v") < F.lag("v").over(w)).groupBy("k", "island").agg(F.count("*").alias("n"))
        seen.add(tuple(sorted(map(tuple, got.collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(seen) == 1
