"""Streams against their batch forms, over several micro-batches and a restart from the checkpoint."""

import datetime as dt

from tests.test_tracker import INDEX, ONE, TWO, _recite
from waymark.operators.tracker import follow, follow_stream
from waymark.streaming import sessions


def _files(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{i}")


def _stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _run(df, out, checkpoint):
    query = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None


def test_follow_stream_goes_on_after_a_restart(spark, tmp_path):
    schema = "rec string, t double, fragment string"
    rows = [("r1", t, x) for t, x in _recite(ONE)] + [("r2", t, x) for t, x in _recite(TWO)]
    early, middle, late = ([r for r in rows if a < r[1] <= b] for a, b in ((0, 5), (5, 9), (9, 99)))
    inp, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    _files(spark, inp, [early, middle], schema)
    _run(follow_stream(_stream(spark, inp, schema), INDEX), out, mark)
    spark.createDataFrame(late, schema).coalesce(1).write.parquet(f"{inp}/2")
    _run(follow_stream(_stream(spark, inp, schema), INDEX), out, mark)
    got = {(r.rec, r.t): (r.text, r.line, r.word) for r in spark.read.parquet(out).collect()}
    want = {(r.rec, r.t): (r.text, r.line, r.word) for r in follow(spark.createDataFrame(rows, schema), INDEX).collect()}
    assert got == want


def test_sliding_windows_close_with_the_watermark(spark, tmp_path):
    schema = "at timestamp_ntz, kind string"
    begin = dt.datetime(2024, 1, 1)
    first = [(begin + dt.timedelta(seconds=s), "a") for s in (1, 2, 8)] + [(begin + dt.timedelta(seconds=120), "a")]
    too_late = [(begin + dt.timedelta(seconds=3), "a"), (begin + dt.timedelta(seconds=300), "a")]
    inp, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    _files(spark, inp, [first], schema)
    _run(sessions.sliding_counts(_stream(spark, inp, schema), "at", ["kind"]), out, mark)
    spark.createDataFrame(too_late, schema).coalesce(1).write.parquet(f"{inp}/1")
    _run(sessions.sliding_counts(_stream(spark, inp, schema), "at", ["kind"]), out, mark)
    got = {(r.begin - begin).total_seconds(): r.n for r in spark.read.parquet(out).collect() if r.begin < begin + dt.timedelta(seconds=60)}
    want = {b: n for b in range(-5, 9) if (n := sum(b <= s < b + 6 for s in (1, 2, 8)))}
    assert got == want


def test_idle_sessions(spark, tmp_path):
    schema = "at timestamp, who string"
    begin = dt.datetime(2024, 1, 1)
    rows = [(begin + dt.timedelta(seconds=s), w) for s, w in ((0, "x"), (50, "x"), (200, "x"), (10, "y"), (1000, "z"))]
    inp, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    _files(spark, inp, [rows], schema)
    _run(sessions.idle_sessions(_stream(spark, inp, schema), "at", "who"), out, mark)
    got = sorted((r.who, r.n, (r.until - r.begin).total_seconds()) for r in spark.read.parquet(out).collect())
    assert got == [("x", 1, 60.0), ("x", 2, 110.0), ("y", 1, 60.0)]


def test_pieces_are_taken_once_and_in_order(spark, tmp_path):
    schema = "session string, seq int, at timestamp"
    at = lambda seconds: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    inp, out, mark = (f"{tmp_path}/{n}" for n in ("in", "out", "mark"))
    _files(spark, inp, [[("s", 0, at(0)), ("s", 1, at(1)), ("u", 0, at(2))]], schema)
    _run(sessions.assemble(_stream(spark, inp, schema)), out, mark)
    spark.createDataFrame([("s", 1, at(5)), ("s", 2, at(6)), ("u", 5, at(7)), ("v", 0, at(50))], schema).coalesce(1).write.parquet(f"{inp}/1")
    spark.createDataFrame([("v", 1, at(90))], schema).coalesce(1).write.parquet(f"{inp}/2")
    _run(sessions.assemble(_stream(spark, inp, schema)), out, mark)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    want = [("s", 0, "taken", 1), ("s", 1, "taken", 2), ("s", 1, "again", 2), ("s", 2, "taken", 3), ("u", 0, "taken", 1), ("u", 5, "gap", 1), ("v", 0, "taken", 1), ("v", 1, "taken", 2)]
    assert got == sorted([*want, ("s", -1, "built", 3), ("u", -1, "built", 1)])
