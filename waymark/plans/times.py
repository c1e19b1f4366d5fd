"""Queries over event streams: as-of and interval joins, ticks, islands, scores, sessions, visits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import temporal
from waymark.plans.registry import query

HOUR = 3600 * 1_000_000
E = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS t, props FROM events)"


def events(t):
    return t.events.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "props")


@query(f"""WITH {E}, r AS (SELECT user_id, t, event_id AS label, value FROM e WHERE event_type = 'purchase')
SELECT l.event_id, r.label, r.value AS label_value FROM (SELECT * FROM e WHERE event_type = 'click') l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.t >= r.t""")
def label_at(t):
    """The last purchase at or before each click of the same user (null before the first)."""
    e = events(t)
    right = e.filter("event_type = 'purchase'").select("user_id", "t", F.col("event_id").alias("label"), F.col("value").alias("label_value"))
    return temporal.asof_join(e.filter("event_type = 'click'").select("event_id", "user_id", "t"), right, ["user_id"], "t", ["label", "label_value"]).select("event_id", "label", "label_value")


@query(f"""WITH {E}, s AS (SELECT user_id, event_id AS span, t, t + {6 * HOUR} AS until FROM e WHERE event_type = 'signup'),
x AS (SELECT l.event_id, l.t, s.span, s.until FROM (SELECT * FROM e WHERE event_type = 'view') l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t >= s.t)
SELECT event_id, CASE WHEN t < until THEN span END AS span FROM x""")
def segment_at(t):
    """As above with an end: six hours after a signup nothing holds any more."""
    e = events(t)
    right = e.filter("event_type = 'signup'").select("user_id", "t", F.col("event_id").alias("span"), (F.col("t") + 6 * HOUR).alias("until"))
    return temporal.asof_join(e.filter("event_type = 'view'").select("event_id", "user_id", "t"), right, ["user_id"], "t", ["span"], until="until").select("event_id", "span")


@query(f"""WITH {E}, s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY user_id),
g AS (SELECT user_id, unnest(range((ceil(a / {24 * HOUR}) * {24 * HOUR})::BIGINT, b + 1, {24 * HOUR})) AS t FROM s)
SELECT g.user_id, g.t AS tick, e.event_type AS shown FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.t >= e.t""")
def replay_ticks(t):
    """What is shown at each daily tick between a user's first and last event; an event exactly at a tick is visible."""
    e = events(t)
    spans = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    grid = temporal.ticks(spans, "a", "b", 24 * HOUR, "t").select("user_id", "t")
    return temporal.asof_join(grid, e.select("user_id", "t", F.col("event_type").alias("shown")), ["user_id"], "t", ["shown"]).select("user_id", F.col("t").alias("tick"), "shown")


@query(f"""WITH {E}, s AS (SELECT event_id AS span, user_id, t AS a, t + {12 * HOUR} AS b FROM e WHERE event_type = 'signup')
SELECT span, count(*) AS n, round(sum(value), 4) AS total FROM s JOIN e ON e.user_id = s.user_id AND e.t >= a AND e.t < b GROUP BY span""")
def inside_spans(t):
    """Events inside the twelve hours after each signup of the same user."""
    e = events(t)
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("span"), "user_id", F.col("t").alias("a"), (F.col("t") + 12 * HOUR).alias("b"))
    joined = temporal.interval_join(e.select("user_id", "t", "value"), spans, ["user_id"], "t", "a", "b", 12 * HOUR)
    return joined.groupBy("span").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""WITH {E}, p AS (SELECT l.event_id, r.event_id AS o, abs(l.t - r.t) AS d, r.t AS rt FROM e l JOIN e r ON l.user_id = r.user_id AND r.event_type = 'purchase' AND abs(l.t - r.t) <= {6 * HOUR} WHERE l.event_type = 'error'),
b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, rt, o) AS n FROM p)
SELECT e.event_id, b.o AS nearest, b.d AS distance FROM e LEFT JOIN b ON e.event_id = b.event_id AND n = 1 WHERE event_type = 'error'""")
def nearest_purchase(t):
    """The nearest purchase within six hours of each error, the earlier at ties."""
    e = events(t)
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("o"), F.col("event_id").alias("v"))
    return temporal.nearest_join(e.filter("event_type = 'error'").select("event_id", "user_id", "t"), right, ["user_id"], "t", "o", 6 * HOUR, "v").select("event_id", "nearest", "distance")


@query(f"""WITH {E}, s AS (SELECT event_id, user_id, t FROM e WHERE event_type = 'error')
SELECT e.event_id FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = e.user_id AND e.t >= s.t AND e.t < s.t + {24 * HOUR})""")
def outside_errors(t):
    """Events outside the day that follows any error of the same user (interval anti join)."""
    e = events(t)
    spans = e.filter("event_type = 'error'").select("user_id", F.col("t").alias("a"), (F.col("t") + 24 * HOUR).alias("b"))
    inside = temporal.interval_join(e.select("event_id", "user_id", "t"), spans, ["user_id"], "t", "a", "b", 24 * HOUR).select("event_id")
    return e.select("event_id").join(inside, "event_id", "left_anti")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def without_orders(t):
    return t.customer.select("c_custkey").join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("""SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS
(SELECT 1 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size >= 10 WHERE l_orderkey = o_orderkey AND p_partkey IS NULL)""")
def complete_orders(t):
    """Orders all of whose lines have a part of the wanted kind: semi join, and anti join on the missing."""
    wanted = t.part.filter("p_size >= 10").select(F.col("p_partkey").alias("l_partkey"))
    missing = t.lineitem.select("l_orderkey", "l_partkey").join(wanted, "l_partkey", "left_anti").select(F.col("l_orderkey").alias("o_orderkey"))
    some = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return t.orders.select("o_orderkey").join(some, "o_orderkey", "left_semi").join(missing, "o_orderkey", "left_anti")


@query(f"""WITH {E}, w AS (SELECT *, lag(t) OVER p AS pt, lag(event_type) OVER p AS pk FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id)),
i AS (SELECT *, sum(CASE WHEN pt IS NULL OR t - pt > {12 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM w)
SELECT user_id, i::BIGINT AS run, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY user_id, i""")
def activity_runs(t):
    """Gaps and islands: a gap of over twelve hours starts a new run."""
    e = events(t)
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    found = temporal.islands(e, ["user_id"], ["t", "event_id"], F.col("t") - F.lag("t").over(w) > 12 * HOUR, "run")
    return found.groupBy("user_id", "run").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n"))


@query(f"""WITH {E}, w AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS pk FROM e),
i AS (SELECT *, sum(CASE WHEN pk IS DISTINCT FROM event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM w)
SELECT user_id, event_type AS state, min(t) AS first, max(t) AS last, count(*) AS n FROM i GROUP BY user_id, event_type, i HAVING count(*) >= 2""")
def state_spans(t):
    """Runs of at least two events of one type."""
    e = events(t)
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    found = temporal.islands(e, ["user_id"], ["t", "event_id"], F.lag("event_type").over(w).isNull() | (F.col("event_type") != F.lag("event_type").over(w)))
    return found.groupBy("user_id", F.col("event_type").alias("state"), "island").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).filter("n >= 2").drop("island")


@query(f"""WITH {E}, x AS (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM e)
SELECT event_id, user_id, value FROM x WHERE m IS NULL OR value > m""")
def rising_values(t):
    return temporal.monotone(events(t), ["user_id"], ["t", "event_id"], "value").select("event_id", "user_id", "value")


@query(f"""WITH {E}, w AS (SELECT *, value >= 10 AS o, lag(value >= 10) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e),
i AS (SELECT *, sum(CASE WHEN o IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM w)
SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n, max(value) AS peak FROM i WHERE o GROUP BY user_id, i HAVING count(*) >= 3 AND max(value) >= 50""")
def loud_runs(t):
    """At least three consecutive values of 10 or more with a peak of 50."""
    return temporal.runs(events(t), ["user_id"], ["t", "event_id"], "value", 10, 3, 50)


@query(f"""WITH {E}, w AS (SELECT user_id, event_type, value, lag(event_type) OVER p AS p1, lead(event_type) OVER p AS n1, t - lag(t) OVER p AS gap FROM e WINDOW p AS (PARTITION BY user_id ORDER BY t, event_id))
SELECT user_id, count(*) AS steps, count(*) FILTER (p1 = n1 AND p1 <> event_type) AS flicker, count(*) FILTER (p1 IS NOT NULL AND p1 <> event_type) AS changes,
 round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.9), 3) AS p90 FROM w GROUP BY user_id""")
def session_stability(t):
    """Changes of what is shown, flicker (A B A), and percentiles of the gaps."""
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    rows = events(t).select("user_id", "event_type", F.lag("event_type").over(w).alias("p"), F.lead("event_type").over(w).alias("n"), (F.col("t") - F.lag("t").over(w)).alias("gap"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("steps"),
        F.count_if((F.col("p") == F.col("n")) & (F.col("p") != F.col("event_type"))).alias("flicker"),
        F.count_if(F.col("p") != F.col("event_type")).alias("changes"),
        F.round(F.percentile("gap", 0.5), 3).alias("p50"),
        F.round(F.percentile("gap", 0.9), 3).alias("p90"),
    )


@query(f"""WITH {E}, k AS (SELECT user_id, t, event_id, event_type AS truth, CASE WHEN value < 2 THEN NULL ELSE lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) END AS shown FROM e),
j AS (SELECT *, last_value(shown IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM k)
SELECT user_id, count(*) AS steps, count(*) FILTER (shown = truth) AS hit, count(*) FILTER (shown IS NULL) AS nothing, count(*) FILTER (shown <> truth) AS wrong, count(*) FILTER (shown <> prev) AS jumps FROM j GROUP BY user_id""")
def follow_score(t):
    """Steps, hits, nothing shown (in the denominator, never wrong), wrong, and jumps against the last thing shown."""
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    rows = events(t).withColumn("shown", F.when(F.col("value") >= 2, F.lag("event_type").over(w)))
    rows = rows.withColumn("prev", F.last("shown", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return rows.groupBy("user_id").agg(F.count("*").alias("steps"), F.count_if(F.col("shown") == F.col("event_type")).alias("hit"), F.count_if(F.col("shown").isNull()).alias("nothing"), F.count_if(F.col("shown") != F.col("event_type")).alias("wrong"), F.count_if(F.col("shown") != F.col("prev")).alias("jumps"))


@query(f"""WITH {E}, k AS (SELECT *, list(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS b, lead(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e)
SELECT user_id, count(*) FILTER (coalesce(list_contains(b, event_type), false)) AS echo, count(*) FILTER (event_type = n) AS early, count(*) FILTER (NOT coalesce(list_contains(b, event_type), false) AND event_type IS DISTINCT FROM n) AS far FROM k GROUP BY user_id""")
def move_kinds(t):
    """Moves by what surrounds them: seen in the three before, the same as the next, or neither."""
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    rows = events(t).withColumn("before", F.collect_list("event_type").over(w.rowsBetween(-3, -1))).withColumn("next", F.lead("event_type").over(w))
    echo, early = F.expr("array_contains(before, event_type)"), F.col("event_type").eqNullSafe(F.col("next"))
    return rows.groupBy("user_id").agg(F.count_if(echo).alias("echo"), F.count_if(early).alias("early"), F.count_if(~echo & ~early).alias("far"))


@query(f"""WITH {E}, f AS (SELECT user_id, t, event_id, value < 5 AS bad, lag(value < 5) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e WHERE event_type <> 'error'),
i AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS i FROM f),
r AS (SELECT user_id, count(*) AS n FROM i WHERE bad GROUP BY user_id, i HAVING count(*) >= 3) SELECT user_id, count(*) AS episodes, max(n) AS longest FROM r GROUP BY user_id""")
def lost_episodes(t):
    """At least three bad steps in a row, errors skipped without breaking a run."""
    rows = events(t).filter("event_type <> 'error'").withColumn("bad", F.col("value") < 5)
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    found = temporal.islands(rows, ["user_id"], ["t", "event_id"], F.lag("bad").over(w).isNull() | (F.col("bad") != F.lag("bad").over(w)))
    each = found.filter("bad").groupBy("user_id", "island").agg(F.count("*").alias("n")).filter("n >= 3")
    return each.groupBy("user_id").agg(F.count("*").alias("episodes"), F.max("n").alias("longest"))


@query(f"""WITH {E}, v AS (SELECT user_id, json_extract_string(props, '$.k')::INT AS k, t, event_type, value FROM e)
SELECT user_id, k // 25 AS port, min(t) AS first, max(t) AS last, count(*) AS requests, count(*) FILTER (event_type = 'view' AND value < 40) AS opened, count(DISTINCT k) AS links,
 array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM v GROUP BY user_id, k // 25""")
def visitors(t):
    """Rollup per visitor: first and last, requests, opened pages, distinct links, kinds."""
    rows = events(t).withColumn("k", F.get_json_object("props", "$.k").cast("int")).withColumn("port", F.expr("cast(k div 25 as int)"))
    return rows.groupBy("user_id", "port").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("requests"), F.count_if((F.col("event_type") == "view") & (F.col("value") < 40)).alias("opened"), F.countDistinct("k").alias("links"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query(f"""WITH {E}, c AS (SELECT user_id, event_type, count(*) AS n, min(t) AS f FROM e GROUP BY ALL) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1""")
def majority_label(t):
    return temporal.mode_first(events(t), ["user_id"], "event_type", "t")


@query(f"""WITH {E}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) // 4 AS q FROM e)
SELECT user_id, (i // q)::INT AS quarter, round(quantile_cont(value, 0.5), 6) AS middle FROM r WHERE q > 0 AND i < 4 * q GROUP BY user_id, i // q""")
def drift_by_quarter(t):
    """Median per quarter of each user's events; the remainder of the division is left out."""
    w = temporal.window_of(["user_id"], ["t", "event_id"])
    rows = events(t).select("user_id", "value", (F.row_number().over(w) - 1).alias("i"), F.expr("count(*) over (partition by user_id) div 4").alias("q"))
    return rows.filter("q > 0 and i < 4 * q").groupBy("user_id", F.expr("cast(i div q as int)").alias("quarter")).agg(F.round(F.percentile("value", 0.5), 6).alias("middle"))


@query(f"""WITH {E}, s AS (SELECT user_id, t FROM e WHERE event_type = 'purchase'), o AS (SELECT s.user_id, s.t, e.event_type, (e.t - s.t) AS d FROM s JOIN e ON e.user_id = s.user_id AND e.t > s.t AND e.t <= s.t + {48 * HOUR})
SELECT user_id, t, count(*) AS steps, count(*) FILTER (event_type = 'click') AS clicks, arg_max(event_type, d) AS final FROM o GROUP BY user_id, t""")
def after_stops(t):
    """What happens in the two days after each purchase, and what is shown last."""
    e = events(t)
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("s"), (F.col("t") + 1).alias("a"), (F.col("t") + 48 * HOUR + 1).alias("b"))
    joined = temporal.interval_join(e.select("user_id", "t", "event_type"), spans, ["user_id"], "t", "a", "b", 48 * HOUR)
    return joined.groupBy("user_id", F.col("s").alias("t")).agg(F.count("*").alias("steps"), F.count_if(F.col("event_type") == "click").alias("clicks"), F.max_by("event_type", joined["t"]).alias("final"))


@query(f"""WITH {E} SELECT a.event_id, min(b.t) AS next_change FROM e a LEFT JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.event_type = 'signup' GROUP BY a.event_id""")
def first_later(t):
    """The first later signup of the same user."""
    e = events(t)
    return temporal.next_boundary(e, ["user_id"], ["t", "event_id"], F.col("event_type") == "signup", "t", "next_change").select("event_id", "next_change")


@query(f"""WITH {E}, m AS (SELECT event_type AS scenario, avg(value) AS mean, max(value) AS peak, count(*)::DOUBLE AS n FROM e GROUP BY event_type),
l AS (SELECT scenario, metric, value FROM m UNPIVOT (value FOR metric IN (mean, peak, n))), b(metric, op, bar) AS (VALUES ('mean', '<=', 20.0), ('peak', '<=', 400.0), ('n', '>=', 100.0))
SELECT scenario, l.metric, round(value, 4) AS value, CASE WHEN op = '<=' THEN value <= bar ELSE value >= bar END AS ok FROM l JOIN b ON l.metric = b.metric""")
def guard_bars(t):
    """Metrics against their bars, one row per scenario and metric."""
    m = events(t).groupBy(F.col("event_type").alias("scenario")).agg(F.avg("value").alias("mean"), F.max("value").alias("peak"), F.count("*").cast("double").alias("n"))
    long = m.unpivot("scenario", ["mean", "peak", "n"], "metric", "value")
    bars = t.spark.createDataFrame([("mean", "<=", 20.0), ("peak", "<=", 400.0), ("n", ">=", 100.0)], "metric string, op string, bar double")
    ok = F.when(F.col("op") == "<=", F.col("value") <= F.col("bar")).otherwise(F.col("value") >= F.col("bar"))
    return long.join(bars, "metric").select("scenario", "metric", F.round("value", 4).alias("value"), ok.alias("ok"))


@query(f"""WITH {E}, g(level, factor) AS (SELECT * FROM (VALUES (1), (5), (25)), (VALUES (1), (2)))
SELECT level, factor, count(*) FILTER (value >= level * factor) AS kept, count(*) AS n FROM e, g GROUP BY level, factor""")
def settings_grid(t):
    """A grid of settings against all rows, in one pass: the grid is the small side."""
    grid = t.spark.createDataFrame([(a, b) for a in (1, 5, 25) for b in (1, 2)], "level int, factor int")
    rows = events(t).select("value").crossJoin(F.broadcast(grid))  # six rows
    return rows.groupBy("level", "factor").agg(F.count_if(F.col("value") >= F.col("level") * F.col("factor")).alias("kept"), F.count("*").alias("n"))


@query(f"""WITH {E}, w AS (SELECT event_type, unnest(range((t // {HOUR} - 5) * {HOUR}, (t // {HOUR} + 1) * {HOUR}, {HOUR})) AS begin FROM e) SELECT begin, event_type, count(*) AS n FROM w GROUP BY ALL""")
def sliding_windows(t):
    """Six-hour windows every hour."""
    rows = t.events.select(F.window(F.col("ts").cast("timestamp"), "6 hours", "1 hour").alias("w"), "event_type")
    return rows.groupBy("w", "event_type").agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("begin"), "event_type", "n")


@query(f"""WITH {E}, w AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t) AS p FROM e), i AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= {24 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS i FROM w)
SELECT user_id, min(t) AS begin, max(t) + {24 * HOUR} AS until, count(*) AS n FROM i GROUP BY user_id, i""")
def idle_sessions(t):
    """Sessions that end after a day without events."""
    rows = t.events.select("user_id", F.session_window(F.col("ts").cast("timestamp"), "24 hours").alias("w"))
    return rows.groupBy("user_id", "w").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("w.start").alias("begin"), F.unix_micros("w.end").alias("until"), "n")


@query("""WITH p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT DISTINCT conv_id, turn FROM conversations)), d AS (SELECT conv_id, count(*) - count(DISTINCT turn) AS repeated FROM conversations GROUP BY conv_id)
SELECT p.conv_id, count(*) AS pieces, any_value(repeated) AS repeated, count(*) FILTER (coalesce(turn - b, turn + 1) <> 1) AS gaps FROM p JOIN d ON p.conv_id = d.conv_id GROUP BY p.conv_id""")
def session_pieces(t):
    """Pieces of a session by number: repeated ones are acknowledged once, missing ones are gaps."""
    counted = t.conversations.groupBy("conv_id", "turn").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = counted.withColumn("_step", F.col("turn") - F.coalesce(F.lag("turn").over(w), F.lit(-1)))
    return rows.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.sum(F.col("_n") - 1).cast("long").alias("repeated"), F.count_if(F.col("_step") != 1).alias("gaps"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey, o_totalprice, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS p, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS q FROM orders)
SELECT o_orderkey AS k, p AS same_as FROM a WHERE o_totalprice - q < 500""")
def same_length(t):
    """Recordings of one text whose length differs by under 500 from the one before."""
    w = temporal.window_of(["o_custkey"], ["o_totalprice", "o_orderkey"])
    rows = t.orders.select("o_orderkey", "o_totalprice", F.lag("o_orderkey").over(w).alias("same_as"), F.lag("o_totalprice").over(w).alias("_q"))
    return rows.filter(F.col("o_totalprice") - F.col("_q") < 500).select(F.col("o_orderkey").alias("k"), "same_as")


@query("SELECT c_mktsegment, c_custkey, c_acctbal, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def top_three(t):
    rows = t.customer.select("c_mktsegment", "c_custkey", "c_acctbal")
    return temporal.top_k(rows, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3)
