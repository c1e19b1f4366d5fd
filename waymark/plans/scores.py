"""Queries that score what was shown against what was true: lines, moves, words, stops, sessions, rates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.operators import temporal
from waymark.plans.registry import query
from waymark.plans.times import HOUR, E, events

KEYS, ORDER = ["user_id"], ["t", "event_id"]
W = "(PARTITION BY user_id ORDER BY t, event_id)"
#: A display beside the truth: every fourth event starts a line; what is shown is missing, of another text, or some lines off now and then.
STEPS = f"""{E}, st AS (SELECT *, row_number() OVER {W} - 1 AS i FROM e),
s AS (SELECT user_id, event_id, event_type, t, value, i, i // 4 AS line, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN 'other' ELSE 'own' END AS piece,
 CASE WHEN event_id % 11 <> 0 THEN i // 4 + CASE WHEN event_id % 5 = 0 THEN event_id % 7 - 3 ELSE 0 END END AS seg FROM st)"""


def by_time():
    return temporal.window_of(KEYS, ORDER)


def steps(t):
    rows = events(t).withColumn("i", F.row_number().over(by_time()) - 1).withColumn("line", F.expr("cast(i div 4 as bigint)"))
    k = F.col("event_id")
    shown = k % 11 != 0
    rows = rows.withColumn("piece", F.when(shown, F.when(k % 13 == 0, "other").otherwise("own")))
    return rows.withColumn("seg", F.when(shown, F.col("line") + F.when(k % 5 == 0, k % 7 - 3).otherwise(0)))


def own(column="piece"):
    return F.coalesce(F.col(column) == "own", F.lit(False))


@query(f"""WITH {STEPS}, p AS (SELECT *, last_value(piece IGNORE NULLS) OVER b AS pd, last_value(seg IGNORE NULLS) OVER b AS ps FROM s WINDOW b AS (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, count(*) AS steps, count(*) FILTER (piece = 'own' AND seg = line) AS line, count(*) FILTER (piece = 'own' AND abs(seg - line) <= 1) AS line_pm1, count(*) FILTER (piece = 'own') AS text_ok,
 count(*) FILTER (piece <> 'own') AS wrong_text, count(*) FILTER (line % 3 = 0) AS refrain_steps, count(*) FILTER (line % 3 = 0 AND piece = 'own' AND seg = line) AS refrain_line,
 count(*) FILTER (pd = piece AND seg - ps NOT IN (0, 1)) AS jumps FROM p GROUP BY user_id""")
def line_following(t):
    """Per listener: steps, line right, within one line, text right, wrong text (nothing shown is never wrong), refrain lines, jumps against the last thing shown."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("piece").isNotNull(), F.struct("piece", "seg")), ignorenulls=True).over(before)
    rows = steps(t).withColumn("prev", last)
    right = own() & (F.col("seg") == F.col("line"))
    refrain, step = F.col("line") % 3 == 0, F.col("seg") - F.col("prev.seg")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("steps"),
        F.count_if(right).alias("line"),
        F.count_if(own() & (F.abs(F.col("seg") - F.col("line")) <= 1)).alias("line_pm1"),
        F.count_if(own()).alias("text_ok"),
        F.count_if(F.col("piece") != "own").alias("wrong_text"),
        F.count_if(refrain).alias("refrain_steps"),
        F.count_if(refrain & right).alias("refrain_line"),
        F.count_if((F.col("prev.piece") == F.col("piece")) & ~step.isin(0, 1)).alias("jumps"),
    )


LAGS = f"""{STEPS}, b AS (SELECT user_id, line, min(t) AS s0 FROM s GROUP BY user_id, line), z AS (SELECT user_id, max(t) AS z FROM s GROUP BY user_id),
n AS (SELECT b.user_id, line, s0, coalesce(lead(s0) OVER (PARTITION BY b.user_id ORDER BY line), z) AS s1 FROM b JOIN z ON b.user_id = z.user_id),
lags AS (SELECT n.user_id, n.line, min(s.t) - any_value(s0) AS lag FROM n LEFT JOIN s ON s.user_id = n.user_id AND s.piece = 'own' AND s.seg = n.line AND s.t >= s0 AND s.t <= s1 + {2 * HOUR} WHERE s1 - s0 >= {2 * HOUR} GROUP BY n.user_id, n.line)"""


def entry_lags(t):
    """Per line of at least two hours: how long after its start the display first shows it, at most two hours past its end; null if it never does."""
    rows = steps(t)
    starts = rows.groupBy("user_id", "line").agg(F.min("t").alias("s0"))
    ends = rows.groupBy("user_id").agg(F.max("t").alias("_z"))
    w = temporal.window_of(KEYS, ["line"])
    lines = starts.join(ends, "user_id").withColumn("s1", F.coalesce(F.lead("s0").over(w), F.col("_z"))).filter(F.col("s1") - F.col("s0") >= 2 * HOUR)
    shown = rows.filter(own()).select("user_id", F.col("seg").alias("line"), F.col("t").alias("_t"))
    found = lines.join(shown, ["user_id", "line"]).filter((F.col("_t") >= F.col("s0")) & (F.col("_t") <= F.col("s1") + 2 * HOUR))
    first = found.groupBy("user_id", "line").agg(F.min("_t").alias("_f"))
    return lines.join(first, ["user_id", "line"], "left").select("user_id", "line", (F.col("_f") - F.col("s0")).alias("lag"))


@query(f"WITH {LAGS} SELECT user_id, line, lag FROM lags")
def line_entry_lags(t):
    return entry_lags(t)


@query(f"""WITH {LAGS}, a AS (SELECT user_id % 5 AS lane, count(*) AS steps, count(*) FILTER (piece = 'own' AND seg = line) AS hit, count(*) FILTER (piece <> 'own') AS wrong FROM s GROUP BY user_id % 5),
l AS (SELECT user_id % 5 AS lane, count(*) AS boundaries, count(*) FILTER (lag IS NULL) AS missed, quantile_cont(lag, 0.5) AS median_lag FROM lags GROUP BY user_id % 5)
SELECT a.lane, round(hit / steps, 6) AS line_acc, round(wrong / steps, 6) AS wrong_shown, round(missed / greatest(boundaries, 1), 6) AS lines_missed, round(median_lag, 3) AS median_lag FROM a JOIN l ON a.lane = l.lane""")
def rollup_rates(t):
    """Micro-averages by lane: sums before any division; lags pooled over all items for their median."""
    lane = (F.col("user_id") % 5).alias("lane")
    sums = steps(t).groupBy(lane).agg(F.count("*").alias("n"), F.count_if(own() & (F.col("seg") == F.col("line"))).alias("hit"), F.count_if(F.col("piece") != "own").alias("wrong"))
    lags = entry_lags(t).groupBy(lane).agg(F.count("*").alias("b"), F.count_if(F.col("lag").isNull()).alias("m"), F.round(F.percentile("lag", 0.5), 3).alias("median_lag"))
    rate = lambda a, b: F.round(F.col(a) / b, 6)
    return sums.join(lags, "lane").select("lane", rate("hit", F.col("n")).alias("line_acc"), rate("wrong", F.col("n")).alias("wrong_shown"), rate("m", F.greatest(F.col("b"), F.lit(1))).alias("lines_missed"), "median_lag")


@query(f"""WITH {STEPS}, d AS (SELECT user_id, t, event_id, CASE WHEN piece IS NOT NULL THEN piece || '#' || seg END AS d, CASE WHEN event_id % 17 <> 0 THEN 'own#' || line END AS tl FROM s),
w AS (SELECT *, lag(d) OVER {W} AS pd, lag(d = tl) OVER {W} AS pok, lag(event_id) OVER {W} AS pe,
 coalesce(list(tl) FILTER (tl IS NOT NULL) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 30 PRECEDING AND 10 FOLLOWING), []) AS near FROM d),
m AS (SELECT *, coalesce(tl, near[1]) AS ref FROM w WHERE pe IS NOT NULL AND d IS NOT NULL AND d IS DISTINCT FROM pd AND NOT list_contains(near, d)),
k AS (SELECT user_id, split_part(d, '#', 1) <> split_part(ref, '#', 1) OR abs(split_part(d, '#', 2)::INT - split_part(ref, '#', 2)::INT) >= 2 AS far, pd IS NOT NULL AND (coalesce(pok, false) OR list_contains(near, pd)) AS was_ok FROM m WHERE ref IS NOT NULL)
SELECT user_id, count(*) FILTER (was_ok AND far) AS jump, count(*) FILTER (was_ok AND NOT far) AS early, count(*) FILTER (NOT was_ok AND far) AS far FROM k GROUP BY user_id""")
def display_moves(t):
    """Moves away from the reader: a jump (from where the reader is or just was to two lines or more away, or to another text), early (to the neighbouring line
    first), far (away while already lost). Where the reader is or just was: any true place from 30 ticks before to 10 after."""
    k = F.col("event_id")
    rows = steps(t).select(*KEYS, *ORDER, F.concat_ws("#", "piece", "seg").alias("d"), F.col("piece").isNotNull().alias("_some"), F.when(k % 17 != 0, F.concat(F.lit("own#"), F.col("line"))).alias("tl"))
    rows = rows.withColumn("d", F.when(F.col("_some"), F.col("d")))
    w = by_time()
    rows = rows.withColumn("pd", F.lag("d").over(w)).withColumn("pok", F.lag(F.col("d") == F.col("tl")).over(w)).withColumn("pe", F.lag("event_id").over(w)).withColumn("near", F.collect_list("tl").over(w.rowsBetween(-30, 10)))
    moved = rows.filter("pe is not null and d is not null and not (d <=> pd) and not array_contains(near, d)").withColumn("ref", F.coalesce("tl", F.get("near", F.lit(0)))).filter("ref is not null")
    text, line = (lambda c, n=n: F.split_part(F.col(c), F.lit("#"), F.lit(n)) for n in (1, 2))
    far = (text("d") != text("ref")) | (F.abs(line("d").cast("int") - line("ref").cast("int")) >= 2)
    was_ok = F.expr("pd is not null and (coalesce(pok, false) or array_contains(near, pd))")
    return moved.groupBy("user_id").agg(F.count_if(was_ok & far).alias("jump"), F.count_if(was_ok & ~far).alias("early"), F.count_if(~was_ok & far).alias("far"))


VISIBLE = f"""{STEPS}, r AS (SELECT *, event_type = 'purchase' AS tap, CASE WHEN event_type = 'purchase' THEN 'own' ELSE piece END AS vd, CASE WHEN event_type = 'purchase' THEN line ELSE seg END AS vs FROM s),
v AS (SELECT *, last_value(vd IGNORE NULLS) OVER {W} AS d, last_value(vs IGNORE NULLS) OVER {W} AS l FROM r),
h AS (SELECT *, CASE WHEN d = 'own' THEN l END AS sl FROM v WHERE NOT tap), f AS (SELECT *, lag(sl) OVER {W} AS p, lead(sl) OVER {W} AS n FROM h WHERE sl IS NOT NULL)"""


@query(f"""WITH {VISIBLE}, a AS (SELECT user_id, count(*) AS hops, count(*) FILTER (piece IS NULL AND d IS NOT NULL) AS held FROM h GROUP BY user_id),
b AS (SELECT user_id, count(*) FILTER (sl < p) AS back, count(*) FILTER (p = n AND sl <> p) AS flicker FROM f GROUP BY user_id),
c AS (SELECT v.user_id, v.event_id, max(CASE WHEN h.sl <> v.line THEN 1 ELSE 0 END) AS undone FROM v LEFT JOIN h ON h.user_id = v.user_id AND h.t > v.t AND h.t <= v.t + {2 * HOUR + HOUR // 2} WHERE v.tap GROUP BY v.user_id, v.event_id),
u AS (SELECT user_id, count(*) AS taps, sum(undone)::BIGINT AS undone FROM c GROUP BY user_id)
SELECT a.user_id, hops, held, coalesce(back, 0) AS back, coalesce(flicker, 0) AS flicker, coalesce(taps, 0) AS taps, coalesce(undone, 0) AS undone FROM a LEFT JOIN b ON a.user_id = b.user_id LEFT JOIN u ON a.user_id = u.user_id""")
def display_stability(t):
    """What stays visible through lapses (held), goes back, flickers (A B A), and taps that something else overrides within two and a half hours."""
    tap = F.col("event_type") == "purchase"
    rows = steps(t).withColumn("tap", tap)
    seen = F.when(tap, F.struct(F.lit("own").alias("d"), F.col("line").alias("l"))).when(F.col("piece").isNotNull(), F.struct(F.col("piece").alias("d"), F.col("seg").alias("l")))
    rows = rows.withColumn("v", F.last(seen, ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0)))
    hops = rows.filter(~F.col("tap")).withColumn("sl", F.when(F.col("v.d") == "own", F.col("v.l")))
    held = hops.groupBy("user_id").agg(F.count("*").alias("hops"), F.count_if(F.col("piece").isNull() & F.col("v").isNotNull()).alias("held"))
    lines = hops.filter("sl is not null").select("user_id", "sl", F.lag("sl").over(by_time()).alias("p"), F.lead("sl").over(by_time()).alias("n"))
    turns = lines.groupBy("user_id").agg(F.count_if(F.col("sl") < F.col("p")).alias("back"), F.count_if((F.col("p") == F.col("n")) & (F.col("sl") != F.col("p"))).alias("flicker"))
    taps = rows.filter("tap").select("user_id", F.col("event_id").alias("_tap"), F.col("line").alias("_line"), (F.col("t") + 1).alias("a"), (F.col("t") + 2 * HOUR + HOUR // 2 + 1).alias("b"))
    after = temporal.interval_join(hops.select("user_id", "t", "sl"), taps, KEYS, "t", "a", "b", 2 * HOUR).filter("sl <> _line").select("_tap").distinct().withColumn("_undone", F.lit(1))
    tapped = taps.join(after, "_tap", "left").groupBy("user_id").agg(F.count("*").alias("taps"), F.count("_undone").alias("undone"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("back", "flicker", "taps", "undone")]
    return held.join(turns, "user_id", "left").join(tapped, "user_id", "left").select("user_id", "hops", "held", *zero)


@query(f"""WITH {STEPS}, g AS (SELECT user_id, value, event_type, i, count(*) OVER (PARTITION BY user_id) AS n, t - lag(t) OVER {W} AS gap, lag(value) OVER {W} AS pv, lag(event_type) OVER {W} AS pt FROM s)
SELECT user_id, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.9), 3) AS p90, round(avg(value) FILTER (i * 3 // n = 0), 6) AS third0, round(avg(value) FILTER (i * 3 // n = 1), 6) AS third1, round(avg(value) FILTER (i * 3 // n = 2), 6) AS third2,
 round(coalesce(sum(pv - value) FILTER (pv > value AND event_type <> 'signup' AND pt <> 'signup'), 0), 6) AS drained FROM g GROUP BY user_id""")
def session_summary(t):
    """Percentiles of the gaps, the mean in each third, and the drain of a level that counts only between readings that do not charge."""
    w = by_time()
    rows = steps(t).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).withColumn("gap", F.col("t") - F.lag("t").over(w)).withColumn("pv", F.lag("value").over(w)).withColumn("pt", F.lag("event_type").over(w))
    third = F.expr("i * 3 div n")
    drop = F.when((F.col("pv") > F.col("value")) & (F.col("event_type") != "signup") & (F.col("pt") != "signup"), F.col("pv") - F.col("value"))
    return rows.groupBy("user_id").agg(
        F.round(F.percentile("gap", 0.5), 3).alias("p50"),
        F.round(F.percentile("gap", 0.9), 3).alias("p90"),
        *[F.round(F.avg(F.when(third == k, F.col("value"))), 6).alias(f"third{k}") for k in range(3)],
        F.round(F.coalesce(F.sum(drop), F.lit(0.0)), 6).alias("drained"),
    )


# words: the true word is the step's number, the shown one is off now and then
WORDS = f"""{STEPS}, w AS (SELECT user_id, event_id, event_type, t, i AS word, CASE WHEN event_id % 11 <> 0 THEN i + CASE WHEN event_id % 6 = 0 THEN event_id % 9 - 4 ELSE 0 END END AS shown FROM s)"""


def words(t):
    k = F.col("event_id")
    shown = F.when(k % 11 != 0, F.col("i") + F.when(k % 6 == 0, k % 9 - 4).otherwise(0))
    return steps(t).select("user_id", "event_id", "event_type", "t", F.col("i").cast("long").alias("word"), shown.alias("shown"))


@query(f"""WITH {WORDS}, f AS (SELECT *, lag(shown) OVER {W} AS p FROM w WHERE shown IS NOT NULL), a AS (SELECT user_id, count(*) AS ticks FROM w GROUP BY user_id),
b AS (SELECT user_id, count(*) FILTER (shown = word) AS exact, count(*) FILTER (abs(shown - word) <= 1) AS near, count(*) FILTER (shown < word - 1) AS behind2, count(*) FILTER (shown > word + 1) AS ahead2,
 count(*) FILTER (shown < p OR shown > p + 2) AS jerks, count(*) FILTER (shown < p) AS backs, sum(CASE WHEN shown > p THEN shown - p - 1 WHEN shown < p THEN p - shown ELSE 0 END)::BIGINT AS skipped, round(avg(greatest(-10, least(10, shown - word))), 6) AS mean_offset FROM f GROUP BY user_id)
SELECT a.user_id, ticks, coalesce(exact, 0) AS exact, coalesce(near, 0) AS near, coalesce(behind2, 0) AS behind2, coalesce(ahead2, 0) AS ahead2, coalesce(jerks, 0) AS jerks, coalesce(backs, 0) AS backs, coalesce(skipped, 0) AS skipped, mean_offset FROM a LEFT JOIN b ON a.user_id = b.user_id""")
def word_following(t):
    """Exact and near words, two or more behind or ahead, jerks (back, or over two forward, against the last word shown), words skipped, the mean clipped offset."""
    rows = words(t)
    shown = rows.filter("shown is not null").withColumn("p", F.lag("shown").over(by_time()))
    off, step = F.col("shown") - F.col("word"), F.col("shown") - F.col("p")
    scored = shown.groupBy("user_id").agg(
        F.count_if(off == 0).alias("exact"),
        F.count_if(F.abs(off) <= 1).alias("near"),
        F.count_if(off < -1).alias("behind2"),
        F.count_if(off > 1).alias("ahead2"),
        F.count_if((step < 0) | (step > 2)).alias("jerks"),
        F.count_if(step < 0).alias("backs"),
        F.sum(F.when(step > 0, step - 1).when(step < 0, -step).otherwise(0)).alias("skipped"),
        F.round(F.avg(F.greatest(F.lit(-10), F.least(F.lit(10), off))), 6).alias("mean_offset"),
    )
    names = ("exact", "near", "behind2", "ahead2", "jerks", "backs", "skipped")
    all_ = rows.groupBy("user_id").agg(F.count("*").alias("ticks"))
    return all_.join(scored, "user_id", "left").select("user_id", "ticks", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names], "mean_offset")


@query(f"""WITH {WORDS}, c AS (SELECT a.user_id, a.word, min(b.t) AS f, any_value(a.t) AS t0 FROM w a LEFT JOIN w b ON a.user_id = b.user_id AND b.t >= a.t - {HOUR} AND b.t < a.t + {3 * HOUR} AND b.shown >= a.word GROUP BY a.user_id, a.word)
SELECT user_id, word, coalesce(f - t0, {3 * HOUR}) AS entry FROM c""")
def word_entries(t):
    """Per word: the first tick from an hour before to three hours after it begins that shows it or a later one; three hours if none does."""
    rows = words(t)
    spans = rows.select("user_id", "word", F.col("t").alias("t0"), (F.col("t") - HOUR).alias("a"), (F.col("t") + 3 * HOUR).alias("b"))
    shown = rows.filter("shown is not null").select("user_id", "t", "shown")
    first = temporal.interval_join(shown, spans, KEYS, "t", "a", "b", 4 * HOUR).filter("shown >= word").groupBy("user_id", "word").agg(F.min("t").alias("_f"))
    return spans.join(first, ["user_id", "word"], "left").select("user_id", "word", F.coalesce(F.col("_f") - F.col("t0"), F.lit(3 * HOUR)).alias("entry"))


@query(f"""WITH {WORDS}, p AS (SELECT a.user_id, a.event_id, a.word, b.t, b.event_id AS o, greatest(-10, least(10, b.shown - a.word)) AS off, b.shown // 4 > a.word // 4 AS over FROM w a JOIN w b ON a.user_id = b.user_id AND b.t > a.t AND b.t <= a.t + {24 * HOUR} AND b.shown IS NOT NULL WHERE a.event_type = 'error')
SELECT event_id, count(*) AS ticks, round(avg(off), 6) AS mean, round(count(*) FILTER (off >= 2) / count(*), 6) AS ahead, round(count(*) FILTER (over) / count(*), 6) AS next_line, max(off) AS worst, arg_max(off, (t, o)) AS final FROM p GROUP BY event_id""")
def stop_scores(t):
    """For the day after each stop: mean clipped offset of what is shown, the share two or more ahead, the share already in a later line, the worst, and the last."""
    rows = words(t)
    spans = rows.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("stop"), F.col("word").alias("at"), (F.col("t") + 1).alias("a"), (F.col("t") + 24 * HOUR + 1).alias("b"))
    ticks = temporal.interval_join(rows.filter("shown is not null").select("user_id", "t", "event_id", "shown"), spans, KEYS, "t", "a", "b", 24 * HOUR)
    off = F.greatest(F.lit(-10), F.least(F.lit(10), F.col("shown") - F.col("at")))
    share = lambda c: F.round(F.count_if(c) / F.count("*"), 6)
    later = F.floor(F.col("shown") / 4) > F.floor(F.col("at") / 4)
    return ticks.withColumn("off", off).groupBy(F.col("stop").alias("event_id")).agg(F.count("*").alias("ticks"), F.round(F.avg("off"), 6).alias("mean"), share(F.col("off") >= 2).alias("ahead"), share(later).alias("next_line"), F.max("off").alias("worst"), F.max_by("off", F.struct("t", ticks["event_id"])).alias("final"))


@query(f"""WITH {STEPS}, sp AS (SELECT user_id, t AS a, t + {6 * HOUR} AS b FROM s WHERE event_type = 'purchase'),
x AS (SELECT DISTINCT s.event_id, s.user_id, s.piece, s.seg, s.line FROM s JOIN sp ON s.user_id = sp.user_id AND s.t >= a AND s.t < b + {HOUR})
SELECT user_id, count(*) AS ticks, count(*) FILTER (piece = 'own' AND seg = line) AS line FROM x GROUP BY user_id""")
def reciting_only(t):
    """Lines scored only inside spans of speech, each an hour longer than it was heard; a tick in two spans counts once."""
    rows = steps(t)
    spans = rows.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), (F.col("t") + 7 * HOUR).alias("b"))
    inside = temporal.interval_join(rows.select("user_id", "t", "event_id", "piece", "seg", "line"), spans, KEYS, "t", "a", "b", 7 * HOUR).dropDuplicates(["event_id"])
    return inside.groupBy("user_id").agg(F.count("*").alias("ticks"), F.count_if(own() & (F.col("seg") == F.col("line"))).alias("line"))


@query(f"""WITH {WORDS}, l AS (SELECT user_id, event_id, t, word FROM w WHERE event_type = 'click')
SELECT l.event_id, count(b.event_id) > 0 AS seen FROM l LEFT JOIN w b ON b.user_id = l.user_id AND b.shown = l.word AND abs(b.t - l.t) <= {3 * HOUR} GROUP BY l.event_id""")
def logged_words_seen(t):
    """Was the logged word shown within three hours before or after?"""
    rows = words(t)
    logged = rows.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("_e"), F.col("t").alias("_t"), F.col("word").alias("shown"))
    hits = logged.join(rows.filter("shown is not null").select("user_id", "shown", "t"), ["user_id", "shown"]).filter(F.abs(F.col("t") - F.col("_t")) <= 3 * HOUR).select("_e").distinct().withColumn("_hit", F.lit(True))
    return logged.join(hits, "_e", "left").select(F.col("_e").alias("event_id"), F.coalesce("_hit", F.lit(False)).alias("seen"))


@query(f"""WITH {STEPS}, g AS (SELECT *, list(line) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS before, lead(line, 3) OVER {W} AS soon FROM s)
SELECT user_id, count(*) AS ticks, count(*) FILTER (piece = 'own' AND (list_contains(before, seg) OR seg = soon)) AS ok FROM g GROUP BY user_id""")
def grace_score(t):
    """A shown line is right if it was true in the ten ticks before, is now, or will be in three."""
    w = by_time()
    rows = steps(t).withColumn("before", F.collect_list("line").over(w.rowsBetween(-10, 0))).withColumn("soon", F.lead("line", 3).over(w))
    ok = own() & (F.expr("array_contains(before, seg)") | (F.col("seg") == F.col("soon")))
    return rows.groupBy("user_id").agg(F.count("*").alias("ticks"), F.count_if(ok).alias("ok"))


@query(f"""WITH {STEPS}, f AS (SELECT user_id, min(t) AS t0, min(t) FILTER (piece = 'own' AND seg = line AND i >= 2) AS f FROM s GROUP BY user_id)
SELECT user_id, coalesce(round((f - t0) / {HOUR}, 6), 60.0) AS found_h FROM f""")
def found_first(t):
    """Hours from the first tick to the first right one after the second; 60 if never found."""
    found = F.min(F.when(own() & (F.col("seg") == F.col("line")) & (F.col("i") >= 2), F.col("t")))
    return steps(t).groupBy("user_id").agg(F.min("t").alias("a"), found.alias("f")).select("user_id", F.coalesce(F.round((F.col("f") - F.col("a")) / HOUR, 6), F.lit(60.0)).alias("found_h"))


@query(f"""WITH {STEPS}, m AS (SELECT *, piece = 'own' AND value >= 5 AS ok FROM s), x AS (SELECT *, coalesce(ok, false) AS good FROM m),
n AS (SELECT *, max(CASE WHEN NOT good THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lapse, seg // 8 AS text FROM x),
g AS (SELECT *, lag(t) OVER {W} AS pt, lag(text) OVER {W} AS ptext FROM n WHERE good),
r AS (SELECT *, sum(CASE WHEN pt IS NULL OR ptext <> text OR lapse - pt > {24 * HOUR} THEN 1 ELSE 0 END) OVER {W} AS run FROM g)
SELECT user_id, run::BIGINT AS run, any_value(text) AS text, min(t) AS first, max(t) AS last, round(avg(value), 6) AS confidence FROM r GROUP BY user_id, run HAVING max(t) - min(t) >= {6 * HOUR}""")
def locked_spans(t):
    """Runs with one text shown confidently. A lapse of up to a day is bridged if the same text comes back; another text ends the run at once."""
    good = F.coalesce((F.col("piece") == "own") & (F.col("value") >= 5), F.lit(False))
    w = by_time()
    rows = steps(t).withColumn("good", good).withColumn("text", F.expr("seg div 8"))
    rows = rows.withColumn("lapse", F.max(F.when(~F.col("good"), F.col("t"))).over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("good")
    breaks = F.lag("t").over(w).isNull() | (F.lag("text").over(w) != F.col("text")) | F.coalesce(F.col("lapse") - F.lag("t").over(w) > 24 * HOUR, F.lit(False))
    runs = temporal.islands(rows, KEYS, ORDER, breaks, "run").groupBy("user_id", "run").agg(F.first("text").alias("text"), F.min("t").alias("first"), F.max("t").alias("last"), F.round(F.avg("value"), 6).alias("confidence"))
    return runs.filter(F.col("last") - F.col("first") >= 6 * HOUR)


@query(f"""WITH {E}, l AS (SELECT *, t + (value * 60 * 60000000)::BIGINT // 100 AS z FROM e WHERE value > 1), p AS (SELECT *, lag(z) OVER {W} AS pz FROM l),
r AS (SELECT *, sum(CASE WHEN pz IS NULL OR t - pz > {24 * HOUR} OR t < pz - {HOUR // 2} THEN 1 ELSE 0 END) OVER {W} AS run FROM p),
u AS (SELECT user_id, run, min(t) AS a, arg_max(z, (t, event_id)) AS b FROM r GROUP BY user_id, run), v AS (SELECT user_id, run, b, unnest(range(a, greatest(a, b - {6 * HOUR}) + 1, {3 * HOUR})) AS s FROM u WHERE b - a >= {2 * HOUR}),
x AS (SELECT v.user_id, v.run, s, least(s + {6 * HOUR}, b) AS z FROM v)
SELECT x.user_id, s AS begin, x.z AS until, string_agg(event_type, ' ' ORDER BY r.t, r.event_id) AS text FROM x JOIN r ON r.user_id = x.user_id AND r.run = x.run AND (r.t + r.z) // 2 >= s AND (r.t + r.z) // 2 < x.z GROUP BY x.user_id, x.run, s, x.z""")
def training_windows(t):
    """Runs of good lines (gaps up to a day, overlaps up to half an hour), cut into six-hour windows every three hours with the words whose middle lies inside."""
    rows = events(t).filter("value > 1").withColumn("z", F.expr("t + cast(round(value * 3600000000) as bigint) div 100"))
    w = by_time()
    gap = F.col("t") - F.lag("z").over(w)
    rows = temporal.islands(rows, KEYS, ORDER, (gap > 24 * HOUR) | (gap < -(HOUR // 2)), "run").withColumn("m", F.expr("(t + z) div 2"))
    runs = rows.groupBy("user_id", "run").agg(F.min("t").alias("a"), F.max_by("z", F.struct("t", "event_id")).alias("b")).filter(F.col("b") - F.col("a") >= 2 * HOUR)
    begins = runs.withColumn("begin", F.explode(F.sequence("a", F.greatest(F.col("a"), F.col("b") - 6 * HOUR), F.lit(3 * HOUR).cast("long"))))
    windows = begins.withColumn("until", F.least(F.col("begin") + 6 * HOUR, F.col("b"))).select("user_id", "run", "begin", "until")
    inside = temporal.interval_join(rows.select("user_id", "run", "m", "t", "event_id", "event_type"), windows, ["user_id", "run"], "m", "begin", "until", 6 * HOUR)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))), lambda x: x.event_type), " ")
    return inside.groupBy("user_id", "run", "begin", "until").agg(text.alias("text")).drop("run")


@query(f"""WITH {E}, g AS (SELECT user_id, event_id, t, t - lag(t) OVER {W} AS gap FROM e), p AS (SELECT a.user_id, a.event_id, sum(greatest(0, least(a.t, b.t) - greatest(a.t - {24 * HOUR}, b.t - b.gap))) AS paused FROM g a JOIN g b ON a.user_id = b.user_id AND b.gap >= {4 * HOUR} AND b.t > a.t - {24 * HOUR} AND b.t <= a.t GROUP BY a.user_id, a.event_id)
SELECT g.event_id, coalesce(paused, 0)::BIGINT AS paused FROM g LEFT JOIN p ON g.event_id = p.event_id""")
def paused_time(t):
    """Of the last day before each event, how much lies in gaps of four hours or more."""
    rows = events(t).select("user_id", "event_id", "t", (F.col("t") - F.lag("t").over(by_time())).alias("gap"))
    pauses = rows.filter(F.col("gap") >= 4 * HOUR).select("user_id", F.col("t").alias("_z"), "gap")
    spans = rows.select("user_id", "event_id", F.col("t").alias("_t"), (F.col("t") - 24 * HOUR + 1).alias("a"), (F.col("t") + 1).alias("b"))
    inside = temporal.interval_join(pauses, spans, KEYS, "_z", "a", "b", 24 * HOUR)
    paused = inside.groupBy("event_id").agg(F.sum(F.col("_z") - F.greatest(F.col("_t") - 24 * HOUR, F.col("_z") - F.col("gap"))).alias("paused"))
    return rows.select("event_id").join(paused, "event_id", "left").select("event_id", F.coalesce("paused", F.lit(0).cast("long")).alias("paused"))


@query(f"""WITH {E}, s AS (SELECT user_id, t AS a, t + {8 * HOUR} AS b, event_id FROM e WHERE event_type IN ('click', 'view')), p AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, event_id) AS k FROM p), u AS (SELECT user_id, min(a) AS a, max(b) AS b FROM i GROUP BY user_id, k),
h AS (SELECT user_id, a, b, unnest(range(a // {6 * HOUR}, (b - 1) // {6 * HOUR} + 1)) AS hop FROM u) SELECT user_id, hop, sum(least(b, (hop + 1) * {6 * HOUR}) - greatest(a, hop * {6 * HOUR}))::BIGINT AS speech FROM h GROUP BY user_id, hop""")
def speech_per_hop(t):
    """How much of each six-hour hop lies in speech; spans that overlap are united first."""
    spans = events(t).filter("event_type in ('click', 'view')").select("user_id", F.col("t").alias("a"), (F.col("t") + 8 * HOUR).alias("b"), "event_id")
    w = temporal.window_of(KEYS, ["a", "event_id"])
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    joined = temporal.islands(spans.withColumn("_m", before), KEYS, ["a", "event_id"], F.col("_m").isNull() | (F.col("a") > F.col("_m")), "k").groupBy("user_id", "k").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    size = 6 * HOUR
    hops = joined.withColumn("hop", F.explode(F.sequence(F.floor(F.col("a") / size), F.floor((F.col("b") - 1) / size))))
    return hops.groupBy("user_id", "hop").agg(F.sum(F.least(F.col("b"), (F.col("hop") + 1) * size) - F.greatest(F.col("a"), F.col("hop") * size)).alias("speech"))


@query(f"""WITH {E}, a AS (SELECT user_id, t, event_id % 6 AS line FROM e WHERE event_type IN ('click', 'view', 'signup')), b AS (SELECT user_id, t, event_id % 5 AS line FROM e WHERE event_type IN ('purchase', 'error')),
s AS (SELECT user_id, least(min(t) FILTER (event_type IN ('click', 'view', 'signup')), min(t) FILTER (event_type IN ('purchase', 'error'))) AS lo, max(t) AS hi, count(*) FILTER (event_type IN ('click', 'view', 'signup')) AS na, count(*) FILTER (event_type IN ('purchase', 'error')) AS nb FROM e GROUP BY user_id),
k AS (SELECT user_id, unnest(range((ceil(lo / {6 * HOUR}) * {6 * HOUR})::BIGINT, hi + 1, {6 * HOUR})) AS t FROM s WHERE na > 0 AND nb > 0),
x AS (SELECT k.user_id, k.t, a.line AS la FROM k ASOF LEFT JOIN a ON k.user_id = a.user_id AND k.t >= a.t), y AS (SELECT x.*, b.line AS lb FROM x ASOF LEFT JOIN b ON x.user_id = b.user_id AND x.t >= b.t)
SELECT user_id, round(count(*) FILTER (la = lb) / count(*), 6) AS agreement FROM y GROUP BY user_id""")
def label_agreement(t):
    """Share of six-hour ticks at which two label sets of one recording name the same line."""
    e = events(t)
    first, second = F.col("event_type").isin("click", "view", "signup"), F.col("event_type").isin("purchase", "error")
    spans = e.groupBy("user_id").agg(F.least(F.min(F.when(first, F.col("t"))), F.min(F.when(second, F.col("t")))).alias("lo"), F.max("t").alias("hi"), F.count_if(first).alias("na"), F.count_if(second).alias("nb")).filter("na > 0 and nb > 0")
    grid = temporal.ticks(spans, "lo", "hi", 6 * HOUR, "t").select("user_id", "t")
    a = e.filter(first).select("user_id", "t", (F.col("event_id") % 6).alias("la"))
    b = e.filter(second).select("user_id", "t", (F.col("event_id") % 5).alias("lb"))
    both = temporal.asof_join(temporal.asof_join(grid, a, KEYS, "t", ["la"]), b, KEYS, "t", ["lb"])
    return both.groupBy("user_id").agg(F.round(F.count_if(F.col("la") == F.col("lb")) / F.count("*"), 6).alias("agreement"))


@query(f"""WITH {STEPS}, g AS (SELECT user_id % 40 AS reciter, count(*) AS n, count(*) FILTER (piece = 'own' AND seg = line) AS hit FROM s GROUP BY user_id % 40), k AS (SELECT *, row_number() OVER (ORDER BY reciter) - 1 AS r, count(*) OVER () AS groups FROM g),
d AS (SELECT b, ('0x' || substr(md5(b || '/' || j), 1, 8))::BIGINT % groups AS r FROM (SELECT DISTINCT groups FROM k), range(200) AS x(b), range(40) AS y(j) WHERE j < groups),
m AS (SELECT b, sum(hit) / sum(n) AS v FROM d JOIN k ON d.r = k.r GROUP BY b) SELECT round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.5), 6) AS middle, round(quantile_cont(v, 0.975), 6) AS high, count(*) AS draws FROM m""")
def bootstrap_interval(t):
    """A 95 % interval of the line accuracy: 200 draws of reciters with replacement, a draw being a hash of its number; groups, not steps, are drawn."""
    sums = steps(t).groupBy((F.col("user_id") % 40).alias("reciter")).agg(F.count("*").alias("n"), F.count_if(own() & (F.col("seg") == F.col("line"))).alias("hit"))
    # forty rows: one per reciter
    ranked = sums.withColumn("r", F.row_number().over(Window.orderBy("reciter")) - 1).withColumn("groups", F.count("*").over(Window.partitionBy()))
    draws = t.spark.range(200).select(F.col("id").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("j")).join(F.broadcast(ranked.select("groups").distinct()), F.col("j") < F.col("groups"))
    picked = F.conv(F.substring(F.md5(F.concat_ws("/", "b", "j").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("groups")
    means = draws.select("b", picked.alias("_r")).join(F.broadcast(ranked), F.col("_r") == F.col("r")).groupBy("b").agg((F.sum("hit") / F.sum("n")).alias("v"))
    q = lambda p: F.round(F.percentile("v", p), 6)
    return means.agg(q(0.025).alias("low"), q(0.5).alias("middle"), q(0.975).alias("high"), F.count("*").alias("draws"))


VERDICTS = f"""{STEPS}, v AS (SELECT user_id, line, min(t) AS t, sum(value) - 40 AS score, count(*) FILTER (piece IS NOT NULL) >= 3 AS heard, max(CASE WHEN seg = line THEN 1 ELSE 0 END) = 1 AS shown FROM s GROUP BY user_id, line),
g AS (SELECT *, sum(heard::INT) OVER w AS h, count(*) OVER w AS n FROM v WINDOW w AS (PARTITION BY user_id ORDER BY t, line ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)),
d AS (SELECT *, CASE WHEN score >= 4 THEN 'read' WHEN score <= CASE WHEN shown THEN -20 ELSE -4 END THEN 'omitted' ELSE 'unsure' END AS raw FROM g),
x AS (SELECT user_id, line, raw, CASE WHEN raw = 'omitted' AND h < 0.6 * n THEN 'gated' ELSE raw END AS verdict FROM d)"""


@query(f"WITH {VERDICTS} SELECT * FROM x")
def practice_verdicts(t):
    """A line counts as read from +4, as omitted from -4 (-20 if it was shown); an omission stands only if 60 % of the last four lines were heard."""
    lines = steps(t).groupBy("user_id", "line").agg(F.min("t").alias("t"), (F.sum("value") - 40).alias("score"), (F.count_if(F.col("piece").isNotNull()) >= 3).alias("heard"), F.max(F.coalesce(F.col("seg") == F.col("line"), F.lit(False))).alias("shown"))
    w = temporal.window_of(KEYS, ["t", "line"]).rowsBetween(-3, 0)
    raw = F.when(F.col("score") >= 4, "read").when(F.col("score") <= F.when(F.col("shown"), -20).otherwise(-4), "omitted").otherwise("unsure")
    rows = lines.withColumn("raw", raw).withColumn("share", F.avg(F.col("heard").cast("int")).over(w))
    return rows.select("user_id", "line", "raw", F.when((F.col("raw") == "omitted") & (F.col("share") < 0.6), "gated").otherwise(F.col("raw")).alias("verdict"))


@query(f"""WITH {VERDICTS}, c AS (SELECT user_id % 5 AS lane, count(*) FILTER (line % 7 = 0) AS skipped, count(*) FILTER (line % 7 = 0 AND verdict = 'omitted') AS caught, count(*) FILTER (line % 7 <> 0 AND verdict = 'omitted') AS false_marks, count(*) AS lines FROM x GROUP BY user_id % 5)
SELECT lane, skipped, caught, false_marks, round(caught / greatest(skipped, 1), 6) AS caught_share, round(600.0 * false_marks / lines, 6) AS false_per_600 FROM c""")
def practice_metrics(t):
    """Of the lines that were skipped (here: every seventh), how many the verdicts catch, and how many marks fall on lines that were read, per 600 lines."""
    skipped, marked = F.col("line") % 7 == 0, F.col("verdict") == "omitted"
    sums = practice_verdicts(t).groupBy((F.col("user_id") % 5).alias("lane")).agg(F.count_if(skipped).alias("skipped"), F.count_if(skipped & marked).alias("caught"), F.count_if(~skipped & marked).alias("false_marks"), F.count("*").alias("lines"))
    return sums.select("lane", "skipped", "caught", "false_marks", F.round(F.col("caught") / F.greatest(F.col("skipped"), F.lit(1)), 6).alias("caught_share"), F.round(600.0 * F.col("false_marks") / F.col("lines"), 6).alias("false_per_600"))


@query(f"""WITH {STEPS}, n AS (SELECT user_id, i, count(*) OVER (PARTITION BY user_id) AS n FROM s), p AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY md5(user_id || '/' || i)) AS r FROM n WHERE i + 10 <= n),
h AS (SELECT user_id, i, unnest([3, 5, 10]) AS horizon FROM p WHERE r <= 5) SELECT horizon, count(*) AS starts, count(*) FILTER (s.piece = 'own') AS found, round(count(*) FILTER (s.piece = 'own') / count(*), 6) AS share FROM h JOIN s ON s.user_id = h.user_id AND s.i = h.i + horizon - 1 GROUP BY horizon""")
def identification_horizons(t):
    """Listening from five moments of each recording, picked by hash: is the right text shown after 3, 5 and 10 steps?"""
    rows = steps(t)
    picked = rows.withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).filter("i + 10 <= n")
    order = F.md5(F.concat_ws("/", F.col("user_id").cast("string"), F.col("i").cast("string")).cast("binary"))
    starts = temporal.top_k(picked, KEYS, [order], 5, "_r").select("user_id", F.col("i").alias("_i"), F.explode(F.array(F.lit(3), F.lit(5), F.lit(10))).alias("horizon"))
    seen = starts.withColumn("i", (F.col("_i") + F.col("horizon") - 1).cast("int")).join(rows.select("user_id", "i", "piece"), ["user_id", "i"])
    return seen.groupBy("horizon").agg(F.count("*").alias("starts"), F.count_if(own()).alias("found"), F.round(F.count_if(own()) / F.count("*"), 6).alias("share"))


@query(f"""WITH {STEPS}, q AS (SELECT user_id, i, value AS quiet, sum((value < 5)::INT) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS paused, (floor((i + 1 + 1.2) / 1.5) - 1)::BIGINT AS k FROM s)
SELECT q.user_id, q.i::INT AS i, quiet, paused, s.value AS live FROM q LEFT JOIN s ON s.user_id = q.user_id AND s.i = q.k WHERE (q.i + 1) % 3 = 0""")
def quiet_series(t):
    """Every third window with its quiet, the pauses since the window before it, and the live value that is held when its result is shown (1.2 later, at a step of 1.5); null beyond the series."""
    rows = steps(t)
    paused = F.count_if(F.col("value") < 5).over(by_time().rowsBetween(-2, 0))
    used = rows.select("user_id", "i", F.col("value").alias("quiet"), paused.alias("paused")).filter("(i + 1) % 3 = 0").withColumn("_k", (F.floor((F.col("i") + 1 + 1.2) / 1.5) - 1).cast("int"))
    live = rows.select(F.col("user_id").alias("_u"), F.col("i").alias("_i"), F.col("value").alias("live"))
    return used.join(live, (F.col("user_id") == F.col("_u")) & (F.col("_k") == F.col("_i")), "left").select("user_id", "i", "quiet", "paused", "live")


@query(f"""WITH {E}, f AS (SELECT user_id, t // {72 * HOUR} AS span, event_type AS transcript, round(avg(value), 6) AS fit FROM e GROUP BY ALL), b AS (SELECT *, min(fit) OVER (PARTITION BY user_id, span) AS best FROM f)
SELECT user_id, span, arg_min(transcript, (fit, transcript)) AS chosen, string_agg(transcript, '+' ORDER BY transcript) FILTER (fit <= 1.2 * best) AS gates FROM b GROUP BY user_id, span""")
def transcript_choice(t):
    """Of several transcripts of one span the one that fits best, and all that fit nearly as well, joined by a plus."""
    fits = events(t).groupBy("user_id", F.expr(f"t div {72 * HOUR}").alias("span"), F.col("event_type").alias("transcript")).agg(F.round(F.avg("value"), 6).alias("fit"))
    near = fits.withColumn("_best", F.min("fit").over(Window.partitionBy("user_id", "span")))
    gates = F.array_join(F.array_sort(F.collect_list(F.when(F.col("fit") <= 1.2 * F.col("_best"), F.col("transcript")))), "+")
    return near.groupBy("user_id", "span").agg(F.min_by("transcript", F.struct("fit", "transcript")).alias("chosen"), gates.alias("gates"))


@query(f"""WITH {E}, q AS (SELECT user_id, event_id, t, last_value(CASE WHEN value >= 10 THEN t END IGNORE NULLS) OVER {W} AS snd FROM e) SELECT event_id, CASE WHEN snd IS NULL THEN NULL ELSE t - snd END AS quiet FROM q""")
def quiet_time(t):
    """Since when there was no sound (a value of ten or more), at each event; null before the first."""
    sound = F.last(F.when(F.col("value") >= 10, F.col("t")), ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return events(t).select("event_id", (F.col("t") - sound).alias("quiet"))


@query(f"""WITH {E}, f AS (SELECT user_id, event_id, t FROM e), x AS (SELECT a.user_id, a.t AS z, b.event_id FROM e a JOIN f b ON a.user_id = b.user_id AND b.t > a.t - {24 * HOUR} AND b.t <= a.t - {4 * HOUR} WHERE a.event_type IN ('click', 'view'))
SELECT event_id, min(z) AS committed_at FROM x GROUP BY event_id""")
def committed_frames(t):
    """Windows of a day overlap; a frame is committed by the first window that ends at least four hours (the lookahead) after it and still covers it."""
    e = events(t)
    windows = e.filter("event_type in ('click', 'view')").select("user_id", F.col("t").alias("z"), (F.col("t") - 24 * HOUR + 1).alias("a"), (F.col("t") - 4 * HOUR + 1).alias("b"))
    return temporal.interval_join(e.select("user_id", "event_id", "t"), windows, KEYS, "t", "a", "b", 20 * HOUR).groupBy("event_id").agg(F.min("z").alias("committed_at"))


@query(f"""WITH {E}, h AS (SELECT user_id % 50 AS room, t, event_id, user_id AS host, value FROM e WHERE event_type = 'click'), v AS (SELECT user_id % 50 AS room, t, event_id FROM e WHERE event_type = 'signup'),
x AS (SELECT v.event_id AS viewer, h.host, h.value AS shown, row_number() OVER (PARTITION BY v.event_id ORDER BY h.t DESC, h.event_id DESC) AS n FROM v LEFT JOIN h ON h.room = v.room AND h.t <= v.t)
SELECT viewer, host, shown FROM x WHERE n = 1""")
def room_replay(t):
    """A viewer who joins a room gets the last thing its latest host sent."""
    e = events(t).withColumn("room", F.col("user_id") % 50)
    sent = e.filter("event_type = 'click'").select("room", "t", F.col("event_id").alias("_e"), F.col("user_id").alias("host"), F.col("value").alias("shown"))
    joins = e.filter("event_type = 'signup'").select("room", "t", F.col("event_id").alias("viewer"))
    return temporal.asof_join(joins, sent, ["room"], "t", ["_e", "host", "shown"]).select("viewer", "host", "shown")


@query(f"""WITH {STEPS}, a AS (SELECT event_type AS scenario, count(*) AS ticks, count(*) FILTER (piece = 'own' AND seg = line) AS hit, count(*) FILTER (piece <> 'own') AS wrong, count(*) FILTER (value >= 60) AS reading, count(*) FILTER (value >= 60 AND seg = line) AS reading_hit FROM s GROUP BY event_type)
SELECT scenario, ticks, round(hit / ticks, 6) AS on_line, round(wrong * 600.0 / ticks, 6) AS wrong_per_600, CASE WHEN reading > 0 THEN round(reading_hit / reading, 6) END AS reading_share FROM a""")
def scenario_rates(t):
    """Rates per 600 ticks and shares by scenario; a share of nothing is null, not a failure."""
    right = F.col("seg") == F.col("line")
    sums = steps(t).groupBy(F.col("event_type").alias("scenario")).agg(F.count("*").alias("ticks"), F.count_if(own() & right).alias("hit"), F.count_if(F.col("piece") != "own").alias("wrong"), F.count_if(F.col("value") >= 60).alias("r"), F.count_if((F.col("value") >= 60) & right).alias("rh"))
    return sums.select("scenario", "ticks", F.round(F.col("hit") / F.col("ticks"), 6).alias("on_line"), F.round(F.col("wrong") * 600.0 / F.col("ticks"), 6).alias("wrong_per_600"), F.when(F.col("r") > 0, F.round(F.col("rh") / F.col("r"), 6)).alias("reading_share"))


@query(f"""WITH {E}, b AS (SELECT event_type AS scenario, avg(value) FILTER (event_id % 2 = 0) AS base, avg(value) FILTER (event_id % 2 = 1) AS cand FROM e GROUP BY event_type)
SELECT scenario, round(base, 6) AS baseline, round(cand, 6) AS candidate, cand <= base * 1.05 AS ok FROM b WHERE base IS NOT NULL AND cand IS NOT NULL""")
def guard_against_baseline(t):
    """A candidate's metric beside the baseline's; it may be worse by five per cent. Scenarios that either lacks are left out."""
    side = lambda k: events(t).filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("scenario")).agg(F.avg("value").alias(f"v{k}"))
    return side(0).join(side(1), "scenario").select("scenario", F.round("v0", 6).alias("baseline"), F.round("v1", 6).alias("candidate"), (F.col("v1") <= F.col("v0") * 1.05).alias("ok"))


@query(f"""WITH {E}, g AS (SELECT user_id, event_id, lead(t) OVER {W} - t AS gap FROM e), q AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, event_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM g WHERE gap IS NOT NULL)
SELECT user_id, event_id FROM q WHERE r <= n // 4""")
def stop_votes(t):
    """The longest quarter of a recording's gaps: where it votes for a stop."""
    gaps = events(t).select("user_id", "event_id", (F.lead("t").over(by_time()) - F.col("t")).alias("gap")).filter("gap is not null")
    w = Window.partitionBy("user_id")
    ranked = gaps.withColumn("r", F.row_number().over(w.orderBy(F.desc("gap"), "event_id"))).withColumn("n", F.count("*").over(w))
    return ranked.filter("r <= n div 4").select("user_id", "event_id")


@query(f"""WITH {E}, p AS (SELECT user_id, event_id, t, sum((value * 1000)::BIGINT) OVER {W} AS z, (value * 1000)::BIGINT AS d FROM e) SELECT user_id, event_id, round((z - d) / 1.25, 3) AS begin, round(z / 1.25, 3) AS until FROM p""")
def program_times(t):
    """Spans put one after the other: where each begins and ends in output time, at a tempo of 1.25."""
    d = F.round(F.col("value") * 1000).cast("long")
    z = F.sum(d).over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    return events(t).select("user_id", "event_id", F.round((z - d) / 1.25, 3).alias("begin"), F.round(z / 1.25, 3).alias("until"))


@query(f"""WITH {E}, v AS (SELECT user_id, t, t + (value * 1000000)::BIGINT AS z FROM e WHERE value >= 20), a AS (SELECT user_id, count(*) AS n, min(t) AS t0, max(t) AS t1, arg_min(z, (t, z)) AS z0, arg_max(z, (t, z)) AS z1 FROM v GROUP BY user_id)
SELECT user_id, round((z1 - z0) / (t1 - t0), 9) AS ratio FROM a WHERE n > 3 AND t1 > t0""")
def clock_ratio(t):
    """How fast one clock runs against the other, from the first and the last of more than three visible events."""
    rows = events(t).filter("value >= 20").withColumn("z", F.col("t") + F.round(F.col("value") * 1000000).cast("long"))
    ends = rows.groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.struct("t", "z")).alias("a"), F.max(F.struct("t", "z")).alias("b")).filter("n > 3 and b.t > a.t")
    return ends.select("user_id", F.round((F.col("b.z") - F.col("a.z")) / (F.col("b.t") - F.col("a.t")), 9).alias("ratio"))


@query(f"""WITH {STEPS}, m AS (SELECT user_id, line, min(t) AS a, max(t) - min(t) AS d FROM s GROUP BY user_id, line), x AS (SELECT user_id, quantile_cont(d, 0.5) AS mid FROM m GROUP BY user_id)
SELECT m.user_id, line, d AS length, a - lag(a + d) OVER (PARTITION BY m.user_id ORDER BY line) AS gap, d > 3 * mid AS stretched FROM m JOIN x ON m.user_id = x.user_id""")
def review_candidates(t):
    """Lines with their length, the gap before them, and whether they last over three times their recording's median."""
    lines = steps(t).groupBy("user_id", "line").agg(F.min("t").alias("a"), (F.max("t") - F.min("t")).alias("length"))
    middle = lines.groupBy("user_id").agg(F.percentile("length", 0.5).alias("mid"))
    w = temporal.window_of(KEYS, ["line"])
    return lines.join(middle, "user_id").select("user_id", "line", "length", (F.col("a") - F.lag(F.col("a") + F.col("length")).over(w)).alias("gap"), (F.col("length") > 3 * F.col("mid")).alias("stretched"))


@query(f"""WITH {E}, l AS (SELECT user_id, event_type AS lang, t, event_id, sum(ln(1 + value)) OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS score FROM e WHERE event_id % 2 = 0),
x AS (SELECT user_id, lang, h, max(score) AS score FROM l, (VALUES (24), (72), (240)) v(h), (SELECT user_id AS u, min(t) AS t0 FROM e GROUP BY user_id) WHERE u = user_id AND t <= t0 + h * {HOUR} GROUP BY user_id, lang, h)
SELECT user_id, h::INT AS horizon, arg_max(lang, (round(score, 6), lang)) AS lang FROM x GROUP BY user_id, h""")
def language_over_horizons(t):
    """The language with the largest summed log-score within 24, 72 and 240 hours of the start."""
    e = events(t)
    begin = e.groupBy("user_id").agg(F.min("t").alias("t0"))
    rows = e.filter("event_id % 2 = 0").join(begin, "user_id").withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (24, 72, 240)]))).filter(F.col("t") <= F.col("t0") + F.col("horizon") * HOUR)
    sums = rows.groupBy("user_id", "horizon", F.col("event_type").alias("lang")).agg(F.round(F.sum(F.log1p("value")), 6).alias("score"))
    return sums.groupBy("user_id", "horizon").agg(F.max_by("lang", F.struct("score", "lang")).alias("lang"))


@query(f"""WITH {E}, sp AS (SELECT event_id AS span, user_id, t AS a, t + {48 * HOUR} AS b FROM e WHERE event_type = 'signup') SELECT span, e.event_id, e.t - a AS at FROM sp JOIN e ON e.user_id = sp.user_id AND e.t >= a AND e.t < b""")
def rebased_spans(t):
    """The events of a two-day span on the span's own clock."""
    e = events(t)
    spans = e.filter("event_type = 'signup'").select(F.col("event_id").alias("span"), "user_id", F.col("t").alias("a"), (F.col("t") + 48 * HOUR).alias("b"))
    return temporal.interval_join(e.select("user_id", "event_id", "t"), spans, KEYS, "t", "a", "b", 48 * HOUR).select("span", "event_id", (F.col("t") - F.col("a")).alias("at"))


@query(f"""WITH {WORDS}, ev AS (SELECT user_id, word, min(t) AS heard FROM w WHERE event_type <> 'error' GROUP BY user_id, word), rc AS (SELECT a.user_id, a.word, a.heard, min(b.t) AS reached FROM ev a LEFT JOIN w b ON a.user_id = b.user_id AND b.shown >= a.word AND b.t >= a.heard - {24 * HOUR} AND b.t < a.heard + {72 * HOUR} GROUP BY ALL)
SELECT user_id, word, reached - heard AS gap FROM rc""")
def evidence_gaps(t):
    """Per word: from when there is evidence for it to when the display first reaches it, looked for from a day before to three days after; null if it does not."""
    rows = words(t)
    heard = rows.filter("event_type <> 'error'").groupBy("user_id", "word").agg(F.min("t").alias("heard"))
    spans = heard.select("*", (F.col("heard") - 24 * HOUR).alias("a"), (F.col("heard") + 72 * HOUR).alias("b"))
    first = temporal.interval_join(rows.filter("shown is not null").select("user_id", "t", "shown"), spans, KEYS, "t", "a", "b", 96 * HOUR).filter("shown >= word").groupBy("user_id", "word").agg(F.min("t").alias("_r"))
    return heard.join(first, ["user_id", "word"], "left").select("user_id", "word", (F.col("_r") - F.col("heard")).alias("gap"))
