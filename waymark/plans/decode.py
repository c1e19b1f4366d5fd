"""Queries that decode sequences: alignment, following, paths, line breaks, agreement. Their kernels are tested against brute force."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import text as X
from waymark.operators import kernels, tracker
from waymark.plans.registry import query
from waymark.plans.texts import locate_passage


def _letters(text):
    """Letters of normalised text as numbers, spaces dropped."""
    kept = F.filter(F.split(X.normalize_latin(text), ""), lambda c: (c != " ") & (c != ""))
    return F.transform(kept, lambda c: F.ascii(c))


@F.pandas_udf(T.StructType([T.StructField(c, T.IntegerType()) for c in ("first", "last", "cost")]))
def snap(fragment: pd.Series, text: pd.Series) -> pd.DataFrame:
    found = [kernels.best_span(np.asarray(a, np.int64), np.asarray(b, np.int64)) or (None,) * 3 for a, b in zip(fragment, text, strict=True)]
    return pd.DataFrame(found, columns=["first", "last", "cost"]).astype("Int32")


@query()
def snap_passages(t):
    """Where in the located document each passage lies, letter by letter, and its edits."""
    best = locate_passage(t).select("item_id", "doc_id")
    pairs = best.join(t.benchmark.select("item_id", _letters(F.col("text")).alias("a")), "item_id").join(t.documents.select("doc_id", _letters(F.col("text")).alias("b")), "doc_id")
    return pairs.select("item_id", "doc_id", snap("a", "b").alias("s")).select("item_id", "doc_id", "s.*")


@query()
def follow_passages(t):
    """The tracker over the benchmark passages as corpus; each passage is recited as windows of five words, one a second."""
    texts = t.benchmark.select("item_id", X.normalize_latin(F.col("text")).alias("x"))
    tracker.check_size(texts.agg(F.sum(F.length(F.translate("x", " ", "")))).first()[0] or 0)
    rows = texts.orderBy("item_id").collect()
    index = tracker.Index([str(r.item_id) for r in rows], [[(1, r.x)] for r in rows])
    ws = X.words(X.normalize_latin(F.col("text")))
    windows = t.benchmark.select(F.col("item_id").cast("string").alias("rec"), F.posexplode(ws).alias("i", "_w"), ws.alias("ws"))
    windows = windows.select("rec", (F.col("i") + 1).cast("double").alias("t"), F.expr("array_join(slice(ws, greatest(i - 3, 1), least(i + 1, 5)), ' ')").alias("fragment"))
    return tracker.follow(windows, index).select("rec", "t", "text", "line", "word", F.round("confidence", 6).alias("confidence"))


@query("""WITH RECURSIVE st AS (SELECT user_id, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n,
 list_transform(['click', 'error', 'purchase', 'signup', 'view'], lambda k: CASE WHEN k = event_type THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END) AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
a AS (SELECT user_id, i, c AS v FROM st WHERE i = n UNION ALL SELECT st.user_id, st.i, list_transform(range(1, 6), lambda k: st.c[k] + least(a.v[k], list_min(a.v) + 1.5)) FROM a JOIN st ON st.user_id = a.user_id AND st.i = a.i - 1),
p AS (SELECT user_id, i, list_position(v, list_min(v)) AS s FROM a WHERE i = 1 UNION ALL SELECT a.user_id, a.i, CASE WHEN a.v[p.s] > list_min(a.v) + 1.5 THEN list_position(a.v, list_min(a.v)) ELSE p.s END FROM p JOIN a ON a.user_id = p.user_id AND a.i = p.i + 1)
SELECT p.user_id, event_id, ['click', 'error', 'purchase', 'signup', 'view'][s] AS state FROM p JOIN st ON st.user_id = p.user_id AND st.i = p.i""")
def switching_states(t):
    """The cheapest state path of each user when each change of state costs something."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        kinds = ("click", "error", "purchase", "signup", "view")
        costs = np.array([[0.0 if k == e else 1.0 for k in kinds] for e in pdf["event_type"]])
        path = kernels.switching_path(costs, 1.5)
        return pd.DataFrame({"user_id": pdf["user_id"].to_numpy(), "event_id": pdf["event_id"].to_numpy(), "state": [kinds[i] for i in path]})

    return t.events.select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandas(one, "user_id long, event_id long, state string")


@query("""WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM benchmark),
d AS (SELECT item_id, ws, 0 AS j, [0.0::DOUBLE] AS best, [-1] AS src FROM w
 UNION ALL SELECT item_id, ws, j + 1, list_append(best, pick.t), list_append(src, j + 1 - pick.l) FROM (SELECT *, list_min(list_filter(list_transform(range(1, least(11, j + 1) + 1), lambda l: {'t': best[j + 2 - l] + (l - 7) * (l - 7) + CASE WHEN ends_with(ws[j + 1], '.') THEN 0 WHEN ends_with(ws[j + 1], ',') THEN 2 ELSE 8 END, 'l': l}),
   lambda x: x.t IS NOT NULL AND (x.l >= 3 OR j + 1 = len(ws)))) AS pick FROM d WHERE j < len(ws))),
e AS (SELECT item_id, src, len(ws) AS last FROM d WHERE j = len(ws) AND len(ws) > 0 UNION ALL SELECT item_id, src, src[last + 1] FROM e WHERE src[last + 1] > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY last) - 1)::INT AS line, last::INT AS last FROM e""")
def cut_lines(t):
    """Passages cut into lines of 3 to 11 words, near seven, by dynamic programming; sentence ends are good breaks."""

    @F.pandas_udf("array<int>")
    def cut(text: pd.Series) -> pd.Series:
        def one(x: str) -> list[int]:
            ws = x.split()
            return kernels.best_breaks(len(ws), lambda a, b: (b - a - 7) ** 2 + (0 if ws[b - 1].endswith(".") else 2 if ws[b - 1].endswith(",") else 8), 3, 11)

        return text.map(one)

    return t.benchmark.select("item_id", F.posexplode(cut("text")).alias("line", "last"))


@query("""WITH RECURSIVE h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r, list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g')) AS ws FROM conversations),
s AS (SELECT conv_id, 0::BIGINT AS r, NULL::BIGINT AS turn, 0::BIGINT AS past, []::VARCHAR[] AS tail, []::VARCHAR[] AS expected, 0::BIGINT AS n FROM (SELECT DISTINCT conv_id FROM h)
 UNION ALL SELECT conv_id, r, turn, CASE WHEN n > 0 THEN past + m + n ELSE past END, list_concat(tail, fresh[1:n])[-4:], fresh[n + 1:], n FROM
 (SELECT *, coalesce(list_position(list_transform(range(1, least(len(fresh), len(expected)) + 1), lambda i: fresh[i] = expected[i]), false) - 1, least(len(fresh), len(expected)))::BIGINT AS n FROM
  (SELECT conv_id, r, turn, past, tail, expected, m, new[m + 1:] AS fresh FROM
   (SELECT *, coalesce(list_max(list_filter(range(1, least(4, len(new), len(tail)) + 1), lambda k: new[1:k] = tail[len(tail) - k + 1:])), 0) AS m FROM
    (SELECT s.conv_id, h.r, h.turn, s.past, s.tail, s.expected, h.ws[s.past + 1:] AS new FROM s JOIN h ON h.conv_id = s.conv_id AND h.r = s.r + 1)))))
SELECT conv_id, turn, n::INT AS committed FROM s WHERE r > 0""")
def agreed_words(t):
    """LocalAgreement over the turns of a conversation taken as successive hypotheses."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("turn")
        hypotheses = [[(float(i), i + 0.9, w) for i, w in enumerate(str(x).lower().split())] for x in pdf["text"]]
        out = kernels.local_agreement(hypotheses, key=lambda w: "".join(c for c in w if c.isalnum()))
        return pd.DataFrame({"conv_id": pdf["conv_id"].to_numpy(), "turn": pdf["turn"].to_numpy(), "committed": [len(x) for x in out]})

    return t.conversations.select("conv_id", "turn", "text").groupBy("conv_id").applyInPandas(one, "conv_id long, turn long, committed int")
