"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

from waymark.llm import mixing, urlrules, warc

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
u AS (SELECT r, w[i] AS x, CASE WHEN i > 1 THEN w[i-1] END AS p, CASE WHEN i > 2 THEN w[i-2] END AS q FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT x, count(*) AS n FROM u GROUP BY x), c2 AS (SELECT p, x, count(*) AS n FROM u WHERE p IS NOT NULL GROUP BY p, x), c3 AS (SELECT q, p, x, count(*) AS n FROM u WHERE q IS NOT NULL GROUP BY q, p, x),
t AS (SELECT count(*) AS n FROM u),
s AS (SELECT r, CASE WHEN c3.n >= 2 THEN ln(c3.n / c.n) ELSE CASE WHEN u.q IS NULL THEN 0 ELSE ln(0.4) END +
         CASE WHEN u.p IS NULL THEN ln(c1.n / t.n) WHEN c2.n >= 2 THEN ln(c2.n / b.n) ELSE ln(0.4) + ln(c1.n / t.n) END END AS v,
         (coalesce(c3.n, c2.n) < 2)::INT AS b
      FROM u JOIN c1 ON u.x = c1.x LEFT JOIN c2 ON u.p = c2.p AND u.x = c2.x LEFT JOIN c1 b ON u.p = b.x
      LEFT JOIN c3 ON u.q = c3.q AND u.p = c3.p AND u.x = c3.x LEFT JOIN c2 c ON u.q = c.p AND u.p = c.x, t),
g AS (SELECT r, sum(v) AS v, coalesce(sum(b), 0) AS b, count(*) AS n FROM s GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backoffs, round(coalesce(v, 0), 6) AS log_score, round(v / n, 6) AS mean_log_score FROM d LEFT JOIN g ON d.r = g.r
"""

OP3 = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), {A_Z}) AS x FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, doc_id = max(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256 FROM t
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {A_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[s:s+3], ' ') END AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS s FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * o >= 85 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""

OP9 = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s+12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) > 12)),
o AS (SELECT k, min(doc_id) AS o FROM g GROUP BY k HAVING min(doc_id) < max(doc_id)),
c AS (SELECT DISTINCT doc_id, s + j AS i FROM (SELECT doc_id, s, unnest(range(13)) AS j FROM g JOIN o ON g.k = o.k AND o.o < g.doc_id)),
u AS (SELECT d.doc_id, u.i, w[u.i] AS x, c.i IS NULL AS kept FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i FROM d) u JOIN d ON d.doc_id = u.doc_id LEFT JOIN c ON c.doc_id = u.doc_id AND c.i = u.i),
a AS (SELECT doc_id, count(*) FILTER (NOT kept) AS gone, string_agg(x, ' ' ORDER BY i) FILTER (kept) AS t FROM u GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""


def _bucket(v: str) -> str:
    shift = f"greatest(length(bin({v})) - 5, 0)"
    return f"({shift} * 16 + ({v} >> {shift}))"


def _op10() -> str:
    from waymark.llm.quality import METRICS, MIN_GROUP, sketched, wanted_quantiles

    div = {m: e.replace(" div ", " // ") for m, e in sketched().items()}
    union = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {_bucket(f'({x})::BIGINT')} AS b FROM ok" for m, x in div.items())
    wanted = wanted_quantiles()
    top = "CASE WHEN x < 32 THEN x ELSE ((x - 16 * (x // 16 - 1) + 1) << (x // 16 - 1)::BIGINT) - 1 END"

    def level(name: str, keys: str) -> str:
        part = f"PARTITION BY {keys}metric"
        picks = ", ".join(f"min(b) FILTER (metric = '{m}' AND upto * 100 >= total * {q}) AS {m}_{q}" for m, q in wanted)
        tops = ", ".join(f"{top.replace('x', f'{m}_{q}')} AS {m}_{q}" for m, q in wanted)
        by = f"GROUP BY {keys[:-2]}" if keys else ""
        return f"""{name} AS (SELECT {keys}total, {tops} FROM (SELECT {keys}max(total) AS total, {picks} FROM (SELECT {keys}metric, b, sum(n) OVER ({part} ORDER BY b) AS upto, sum(n) OVER ({part}) AS total
 FROM (SELECT {keys}metric, b, sum(n) AS n FROM sk GROUP BY {keys}metric, b)) {by}))"""

    chosen = ", ".join(f"CASE WHEN p.total >= {MIN_GROUP} THEN p.{m}_{q} WHEN l.total >= {MIN_GROUP} THEN l.{m}_{q} ELSE a.{m}_{q} END AS {m}_{q}" for m, q in wanted)
    bad = []
    for m, (_, low, high, reach, unit) in METRICS.items():
        least = unit.replace(" div ", " // ")
        if high is not None:
            bad.append(f"({div[m]}) > {m}_50 + {reach} * greatest({m}_{high} - {m}_50, {least})")
        if low is not None:
            bad.append(f"({div[m]}) < {m}_50 - {reach} * greatest({m}_50 - {m}_{low}, {least})")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
ln AS (SELECT r, x, count(*) AS c FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r, x),
ld AS (SELECT r, sum(c - 1) AS n_dup_lines, sum(c) AS n_lines FROM ln GROUP BY r),
g AS (SELECT r, s, count(*) OVER (PARTITION BY r, k) AS c FROM (SELECT r, s, array_to_string(w[s:s+7], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) > 7))),
rp AS (SELECT r, count(DISTINCT s + j) AS n FROM (SELECT r, s, unnest(range(8)) AS j FROM g WHERE c > 1) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(rp.n, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines FROM d LEFT JOIN ld ON d.r = ld.r LEFT JOIN rp ON d.r = rp.r),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
ok AS (SELECT * FROM f WHERE NOT base_failed),
sk AS (SELECT lang, source, metric, b, count(*) AS n FROM ({union}) GROUP BY ALL),
{level("p", "lang, source, ")}, {level("l", "lang, ")}, {level("a", "")},
q AS (SELECT p.lang, p.source, {chosen} FROM p JOIN l ON p.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN base_failed THEN false ELSE NOT ({" OR ".join(bad)}) END AS kept
FROM f LEFT JOIN q ON f.lang IS NOT DISTINCT FROM q.lang AND f.source IS NOT DISTINCT FROM q.source
"""


ORACLES = {"op1_lm_scoring": OP1, "op2_mixing": mixing.ORACLE, "op3_exact_dedup": OP3, "op4_url_filters": urlrules.ORACLE, "op6_warc": warc.ORACLE, "op7_ngram_jaccard_join": OP7, "op9_substring_dedup": OP9, "op10_quality_rules": _op10()}
