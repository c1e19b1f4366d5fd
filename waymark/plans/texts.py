"""Queries over texts: lines, folds, grams, retrieval, near duplicates, splits, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import text as X
from waymark.operators import containment, dedup, temporal
from waymark.plans.registry import query

FOLD = "'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'"
NORM = f"trim(regexp_replace(translate(lower(%s), {FOLD}), '[^a-z]+', ' ', 'g'))"
LINES = f"""docs AS (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, lang, i - 1 AS line_id, ls[i] AS line FROM (SELECT doc_id, lang, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
lines AS (SELECT doc_id, lang, line_id, line, {NORM % 'line'} AS norm FROM raw)"""
WORDS = "words AS (SELECT doc_id, line_id, norm, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS ws FROM lines)"
LINE_GRAMS = "grams AS (SELECT DISTINCT doc_id, line_id, array_to_string(ws[s:s+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS s FROM words WHERE len(ws) > 4))"


def lines(t):
    rows = t.spread("documents", "doc_id", "lang", "text").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line_id", "line"))
    return rows.withColumn("norm", X.normalize_latin(F.col("line")))


def line_grams(t, n=5):
    ws = X.words(F.col("norm"))
    return lines(t).select("doc_id", "line_id", F.explode(F.array_distinct(X.word_grams(ws, n))).alias("g"))


def text_grams(t, n=5):
    """Distinct word n-grams of each document, inside its lines. They are made distinct in the row, so no shuffle is needed for that."""

    def of(line):
        return X.word_grams(X.words(X.normalize_latin(line)), n)

    grams = F.array_distinct(F.flatten(F.transform(F.split("text", "\n"), of)))
    return t.spread("documents", "doc_id", "text").select("doc_id", F.explode(grams).alias("g"))


def item_grams(t, n=5):
    return t.benchmark.select("item_id", F.explode(F.array_distinct(X.word_grams(X.words(X.normalize_latin(F.col("text"))), n))).alias("g"))


LOCATED = f"""{LINES}, {WORDS}, {LINE_GRAMS},
items AS (SELECT item_id, string_split({NORM % 'text'}, ' ') AS ws FROM benchmark),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[s:s+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS s FROM items WHERE len(ws) > 4)),
hits AS (SELECT item_id, doc_id, line_id, count(*) AS shared FROM ig JOIN grams USING (g) GROUP BY ALL),
found AS (SELECT item_id, doc_id, line_id::INT AS line_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY shared DESC, doc_id, line_id) AS r FROM hits) WHERE r = 1)"""


@query(f"WITH {LOCATED} SELECT * FROM found")
def locate_passage(t):
    """Which document and line holds each passage: word 5-grams through an inverted index, the best line per passage."""
    hits = item_grams(t).join(line_grams(t), "g").groupBy("item_id", "doc_id", "line_id").agg(F.count("*").alias("shared"))
    return temporal.top_k(hits, ["item_id"], [F.desc("shared"), F.asc("doc_id"), F.asc("line_id")], 1).drop("rank")


@query(f"WITH {LINES} SELECT doc_id, line_id::INT AS line_id, norm, length(replace(norm, ' ', ''))::INT AS letters FROM lines")
def normalized_lines(t):
    return lines(t).select("doc_id", "line_id", "norm", F.length(F.translate("norm", " ", "")).alias("letters"))


@query(f"""WITH {LINES}, l AS (SELECT doc_id, line_id, replace(norm, ' ', '') AS x FROM lines),
g AS (SELECT doc_id, line_id, substr(x, s, 5) AS g FROM (SELECT *, unnest(range(1, length(x) - 3)) AS s FROM l WHERE length(x) > 4))
SELECT l.doc_id, l.line_id::INT AS line_id, count(DISTINCT g)::INT AS n FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line_id = g.line_id GROUP BY l.doc_id, l.line_id""")
def letter_grams(t):
    """Distinct letter 5-grams of each line, spaces dropped."""
    return lines(t).select("doc_id", "line_id", F.size(X.ngrams(F.translate("norm", " ", ""), 5)).alias("n"))


@query(f"""WITH {LINES}, {WORDS},
b AS (SELECT string_split({NORM % 'text'}, ' ') AS ws FROM benchmark),
held AS (SELECT DISTINCT array_to_string(ws[s:s+2], ' ') AS g FROM (SELECT ws, unnest(range(1, len(ws) - 1)) AS s FROM b)),
g AS (SELECT doc_id, array_to_string(ws[s:s+2], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 1)) AS s FROM words WHERE len(ws) > 2))
SELECT doc_id, count(*) AS n, count(*) FILTER (g IN (SELECT g FROM held)) AS held FROM g GROUP BY doc_id""")
def held_out_share(t):
    """Word trigrams of each document, with repeats, and how many of them some benchmark passage holds."""
    grams = lines(t).select("doc_id", F.explode(X.word_grams(X.words(F.col("norm")), 3)).alias("g"))
    held = t.benchmark.select(F.explode(X.word_grams(X.words(X.normalize_latin(F.col("text"))), 3)).alias("g")).distinct().withColumn("_held", F.lit(1))
    return grams.join(held, "g", "left").groupBy("doc_id").agg(F.count("*").alias("n"), F.count("_held").alias("held"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents")
def reference_hash(t):
    return t.documents.select("doc_id", X.text_hash(F.split("text", "\n")).alias("hash"))


@query(f"""WITH {LINES} SELECT doc_id, line_id::INT AS line_id, n AS times FROM
(SELECT doc_id, line_id, norm, count(*) OVER (PARTITION BY doc_id, norm) AS n FROM lines) WHERE n > 1 AND norm <> ''""")
def refrain_lines(t):
    rows = lines(t).filter("norm <> ''")
    return rows.withColumn("times", F.count("*").over(Window.partitionBy("doc_id", "norm"))).filter("times > 1").select("doc_id", "line_id", "times")


@query("""WITH o AS (SELECT doc_id, substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')[1:3], ' '), 1, 120) AS opening FROM documents)
SELECT opening, max(doc_id) AS doc_id, count(*) AS n FROM o GROUP BY opening""")
def known_openings(t):
    """Opening key of each text; of equal ones the last text stands."""
    keyed = t.documents.select("doc_id", X.opening(F.split("text", "\n")).alias("opening"))
    return keyed.groupBy("opening").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query(f"""WITH {LINES}, {WORDS}, p AS (SELECT doc_id, ws[s] AS a, ws[s+1] AS b FROM (SELECT *, unnest(range(1, len(ws))) AS s FROM words WHERE len(ws) > 1))
SELECT doc_id, count(*) AS pairs, count(*) FILTER (a = b OR (least(length(a), length(b)) >= 4 AND levenshtein(a, b) = 1)) AS same FROM p GROUP BY doc_id""")
def spelling_variants(t):
    """Neighbouring words that count as the same word."""
    ws = X.words(F.col("norm"))
    pairs = lines(t).select("doc_id", F.explode(F.when(F.size(ws) > 1, F.arrays_zip(F.slice(ws, F.lit(1), F.size(ws) - 1).alias("a"), F.slice(ws, F.lit(2), F.size(ws) - 1).alias("b")))).alias("p")).select("doc_id", "p.a", "p.b")
    return pairs.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.count_if(X.same_word(F.col("a"), F.col("b"))).alias("same"))


@query(f"""WITH {LINES}, c AS (SELECT doc_id, line_id, CASE WHEN length(line) >= 4 AND regexp_matches(line, '^[ -~]+$') THEN 'plain' WHEN length(line) >= 4 THEN 'marked' END AS k FROM lines),
f AS (SELECT *, CASE WHEN lag(k) OVER w IS DISTINCT FROM k OR line_id = 0 THEN 1 ELSE 0 END AS b FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)),
i AS (SELECT doc_id, line_id, k, sum(b) OVER (PARTITION BY doc_id ORDER BY line_id) AS i FROM f),
r AS (SELECT doc_id, k, min(line_id) AS first, count(*) AS n FROM i WHERE k IS NOT NULL GROUP BY doc_id, k, i)
SELECT doc_id, k AS script, first::INT AS first, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS x FROM r) WHERE x = 1""")
def longest_script_run(t):
    """The longest run of lines of one script in each document; the first at ties."""
    plain = F.col("line").rlike("^[ -~]+$")
    rows = lines(t).withColumn("script", F.when(F.length("line") >= 4, F.when(plain, "plain").otherwise("marked")))
    w = temporal.window_of(["doc_id"], ["line_id"])
    numbered = temporal.islands(rows, ["doc_id"], ["line_id"], F.lag("line_id").over(w).isNull() | ~F.col("script").eqNullSafe(F.lag("script").over(w)))
    found = numbered.filter("script is not null").groupBy("doc_id", "script", "island").agg(F.min("line_id").alias("first"), F.count("*").alias("n"))
    return temporal.top_k(found, ["doc_id"], [F.desc("n"), F.asc("first")], 1).drop("island", "rank")


@query(f"""WITH {LINES}, {WORDS}, g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s+7], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 6)) AS s FROM words WHERE len(ws) > 7))
SELECT g AS passage, count(*) AS texts FROM g GROUP BY g HAVING count(*) > 1""")
def shared_passages(t):
    """Eight-word passages that several texts hold."""
    return text_grams(t, 8).groupBy(F.col("g").alias("passage")).agg(F.count("*").alias("texts")).filter("texts > 1")


@query(f"""WITH {LINES}, {WORDS}, {LINE_GRAMS}, g AS (SELECT DISTINCT doc_id, g FROM grams), own AS (SELECT g FROM g GROUP BY g HAVING count(*) = 1),
l AS (SELECT DISTINCT doc_id, line_id FROM grams WHERE g IN (SELECT g FROM own))
SELECT doc_id, count(*) AS own_lines FROM l GROUP BY doc_id HAVING count(*) >= 3""")
def own_passages(t):
    """Texts with at least three lines that hold a passage of no other text."""
    grams = line_grams(t)
    own = text_grams(t).groupBy("g").agg(F.count("*").alias("_n")).filter("_n = 1").select("g")
    found = grams.join(own, "g", "left_semi").select("doc_id", "line_id").distinct()
    return found.groupBy("doc_id").agg(F.count("*").alias("own_lines")).filter("own_lines >= 3")


@query(f"""WITH {LINES}, {WORDS}, {LINE_GRAMS}, d AS (SELECT DISTINCT doc_id, g FROM grams), n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM d a JOIN d b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, shared FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE shared * 10 > 7 * least(x.n, y.n) AND least(x.n, y.n) * 10 > 6 * greatest(x.n, y.n)""")
def contained_texts(t):
    """Pairs of texts of similar size of which one holds most passages of the other."""
    return containment.contained_pairs(t.spread("documents", "doc_id", "text"), "doc_id", "text", X.fold_latin, 5, containment=0.7, size_ratio=0.6)


@query(f"""WITH {LINES}, {WORDS}, {LINE_GRAMS}, d AS (SELECT DISTINCT doc_id, g FROM grams), df AS (SELECT g, count(*) AS df FROM d GROUP BY g), n AS (SELECT count(*) AS n FROM documents),
items AS (SELECT item_id, string_split({NORM % 'text'}, ' ') AS ws FROM benchmark),
ig AS (SELECT DISTINCT item_id, array_to_string(ws[s:s+4], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 3)) AS s FROM items WHERE len(ws) > 4)),
s AS (SELECT item_id, doc_id, round(sum(ln(n / df)), 6) AS score FROM ig JOIN d USING (g) JOIN df USING (g), n GROUP BY item_id, doc_id)
SELECT item_id, doc_id, score, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s) WHERE r <= 3""")
def retrieve_texts(t):
    """The three best texts per passage by the idf sum of shared passages' 5-grams."""
    return dedup.retrieve(item_grams(t), text_grams(t), "item_id", "doc_id", "g", t.documents.count(), 3)


@query("""WITH e AS (SELECT doc_id, source, ('0x' || substr(sha1(source || '/' || doc_id), 1, 8))::BIGINT AS h FROM documents)
SELECT doc_id, CASE WHEN h % 2 = 0 THEN 'dev' ELSE 'test' END AS part, (h % 100 < 10) AS val FROM e""")
def hash_split(t):
    return dedup.hash_split(t.documents.select("doc_id", "source"), F.concat("source", F.lit("/"), "doc_id"))


@query("""WITH g AS (SELECT source, row_number() OVER (ORDER BY sha256(source)) AS r FROM (SELECT DISTINCT source FROM documents))
SELECT source, r::INT AS rank, CASE WHEN floor(r * 0.4) > floor((r - 1) * 0.4) THEN 'dev' ELSE 'final' END AS part FROM g""")
def frozen_split(t):
    """Groups in hash order; dev whenever its share would otherwise fall behind 0.4."""
    ranked = t.documents.select("source").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.sha2(F.col("source").cast("binary"), 256))))
    return ranked.withColumn("part", F.when(F.floor(F.col("rank") * 0.4) > F.floor((F.col("rank") - 1) * 0.4), "dev").otherwise("final"))


@query("""WITH r AS (SELECT d.doc_id, d.lang, n_chars, CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'toxic' WHEN l.quality = 0 THEN 'poor' WHEN n_chars < 200 THEN 'short' ELSE 'used' END AS reason
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT lang, reason, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM r GROUP BY lang, reason""")
def label_coverage(t):
    """Supplied, labelled and used text with the first reason that excludes each document."""
    rows = t.documents.join(t.labels.select(F.col("doc_id").alias("_l"), "quality", "toxic"), F.col("doc_id") == F.col("_l"), "left")
    reason = F.when(F.col("_l").isNull(), "unlabelled").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("n_chars") < 200, "short").otherwise("used")
    return rows.withColumn("reason", reason).groupBy("lang", "reason").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""SELECT doc_id, lang, source, r::INT AS turn FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY sha256(doc_id::VARCHAR)) AS r FROM documents) WHERE r <= 3""")
def stratified_sample(t):
    """Three documents per language and source, by hash order."""
    order = F.sha2(F.col("doc_id").cast("string").cast("binary"), 256)
    return temporal.top_k(t.documents.select("doc_id", "lang", "source"), ["lang", "source"], [order], 3, "turn")


@query("""SELECT doc_id, source, n_chars FROM (SELECT doc_id, source, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 20000""")
def capped_sources(t):
    """At most 20,000 characters per source, in hash order."""
    rows = t.documents.select("doc_id", "source", "n_chars")
    return temporal.cap(rows, ["source"], [F.sha2(F.col("doc_id").cast("string").cast("binary"), 256), F.col("doc_id")], "n_chars", 20000)


@query("""WITH r AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS turn FROM documents)
SELECT doc_id, lang, source, turn::INT AS turn, row_number() OVER (PARTITION BY lang ORDER BY turn, source)::INT AS place FROM r""")
def interleaved_plan(t):
    """Sources taken in turn within a language: longest documents first."""
    rows = t.documents.withColumn("_size", -F.col("n_chars"))
    turns = temporal.round_robin(rows, "lang", "source", ["_size", "doc_id"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "source"))
    return turns.select("doc_id", "lang", "source", "turn", place.alias("place"))


@query("""SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping(lang, source)::INT AS level FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())""")
def grid_rows(t):
    """Totals by group, by lane and over all in one pass (expand, then one aggregate)."""
    t.documents.createOrReplaceTempView("waymark_grid_documents")
    return t.spark.sql("SELECT lang, source, count(*) AS n, sum(n_chars) AS chars, cast(grouping_id(lang, source) AS int) AS level FROM waymark_grid_documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")


@query(f"""WITH {LOCATED}, p AS (SELECT lang, {NORM % 'b.text'} AS a, l.norm AS c FROM found f JOIN benchmark b ON b.item_id = f.item_id JOIN lines l ON l.doc_id = f.doc_id AND l.line_id = f.line_id)
SELECT lang, sum(levenshtein(a, c))::BIGINT AS edits, sum(length(a))::BIGINT AS letters, round(sum(levenshtein(a, c)) / sum(length(a)), 6) AS error_rate FROM p GROUP BY lang""")
def error_rate(t):
    """Character error rate of each passage's located line against the passage, whole texts; by language, edits and letters summed before any division."""
    reference = t.benchmark.select("item_id", X.normalize_latin(F.col("text")).alias("a"))
    pairs = locate_passage(t).join(reference, "item_id").join(lines(t).select("doc_id", "line_id", "lang", "norm"), ["doc_id", "line_id"])
    sums = pairs.groupBy("lang").agg(F.sum(F.levenshtein("a", "norm")).cast("long").alias("edits"), F.sum(F.length("a")).cast("long").alias("letters"))
    return sums.select("lang", "edits", "letters", F.round(F.col("edits") / F.col("letters"), 6).alias("error_rate"))


@query("""SELECT doc_id, to_json({'id': doc_id, 'lines': list_transform(string_split(text, chr(10)), lambda x, i: {'n': i, 'text': x})})::VARCHAR AS json FROM documents""")
def web_json(t):
    """Each text as one JSON document with numbered lines."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("text")))
    return t.documents.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("id"), numbered.alias("lines"))).alias("json"))


@query("""SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4""")
def same_voice(t):
    """Pairs of one label whose vectors' cosine reaches 0.4."""
    return dedup.cosine_pairs(t.embeddings, "vec_id", "embedding", "label", 0.4)


@query("""WITH RECURSIVE e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
r(v, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e.b, r.c FROM r JOIN e ON r.v = e.a) SELECT v AS vec_id, min(c) AS voice FROM r GROUP BY v""")
def voice_groups(t):
    """Connected components of the same-voice links."""
    links = dedup.cosine_links(t.embeddings, "vec_id", "embedding", "label", 0.4)
    found = dedup.groups_of(links, "a", "b")
    return t.embeddings.join(found, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.coalesce("group", "vec_id").alias("voice"))


@query("""WITH RECURSIVE p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4),
o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
k(r, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT k.r + 1, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.b = o.vec_id AND list_contains(k.kept, p.a)) THEN k.kept ELSE list_append(k.kept, o.vec_id) END FROM k JOIN o ON o.r = k.r + 1)
SELECT unnest(kept) AS vec_id FROM k WHERE r = (SELECT count(*) FROM embeddings)""")
def distinct_voices(t):
    """Greedy keep-first: in id order, a vector stays unless it is too near one that stayed."""
    return dedup.keep_first(t.embeddings, "vec_id", "embedding", "label", 0.4)


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '([0-9]+)(?:\\.html)?/?(?:[?#].*)?$', 1) AS tail FROM pages""")
def url_tails(t):
    return t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", r"([0-9]+)(?:\.html)?/?(?:[?#].*)?$", 1).alias("tail"))


@query(r"""WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), '(?i)</?(p|div|li|h1|article|nav|ul)[^>]*>|<br>', chr(10), 'g') AS x FROM pages),
l AS (SELECT page_id, trim(regexp_replace(regexp_replace(v, '<[^>]*>', '', 'g'), '[ \t\r]+', ' ', 'g')) AS line FROM (SELECT page_id, unnest(string_split(x, chr(10))) AS v FROM b))
SELECT page_id, count(*) AS blocks, sum(length(line))::BIGINT AS chars FROM l WHERE length(line) >= 20 GROUP BY page_id""")
def page_blocks(t):
    """Text blocks of a page: scripts, styles and comments go, block tags break lines, short blocks (menus) go."""
    rough = F.regexp_replace("html", r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", "")
    broken = F.regexp_replace(rough, r"(?i)</?(p|div|li|h1|article|nav|ul)[^>]*>|<br>", "\n")
    rows = t.pages.select("page_id", F.explode(F.split(broken, "\n")).alias("v"))
    line = F.trim(F.regexp_replace(F.regexp_replace("v", "<[^>]*>", ""), r"[ \t\r]+", " "))
    return rows.select("page_id", line.alias("line")).filter(F.length("line") >= 20).groupBy("page_id").agg(F.count("*").alias("blocks"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("""WITH o AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 3 <> 1), n AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' more' ELSE text END AS text FROM documents WHERE doc_id % 3 <> 2)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.text = n.text THEN 'same' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def version_diff(t):
    """Two versions of a corpus against each other."""
    old = t.documents.filter("doc_id % 3 <> 1").select(F.col("doc_id").alias("a"), F.sha2(F.col("text").cast("binary"), 256).alias("x"))
    new = t.documents.filter("doc_id % 3 <> 2").select(F.col("doc_id").alias("b"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" more"))).otherwise(F.col("text")).cast("binary"), 256).alias("y"))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("x") == F.col("y"), "same").otherwise("changed")
    return old.join(new, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias("doc_id"), change.alias("change"))


@query("""WITH e AS (SELECT n_nationkey + CASE WHEN n_nationkey > 20 THEN 100 ELSE 0 END AS k, CASE WHEN n_nationkey % 3 = 0 THEN n_name WHEN n_nationkey % 3 = 1 THEN 'stale' ELSE n_name || '!' END AS old, n_name || '!' AS new FROM nation)
SELECT k::INT AS k, CASE WHEN n.n_nationkey IS NULL THEN 'missing' WHEN n.n_name = new THEN 'already' WHEN n.n_name = old THEN 'applied' ELSE 'changed' END AS status FROM e LEFT JOIN nation n ON n.n_nationkey = k""")
def guarded_edits(t):
    """Edits that apply only if the old value is still there."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    edits = t.nation.select((k + F.when(k > 20, 100).otherwise(0)).alias("k"), F.when(k % 3 == 0, name).when(k % 3 == 1, "stale").otherwise(F.concat(name, F.lit("!"))).alias("old"), F.concat(name, F.lit("!")).alias("new"))
    return dedup.compare_and_set(t.nation, edits, "n_nationkey", "n_name").select("k", "status")
