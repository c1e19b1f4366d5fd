"""Queries over rules: folds and classifications of texts, captions, predicates with reasons, truth selection, holdouts, lookups.

Rules on scripts and captions that the driver's tables do not hold are shown on literal rows; their SQL gives the expected rows.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import captions
from waymark.functions import text as X
from waymark.operators import temporal
from waymark.plans.registry import query
from waymark.plans.texts import LINES, NORM, lines
from waymark.plans.times import HOUR, E, events


def literal(rows: dict[str, object]) -> str:
    """SQL rows (x, y) of expected values."""

    def show(v: object) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, list):
            return "[" + ", ".join(map(show, v)) + "]"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "SELECT * FROM (VALUES " + ", ".join(f"({show(x)}, {show(y)})" for x, y in rows.items()) + ") v(x, y)"


def applied(t, rows: dict[str, object], rule):
    return t.spark.createDataFrame([(x,) for x in rows], "x string").select("x", rule(F.col("x")).alias("y"))


MARKED = {"اَللّٰهُمَّ": "اللهم", "ٱلْحَمْدُ لِلّٰهِ": "ٱلحمد لله", "ـعـ": "ع", "سنة ١٢": "سنة ١٢", "plain": "plain", "": ""}


@query(f"SELECT x, regexp_replace(x, '[\\x{{064B}}-\\x{{065F}}\\x{{0670}}\\x{{06D6}}-\\x{{06ED}}\\x{{0640}}]', '', 'g') AS y FROM ({literal(MARKED)})")
def fold_marks(t):
    return applied(t, MARKED, X.strip_marks)


NORMAL = {"اَللّٰهُمَّ  إِنِّي": "اللهم اني", "ﷲ، الرحمة": "الله الرحمه", "ابجد١ابجد": "ابجد ابجد", "ہے ۓ کی": "هي ي كي", "مؤمن؛ مسئول": "مومن مسيول", "abc": "", "": ""}


@query(literal(NORMAL))
def fold_letters(t):
    return applied(t, NORMAL, X.normalize)


BARE = {"أَب جدٰة": "اب جده", "رؤوف، رئيس": "رووف رييس", "ٱلۡحَمۡد": "الحمد", "a ب  c": "ب", "": ""}


@query(literal(BARE))
def fold_bare(t):
    return applied(t, BARE, X.bare)


CODES = {"اب": [7, 8], "ءا ب": [1, 7, 8], "ي": [42], "": []}


@query(f"SELECT x, list_transform(list_filter(string_split(replace(x, ' ', ''), ''), lambda c: c <> ''), lambda c: (ord(c) - 1568)::TINYINT) AS y FROM ({literal(CODES)})")
def letter_codes(t):
    return applied(t, CODES, X.encode)


SPOKEN = {"یا ٱلله کریم": "يا الله كريم", "رَبِّ أنتِ،": "رب أنت"}


@query(literal(SPOKEN))
def transcript_spelling(t):
    return applied(t, SPOKEN, X.whisper_style)


SCRIPTS = {"hello there": "latin", "السلام عليكم": "arabic", "ab": None, "abcd ابجد": None, "salaam ab السلام عليكم ورحمة الله": None, "1234": None}


@query(f"""SELECT x, CASE WHEN a >= 4 AND a >= 3 * l THEN 'arabic' WHEN l >= 4 AND l >= 3 * a THEN 'latin' END AS y FROM
(SELECT x, len(regexp_extract_all(x, '[\\x{{0621}}-\\x{{064A}}]')) AS a, len(regexp_extract_all(x, '[A-Za-z]')) AS l FROM ({literal(SCRIPTS)}))""")
def line_scripts(t):
    return applied(t, SCRIPTS, X.script)


VOWELS = {"رَبِّ": True, "رب العالمين": False, "": True, "رَبَّنَا آتِنَا": True, "abc": True}


@query(literal(VOWELS))
def vowelled_texts(t):
    return applied(t, VOWELS, X.vowelled)


KEYS = {"قال و الله": ["قال", "والله"], "شي ء و ء": ["شيء", "وء"], "ء و و كل و": ["ء", "وو", "كل", "و"]}


@query(literal(KEYS))
def passage_words(t):
    return applied(t, KEYS, lambda c: X.passage_keys(X.words(c)))


AGENTS = {
    "Mozilla/5.0 (Windows NT 10.0) AppleWebKit Chrome/120.0 Safari/537 Edg/121.0": "Windows Edge 121",
    "Mozilla (iPhone; CPU like Mac OS X) Version/18.1 Safari": "iPhone Safari 18",
    "Mozilla (Linux; Android 14) SamsungBrowser/23.0 Chrome/115 Safari": "Android Samsung 23",
    "Mozilla (X11; Linux x86_64) Firefox/128.0": "Linux Firefox 128",
    "curl/8.0": "? curl/8.0",
    "": "(no browser named)",
}


@query(literal(AGENTS))
def short_agents(t):
    return applied(t, AGENTS, X.short_agent)


ERRORS = {"Sign in to confirm you're not a bot": "auth", "HTTP Error 429": "rate", "Private video": "gone", "This video is not available": "gone", "Try again later: unavailable": "rate", "timed out": "fail", "": "fail"}


@query(literal(ERRORS))
def error_kinds(t):
    """The first kind that fits decides: a rate limit that also says unavailable is a rate limit."""
    return applied(t, ERRORS, X.error_kind)


TITLES = {"the song (live at  home) - ": "The song", "two   words": "Two words", " - x:": "X", "": ""}


@query(literal(TITLES))
def clean_titles(t):
    return applied(t, TITLES, X.clean_title)


LOOPS = {"ab cd " * 30: True, " Thanks. ": True, "please subscribe now": True, "an ordinary short line": False, "": False}


@query(literal(LOOPS))
def hallucinated_texts(t):
    """Whole texts and parts that a model writes over silence, and loops, which compress too well."""
    return applied(t, LOOPS, lambda c: X.hallucinated(c, ["Thanks"], ["subscribe"]))


SRT = "1\r\n00:00:01,500 --> 00:00:03,000\r\n1. first\r\n\r\n2\n00:01:00.25 --> 01:00:00,000\n 12 . twelfth\nmore\n\n3\n00:00:09,000 --> 00:00:10,000\nno number\n"


@query("SELECT * FROM (VALUES (1.5::DOUBLE, 3.0::DOUBLE, 1), (60.25::DOUBLE, 3600.0::DOUBLE, 12)) v(start_s, end_s, line_id)")
def read_srt(t):
    return t.spark.createDataFrame([(SRT,)], "x string").select(F.inline(captions.srt_cues(F.col("x"))))


@query("SELECT '1' || chr(10) || '00:00:01,500 --> 00:01:00,250' || chr(10) || '1. one' || chr(10) || chr(10) || '2' || chr(10) || '00:01:00,250 --> 01:00:00,000' || chr(10) || '12. ' || chr(10) AS srt, TRUE AS same")
def write_srt(t):
    """Line times as SRT, and whether reading it gives them back."""
    rows = t.spark.createDataFrame([([(1.5, 1, "one"), (60.25, 12, None)], 3600.0)], "starts array<struct<start_s double, line_id int, text string>>, end_s double")
    written = rows.withColumn("srt", captions.to_srt(F.col("starts"), F.col("end_s")))
    back = F.transform(captions.srt_cues(F.col("srt")), lambda c: F.struct(c.start_s, c.line_id))
    return written.select("srt", (back == F.transform("starts", lambda c: F.struct(c.start_s, c.line_id))).alias("same"))


VTT = "WEBVTT\n\n00:01.500 --> 00:04.000 align:start\n<c>first</c>\nline\n\n01:00:00.000 --> 01:00:02.250\nsecond\n\n00:05.000 --> 00:06.000\n<b></b>\n\nno cue"


@query("SELECT * FROM (VALUES (1.5::DOUBLE, 4.0::DOUBLE, 'first line'), (3600.0::DOUBLE, 3602.25::DOUBLE, 'second')) v(start_s, end_s, text)")
def read_vtt(t):
    return t.spark.createDataFrame([(VTT,)], "x string").select(F.inline(captions.vtt_cues(F.col("x"))))


@query("""SELECT * FROM (VALUES (1, [0.5::DOUBLE, 2.0], [1, 2], 9.0::DOUBLE, 'x'), (2, [0.5::DOUBLE], [3], 10.0::DOUBLE, 'y')) v(id, begins, line, end_s, back)""")
def line_times(t):
    """Line times of a recording: a key past the last line marks the end of the labels; writing them gives the mark only where labels stop early."""
    rows = t.spark.createDataFrame([(1, {"2": 2000, "1": 500, "4": 9000}), (2, {"3": 500})], "id int, ms map<string, bigint>")
    n, length = F.lit(3), F.lit(10000).cast("long")
    rows = rows.select("id", "ms", captions.line_starts(F.col("ms"), n).alias("s"), captions.labels_end(F.col("ms"), n, length).alias("end_s"))
    again = captions.slide_map(F.col("s"), F.col("end_s"), n, length)
    kept = F.array_sort(F.map_keys(again)) == F.array_sort(F.map_keys("ms"))
    return rows.select("id", F.col("s.start_s").alias("begins"), F.col("s.line_id").alias("line"), "end_s", F.when(kept & (F.size("ms") > 1), "x").when(kept, "y").otherwise("?").alias("back"))


@query(f"""WITH {E}, r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN substr(props, 1, length(props) - 2) ELSE props END AS line FROM e)
SELECT event_id, json_extract_string(line, '$.k')::INT AS k FROM r WHERE json_valid(line)""")
def tolerant_json(t):
    """JSON lines of which some are cut off; those that do not parse are left out."""
    e = events(t).select("event_id", F.when(F.col("event_id") % 7 == 0, F.expr("substring(props, 1, length(props) - 2)")).otherwise(F.col("props")).alias("line"))
    return e.select("event_id", F.from_json("line", "k int, _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("j")).filter("j._bad is null and j.k is not null").select("event_id", "j.k")


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source END, ''), CASE WHEN doc_id % 2 = 0 THEN lang END) AS name FROM documents""")
def segment_defaults(t):
    """A field that is missing or empty takes the side file's value, which may be missing too."""
    given = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("source"))
    return t.documents.select("doc_id", F.coalesce(F.nullif(given, F.lit("")), F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("name"))


@query("""SELECT doc_id, CASE WHEN l.doc_id IS NOT NULL THEN 'have' WHEN d.doc_id % 17 = 0 THEN 'gone' WHEN source IN ('src1', 'src2') THEN 'excluded' WHEN contains(lower(text), 'http') THEN 'no recitation'
 WHEN n_chars < CASE lang WHEN 'en' THEN 300 ELSE 200 END OR n_chars > 20000 THEN 'length' WHEN NOT regexp_matches(text, '[aeiou]') THEN 'topic' END AS reason FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 0) l USING (doc_id)""")
def admission(t):
    """Why a candidate is not taken, the first reason that holds; null: it is taken."""
    have = t.labels.filter("quality = 0").select(F.col("doc_id").alias("_l")).distinct()
    rows = t.documents.join(have, F.col("doc_id") == F.col("_l"), "left")
    least = F.when(F.col("lang") == "en", 300).otherwise(200)
    reason = (
        F.when(F.col("_l").isNotNull(), "have")
        .when(F.col("doc_id") % 17 == 0, "gone")
        .when(F.col("source").isin("src1", "src2"), "excluded")
        .when(F.contains(F.lower("text"), F.lit("http")), "no recitation")
        .when((F.col("n_chars") < least) | (F.col("n_chars") > 20000), "length")
        .when(~F.col("text").rlike("[aeiou]"), "topic")
    )
    return rows.select("doc_id", reason.alias("reason"))


@query(r"""SELECT page_id, page_id % 50 = 0 OR regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) LIKE '%.org' OR regexp_extract(rtrim(url, '/'), '([^/]*)$', 1) IN (SELECT n_nationkey || '.html' FROM nation) AS held FROM pages""")
def held_out_uploads(t):
    """An upload is held out by its id, its channel, or the tail of its address."""
    tails = t.nation.select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".html")).alias("_tail")).distinct().withColumn("_hit", F.lit(True))
    rows = t.pages.withColumn("tail", F.regexp_extract(F.regexp_replace("url", "/+$", ""), "([^/]*)$", 1)).join(F.broadcast(tails), F.col("tail") == F.col("_tail"), "left")  # 25 rows
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    return rows.select("page_id", ((F.col("page_id") % 50 == 0) | host.endswith(".org") | F.coalesce("_hit", F.lit(False))).alias("held"))


@query("""WITH m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS mid FROM documents GROUP BY lang) SELECT doc_id, n_chars BETWEEN 0.6 * mid AND 1.8 * mid AS plausible, source IN ('src3', 'src7') AS test_voice FROM documents JOIN m USING (lang)""")
def plausible_length(t):
    """Between 0.6 and 1.8 times the usual length; and the fixed list of test voices."""
    middle = t.documents.groupBy("lang").agg(F.percentile("n_chars", 0.5).alias("mid"))
    return t.documents.join(middle, "lang").select("doc_id", F.col("n_chars").between(0.6 * F.col("mid"), 1.8 * F.col("mid")).alias("plausible"), F.col("source").isin("src3", "src7").alias("test_voice"))


@query(f"""WITH {E} SELECT user_id, count(*) FILTER (coalesce(status, 0) < 400) AS ok, count(*) FILTER (status IS NULL) AS unknown FROM (SELECT user_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN value > 30 THEN 404 ELSE 200 END AS status FROM e) GROUP BY user_id""")
def requests_ok(t):
    """A request without a status counts as served."""
    status = F.when(F.col("event_id") % 9 == 0, None).when(F.col("value") > 30, 404).otherwise(200)
    return events(t).withColumn("status", status).groupBy("user_id").agg(F.count_if(F.coalesce("status", F.lit(0)) < 400).alias("ok"), F.count_if(F.col("status").isNull()).alias("unknown"))


@query(f"""WITH {LINES}, p AS (SELECT doc_id, line_id, length(replace(norm, ' ', '')) AS letters, levenshtein(norm, lag(norm) OVER (PARTITION BY doc_id ORDER BY line_id)) AS cost FROM lines)
SELECT doc_id, line_id::INT AS line_id, coalesce(letters >= 4 AND cost / letters <= 0.4, false) AS placed FROM p""")
def placed_lines(t):
    """A line is placed if it has four letters and costs at most 0.4 edits a letter (here: against the line before)."""
    w = temporal.window_of(["doc_id"], ["line_id"])
    rows = lines(t).withColumn("letters", F.length(F.translate("norm", " ", ""))).withColumn("cost", F.levenshtein("norm", F.lag("norm").over(w)))
    return rows.select("doc_id", "line_id", F.coalesce((F.col("letters") >= 4) & (F.col("cost") <= 0.4 * F.col("letters")), F.lit(False)).alias("placed"))


@query("""WITH s AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag <> 'R') / sum(l_quantity) AS coverage, count(*) FILTER (l_returnflag <> 'R') AS lines FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, round(coalesce(coverage, 0), 6) AS coverage, coalesce(coverage, 0) >= 0.5 AND lines >= 3 AS usable FROM s""")
def usable_spans(t):
    """A span is usable if good lines cover half of it and there are three of them."""
    good = F.col("l_returnflag") != "R"
    sums = t.lineitem.groupBy("l_orderkey").agg(F.coalesce(F.sum(F.when(good, F.col("l_quantity"))) / F.sum("l_quantity"), F.lit(0.0)).alias("c"), F.count_if(good).alias("n"))
    return sums.select("l_orderkey", F.round("c", 6).alias("coverage"), ((F.col("c") >= 0.5) & (F.col("n") >= 3)).alias("usable"))


REVIEW = f"""{E}, iv AS (SELECT user_id, t AS a, t + {12 * HOUR} AS b FROM e WHERE event_type = 'purchase'), w AS (SELECT *, ['ok', 'uncertain', 'substituted', 'omitted', 'repeated', 'inserted'][event_id % 6 + 1] AS status, CASE WHEN event_id % 10 <> 0 THEN t END AS begin FROM e)"""


def reviewed(t):
    e = events(t)
    spans = e.filter("event_type = 'purchase'").select("user_id", F.col("t").alias("a"), (F.col("t") + 12 * HOUR).alias("b"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "uncertain", "substituted", "omitted", "repeated", "inserted"))), (F.col("event_id") % 6 + 1).cast("int"))
    words = e.withColumn("status", status).withColumn("begin", F.when(F.col("event_id") % 10 != 0, F.col("t")))
    inside = temporal.interval_join(words.select("user_id", "event_id", "t"), spans, ["user_id"], "t", "a", "b", 12 * HOUR).select("event_id").distinct().withColumn("_in", F.lit(True))
    return words.join(inside, "event_id", "left").withColumn("inside", F.coalesce("_in", F.lit(False))).drop("_in")


@query(f"""WITH {REVIEW} SELECT event_id, status IN ('ok', 'uncertain', 'substituted', 'repeated') AND begin IS NOT NULL AND EXISTS (SELECT 1 FROM iv WHERE iv.user_id = w.user_id AND begin >= a AND begin < b) AS scorable FROM w""")
def scorable_words(t):
    """A reviewed word can be scored if it was heard, has a start, and starts inside a reviewed interval."""
    return reviewed(t).select("event_id", (F.col("status").isin("ok", "uncertain", "substituted", "repeated") & F.col("begin").isNotNull() & F.col("inside")).alias("scorable"))


@query(f"""WITH {REVIEW}, x AS (SELECT w.*, EXISTS (SELECT 1 FROM iv WHERE iv.user_id = w.user_id AND w.t >= a AND w.t < b) AS inside FROM w)
SELECT tier, count(*) AS words FROM (SELECT unnest(CASE WHEN inside AND status IN ('ok', 'uncertain', 'substituted', 'repeated') AND begin IS NOT NULL THEN ['human', 'all'] WHEN NOT inside THEN ['auto', 'all'] ELSE [] END) AS tier FROM x) GROUP BY tier""")
def word_truth_tiers(t):
    """Human words inside reviewed intervals, automatic ones outside; all is both. An unscorable word inside belongs to neither."""
    human = F.col("inside") & F.col("status").isin("ok", "uncertain", "substituted", "repeated") & F.col("begin").isNotNull()
    tiers = F.when(human, F.array(F.lit("human"), F.lit("all"))).when(~F.col("inside"), F.array(F.lit("auto"), F.lit("all"))).otherwise(F.array().cast("array<string>"))
    return reviewed(t).select(F.explode(tiers).alias("tier")).groupBy("tier").agg(F.count("*").alias("words"))


PROVENANCE = "CASE WHEN doc_id % 11 = 0 THEN 'human_timed' WHEN doc_id % 5 = 0 THEN 'auto' WHEN doc_id % 7 = 0 THEN 'human_reviewed' WHEN source = 'src1' THEN 'human_timed' WHEN source = 'src2' THEN 'human_carried' ELSE 'unknown' END"


@query(f"""WITH k AS (SELECT doc_id, {PROVENANCE} AS kind FROM documents) SELECT doc_id, kind, kind IN ('human_timed', 'human_reviewed') AS human FROM k""")
def label_provenance(t):
    """Explicit if recorded, else automatic, else reviewed, else by the folder's name; what is missing is unknown, never human."""
    k = F.col("doc_id")
    explicit = F.when(k % 11 == 0, "human_timed")
    inferred = F.when(k % 5 == 0, "auto").when(k % 7 == 0, "human_reviewed").when(F.col("source") == "src1", "human_timed").when(F.col("source") == "src2", "human_carried").otherwise("unknown")
    kind = F.coalesce(explicit, inferred)
    return t.documents.select("doc_id", kind.alias("kind"), kind.isin("human_timed", "human_reviewed").alias("human"))


@query("""WITH f AS (SELECT s_suppkey AS k, ['sure', 'likely', 'needs-review'][s_suppkey % 3 + 1] AS level FROM supplier) SELECT k, level FROM f WHERE level IN ('sure', 'likely')""")
def chosen_fixes(t):
    """Fixes at least as sure as `likely`, in the order sure, likely, needs-review."""
    names = ("sure", "likely", "needs-review")
    order = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rows = t.supplier.select(F.col("s_suppkey").alias("k"), F.element_at(F.array(*map(F.lit, names)), (F.col("s_suppkey") % 3 + 1).cast("int")).alias("level"))
    return rows.filter(F.element_at(order, F.col("level")) <= 1)


@query("""WITH m AS (SELECT doc_id, source, lang, n_chars, doc_id % 4 = 0 AS used, doc_id % 3 <> 0 AS found, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 13) / 10.0 END AS err FROM documents)
SELECT source, count(*) AS n, count(*) FILTER (found) AS found, round(count(*) FILTER (found AND used) / count(*), 6) AS right_share, round(quantile_cont(err, 0.5), 6) AS median_error, round(sum(n_chars) / 3600.0, 6) AS hours FROM m GROUP BY source""")
def harvest_totals(t):
    """Per platform: recordings, those found, the share placed right, the median timing error, and hours."""
    k = F.col("doc_id")
    rows = t.documents.select("source", "n_chars", (k % 4 == 0).alias("used"), (k % 3 != 0).alias("f"), F.when(k % 5 != 0, (k % 13) / 10.0).alias("err"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_if("f").alias("found"), F.round(F.count_if(F.col("f") & F.col("used")) / F.count("*"), 6).alias("right_share"), F.round(F.percentile("err", 0.5), 6).alias("median_error"), F.round(F.sum("n_chars") / 3600.0, 6).alias("hours"))


@query("""SELECT a.o_orderkey AS k, count(b.o_orderkey) > 0 AS have FROM orders a LEFT JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND abs(a.o_totalprice - b.o_totalprice) < 2000 GROUP BY a.o_orderkey""")
def have_recording(t):
    """Is there another recording of the same text with nearly the same length? Neighbours in order of length decide it, without pairs."""
    w = temporal.window_of(["o_custkey"], ["o_totalprice", "o_orderkey"])
    near = lambda f: F.coalesce(F.abs(F.col("o_totalprice") - f("o_totalprice").over(w)) < 2000, F.lit(False))
    return t.orders.select(F.col("o_orderkey").alias("k"), (near(F.lag) | near(F.lead)).alias("have"))


@query(f"""WITH {LINES}, t AS (SELECT norm AS key, doc_id % 2 AS kind, doc_id, line_id, line FROM lines WHERE norm <> '' AND trim(line) <> ''), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY kind, doc_id, line_id) AS n FROM t) SELECT key, line FROM r WHERE n = 1""")
def translation_backfill(t):
    """The first translation for each key: pages before other sources, in order."""
    rows = lines(t).filter("norm <> '' and trim(line) <> ''")
    return rows.groupBy(F.col("norm").alias("key")).agg(F.min_by("line", F.struct((F.col("doc_id") % 2).alias("kind"), "doc_id", "line_id")).alias("line"))


@query(rf"""WITH tk AS (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark), x AS (SELECT item_id, i - 1 AS token, ws[i] AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM tk)),
n AS (SELECT item_id, token, w, len(list_filter(string_split({NORM % 'w'}, ' '), lambda v: v <> '')) AS k FROM x), r AS (SELECT item_id, token, w, unnest(range(k)) AS j FROM n)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY token, j) - 1)::INT AS word, w AS shown FROM r""")
def token_words(t):
    """For each normalised word the display token it comes from; a token of two words stands twice, one of none not at all."""
    tokens = t.benchmark.select("item_id", F.posexplode(F.split("text", " ")).alias("token", "shown"))
    copies = tokens.withColumn("_k", F.size(X.words(X.normalize_latin(F.col("shown"))))).filter("_k > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("_k"))))
    w = temporal.window_of(["item_id"], ["token", "j"])
    return copies.select("item_id", (F.row_number().over(w) - 1).alias("word"), "shown")


@query(f"""WITH {E}, f AS (SELECT user_id, t, event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS sym, lag(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e),
k AS (SELECT user_id, t, event_id, sym FROM f WHERE sym IS NOT NULL AND (p IS NULL OR p <> sym)), s AS (SELECT user_id, t // {48 * HOUR} AS w, string_agg(sym, ' ' ORDER BY t, event_id) AS text FROM k GROUP BY user_id, t // {48 * HOUR}) SELECT user_id, w AS span, text FROM s""")
def greedy_windows(t):
    """Greedy text of windows: the best symbol per frame, repeats collapsed, blanks (errors) dropped, cut at the windows' borders."""
    rows = events(t).withColumn("p", F.lag("event_type").over(temporal.window_of(["user_id"], ["t", "event_id"])))
    kept = rows.filter("event_type <> 'error' and (p is null or p <> event_type)")
    words = F.transform(F.array_sort(F.collect_list(F.struct("t", "event_id", "event_type"))), lambda x: x.event_type)
    return kept.groupBy("user_id", F.expr(f"t div {48 * HOUR}").alias("span")).agg(F.array_join(words, " ").alias("text"))


@query(f"""WITH {LINES}, x AS (SELECT doc_id, line_id, norm, min(line_id) OVER (PARTITION BY doc_id, norm) AS f FROM lines) SELECT doc_id, line_id::INT AS line_id, f::INT AS target FROM x WHERE norm <> ''""")
def practice_targets(t):
    """Lines with equal words stand for the first of them."""
    rows = lines(t).filter("norm <> ''")
    return rows.select("doc_id", "line_id", F.min("line_id").over(Window.partitionBy("doc_id", "norm")).alias("target"))


@query("""WITH o AS (SELECT doc_id, source, sha256(text) AS h FROM documents), n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 40 = 0 THEN text || '.' ELSE text END) AS h FROM documents)
SELECT source FROM o JOIN n USING (doc_id) GROUP BY source HAVING bool_and(o.h = n.h)""")
def fresh_sources(t):
    """Sources none of whose texts changed since they were made."""
    h = lambda c: F.sha2(c.cast("binary"), 256)
    old = t.documents.select("doc_id", "source", h(F.col("text")).alias("a"))
    new = t.documents.select("doc_id", h(F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("b"))
    return old.join(new, "doc_id").groupBy("source").agg(F.bool_and(F.col("a") == F.col("b")).alias("_same")).filter("_same").select("source")


@query(rf"""WITH w AS (SELECT item_id, list_filter(string_split({NORM % 'text'}, ' '), lambda x: x <> '') AS ws FROM benchmark) SELECT item_id, i::INT AS word, array_to_string(ws[greatest(1, i - 11):i], ' ') AS before FROM (SELECT item_id, ws, unnest(range(0, len(ws) + 1, 5)) AS i FROM w)""")
def text_before(t):
    """At every fifth word the up to twelve words before it, of the same text only."""
    ws = X.words(X.normalize_latin(F.col("text")))
    rows = t.benchmark.select("item_id", ws.alias("ws")).withColumn("word", F.explode(F.sequence(F.lit(0), F.size("ws"), F.lit(5))))
    return rows.select("item_id", "word", F.array_join(F.slice("ws", F.greatest(F.lit(1), F.col("word") - 11), F.least(F.col("word"), F.lit(12))), " ").alias("before"))


@query("""SELECT id, min(w) AS via FROM (SELECT doc_id AS id, 'label' AS w FROM labels WHERE toxic = 1 UNION SELECT item_id, 'benchmark' FROM benchmark UNION SELECT doc_id, 'source' FROM documents WHERE source = 'src5') GROUP BY id""")
def held_out_ids(t):
    """The union of several lists of held-out ids, each id once, with the first list by name."""
    a = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("id"), F.lit("label").alias("w"))
    b = t.benchmark.select(F.col("item_id").alias("id"), F.lit("benchmark").alias("w"))
    c = t.documents.filter("source = 'src5'").select(F.col("doc_id").alias("id"), F.lit("source").alias("w"))
    return a.unionByName(b).unionByName(c).groupBy("id").agg(F.min("w").alias("via"))


@query("""WITH g AS (SELECT source, CASE WHEN source LIKE '%1' THEN 'dev' WHEN source LIKE '%2' THEN 'final' END AS part FROM (SELECT DISTINCT source FROM documents)) SELECT g.part, count(*) AS n FROM documents d JOIN g ON d.source = g.source WHERE g.part IS NOT NULL GROUP BY g.part""")
def scored_parts(t):
    """Texts by the part of their group; a group without a part is never scored."""
    groups = t.documents.select("source").distinct().withColumn("part", F.when(F.col("source").endswith("1"), "dev").when(F.col("source").endswith("2"), "final"))
    return t.documents.join(groups.filter("part is not null"), "source").groupBy("part").agg(F.count("*").alias("n"))


@query("""SELECT source, substr(sha256(source || '|' || count(*) || '|' || sum(n_chars)::BIGINT), 1, 16) AS key FROM documents GROUP BY source""")
def cache_keys(t):
    """A cache key from everything a result depends on."""
    parts = F.concat_ws("|", "source", F.count("*").cast("string"), F.sum("n_chars").cast("string"))
    return t.documents.groupBy("source").agg(F.substring(F.sha2(parts.cast("binary"), 256), 1, 16).alias("key"))


@query(f"""WITH {LINES}, w AS (SELECT unnest(string_split(norm, ' ')) AS w FROM lines WHERE norm <> ''), c AS (SELECT w, count(*) AS n FROM w WHERE length(w) > 2 GROUP BY w),
q AS (SELECT DISTINCT p || w AS q FROM c, (VALUES (''), ('re'), ('un'), ('unre')) v(p) WHERE length(w) % 4 = 0), k AS (SELECT q, i, CASE i WHEN 0 THEN q WHEN 1 THEN CASE WHEN starts_with(q, 'un') THEN substr(q, 3) END WHEN 2 THEN CASE WHEN starts_with(q, 're') THEN substr(q, 3) END ELSE CASE WHEN starts_with(q, 'unre') THEN substr(q, 5) END END AS stem FROM q, range(4) r(i)),
h AS (SELECT q, i, stem, n, row_number() OVER (PARTITION BY q ORDER BY i) AS r FROM k JOIN c ON k.stem = c.w) SELECT q AS word, stem, n AS votes FROM h WHERE r = 1""")
def spelling_votes(t):
    """The corpus votes on a spelling: the word itself if it occurs, else what remains without the first prefix, in their order, that leads to a word that does."""
    ws = lines(t).filter("norm <> ''").select(F.explode(F.split("norm", " ")).alias("w")).filter(F.length("w") > 2)
    counts = ws.groupBy("w").agg(F.count("*").alias("votes"))
    asked = counts.filter(F.length("w") % 4 == 0).select(F.explode(F.array(*[F.concat(F.lit(p), F.col("w")) for p in ("", "re", "un", "unre")])).alias("word")).distinct()
    stems = [F.struct(F.lit(0).alias("i"), F.col("word").alias("stem"))]
    stems += [F.struct(F.lit(i).alias("i"), F.when(F.col("word").startswith(p), F.expr(f"substring(word, {len(p) + 1})")).alias("stem")) for i, p in enumerate(("un", "re", "unre"), 1)]
    found = asked.select("word", F.inline(F.array(*stems))).filter("stem is not null").join(counts, F.col("stem") == F.col("w"))
    return found.groupBy("word").agg(F.min_by(F.struct("stem", "votes"), "i").alias("b")).select("word", "b.*")


@query(f"""WITH RECURSIVE {E}, p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM e),
r AS (SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS want, NULL::BIGINT AS event_id, NULL::VARCHAR AS told FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT r.user_id, p.n, CASE WHEN p.event_id % 3 = want % 3 THEN want + 1 ELSE want END, p.event_id, CASE WHEN p.event_id % 3 = want % 3 THEN 'taken' WHEN p.event_id % 2 = 0 THEN 'again' ELSE 'refused' END FROM r JOIN p ON p.user_id = r.user_id AND p.n = r.n + 1)
SELECT event_id, told FROM r WHERE n > 0""")
def piece_answers(t):
    """Numbered pieces of a session in order of arrival: the next number is taken, an earlier one acknowledged again, a later one refused. The state is one number per session."""
    pieces = events(t).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("t", "event_id"))).alias("ps"))

    def step(done, piece):
        seq, want = piece.event_id % 3, done["want"]
        told = F.when(seq == want % 3, "taken").when(piece.event_id % 2 == 0, "again").otherwise("refused")
        return F.struct(F.when(told == "taken", want + 1).otherwise(want).alias("want"), F.concat(done["told"], F.array(F.struct(piece.event_id.alias("event_id"), told.alias("told")))).alias("told"))

    start = F.struct(F.lit(0).cast("long").alias("want"), F.array().cast("array<struct<event_id: bigint, told: string>>").alias("told"))
    return pieces.select(F.inline(F.aggregate("ps", start, step, lambda done: done["told"])))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, vec_id % 10 = 0 AS test, vec_id % 7 AS len FROM embeddings), m AS (SELECT a.vec_id, max(list_dot_product(a.x, b.x)) AS best FROM v a JOIN v b ON b.test AND NOT a.test AND a.label = b.label GROUP BY a.vec_id)
SELECT vec_id, round(best, 4) AS best, CASE WHEN best >= 0.85 THEN 'held out' WHEN best >= 0.35 THEN 'leak?' ELSE 'train' END AS verdict FROM m""")
def voice_holdout(t):
    """The nearest test voice of each training vector of its label: held out from 0.85, flagged from 0.35."""
    v = t.embeddings.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 10 == 0).alias("test"))
    bank = v.filter("test").select("label", F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    best = v.filter("not test").join(bank, "label").groupBy("vec_id").agg(F.max(dot).alias("b"))
    return best.select("vec_id", F.round("b", 4).alias("best"), F.when(F.col("b") >= 0.85, "held out").when(F.col("b") >= 0.35, "leak?").otherwise("train").alias("verdict"))


@query(f"""WITH {E} SELECT user_id, event_type AS reason, count(*) AS n, max(value) AS oldest, row_number() OVER (PARTITION BY user_id ORDER BY min(t), event_type)::INT AS place FROM e GROUP BY user_id, event_type""")
def gate_timeline(t):
    """What a gate logged: counts by reason, the oldest age, and the order in which reasons first came."""
    sums = events(t).groupBy("user_id", F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.max("value").alias("oldest"), F.min("t").alias("_first"))
    return sums.withColumn("place", F.row_number().over(temporal.window_of(["user_id"], ["_first", "reason"]))).drop("_first")
