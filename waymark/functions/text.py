"""Text as Column expressions: folds, letter codes, n-grams, keys, hashes, classifications.

Everything is a built-in expression (whole-stage code generation applies), except `nfkc`, which Spark has no
function for, and `looped`, which needs zlib; those two are Arrow-batched.
"""

from __future__ import annotations

import unicodedata
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: marks (vowel signs, the dagger alef, Quranic signs, tatweel), the letters and their folds ----
MARKS = "[\u064B-\u065F\u0670\u06D6-\u06ED\u0640]"
LETTERS = "ء-ي"
FOLDS = {
    "آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا",
    "ى": "ي", "ی": "ي", "ئ": "ي",
    "ؤ": "و",
    "ة": "ه",
    "ک": "ك",
    "ہ": "ه", "ۃ": "ه", "ھ": "ه", "ۂ": "ه",
    "ے": "ي", "ۓ": "ي",
}
BARE_MARKS = "[\u064B-\u065F\u0670\u0640\u06E1-\u06ED]"
BARE_FOLDS = {
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا",
    "ى": "ي", "ة": "ه", "ی": "ي", "ک": "ك",
    "ؤ": "و", "ئ": "ي",
}
FIRST_LETTER = 0x0620
# ---- end of the fixed values ----

#: Latin letters with marks and what they fold to, for corpora in European languages.
LATIN_FROM, LATIN_TO = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def strip_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def fold(text: Column, letters: dict[str, str]) -> Column:
    return F.translate(text, "".join(letters), "".join(letters.values()))


def normalize(text: Column) -> Column:
    """Bare Arabic letters, single spaces. Presentation forms must expand first, hence NFKC before the marks."""
    folded = fold(strip_marks(nfkc(text)), FOLDS)
    return F.trim(F.regexp_replace(F.regexp_replace(folded, f"[^{LETTERS}\\s]", " "), r"\s+", " "))


def fold_latin(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN_FROM, LATIN_TO)


def normalize_latin(text: Column) -> Column:
    return F.trim(F.regexp_replace(fold_latin(text), "[^a-z]+", " "))


def encode(normal: Column) -> Column:
    """Letter codes 1..42 of normalised text, spaces dropped."""
    letters = F.filter(F.split(normal, ""), lambda c: (c != " ") & (c != ""))
    return F.transform(letters, lambda c: (F.ascii(c) - FIRST_LETTER).cast("tinyint"))


def bare(text: Column) -> Column:
    """The second fold: its own marks and letters, no NFKC; what is no letter becomes a space, words stay apart."""
    kept = F.regexp_replace(fold(F.regexp_replace(text, BARE_MARKS, ""), BARE_FOLDS), f"[^{LETTERS}]", " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def whisper_style(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(strip_marks(nfkc(text)), "یکٱ", "يكا"), f"[^{LETTERS}\\s]", " "), r"\s+", " "))


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside a lambda an expression would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def ngrams(letters: Column, n: int) -> Column:
    """Distinct letter n-grams; empty for shorter strings (sequence would run backwards)."""

    def of(x: Column) -> Column:
        places = F.when(F.length(x) >= n, F.sequence(F.lit(1), F.length(x) - n + 1))
        return F.coalesce(F.array_distinct(F.transform(places, lambda i: F.substring(x, i, F.lit(n)))), F.array().cast("array<string>"))

    return let(letters, of)


def word_grams(ws: Column, n: int) -> Column:
    """Word n-grams with repeats."""

    def of(x: Column) -> Column:
        places = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - n + 1))
        return F.coalesce(F.transform(places, lambda i: F.array_join(F.slice(x, i, n), " ")), F.array().cast("array<string>"))

    return let(ws, of)


def share_in(grams: Column, held: Column) -> Column:
    """Share of grams, counted with repeats, that are among `held`; null without grams."""
    return F.when(F.size(grams) > 0, F.size(F.filter(grams, lambda g: F.array_contains(held, g))) / F.size(grams))


def text_hash(lines: Column) -> Column:
    return F.substring(F.sha2(F.array_join(lines, "\n").cast("binary"), 256), 1, 16)


def same_word(a: Column, b: Column) -> Column:
    """Equal, or both of four letters or more and one edit apart."""
    near = (F.least(F.length(a), F.length(b)) >= 4) & (F.levenshtein(a, b, 1) == 1)
    return (a == b) | near


def script(line: Column) -> Column:
    """'arabic' or 'latin': at least four letters of it and three times as many as of the other; else null."""
    arabic, latin = F.regexp_count(line, F.lit(f"[{LETTERS}]")), F.regexp_count(line, F.lit("[A-Za-z]"))
    return F.when((arabic >= 4) & (arabic >= 3 * latin), "arabic").when((latin >= 4) & (latin >= 3 * arabic), "latin")


def looks_english(ws: Column, function_words: list[str]) -> Column:
    hits = F.size(F.filter(ws, lambda w: F.lower(w).isin(function_words)))
    return (F.size(ws) > 0) & (hits * 5 >= F.size(ws))


def vowelled(text: Column) -> Column:
    """At least 0.6 of the consonants carry a mark; text without consonants counts as vowelled."""
    letters = F.regexp_count(text, F.lit(f"[{LETTERS}]"))
    marked = F.regexp_count(text, F.lit(f"[{LETTERS}][ً-ْٰ]"))
    return (letters == 0) | (marked >= 0.6 * letters)


def opening(lines: Column, skip: Column | None = None, n: int = 3, most: int = 120) -> Column:
    """The first n non-empty lines, joined, at most `most` characters."""
    kept = F.filter(lines, lambda x: (F.trim(x) != "") if skip is None else ((F.trim(x) != "") & (x != skip)))
    return F.substring(F.array_join(F.slice(kept, 1, n), " "), 1, most)


# ---- fixed values: browsers and systems in the order they are looked for ----
SYSTEMS = (("iPhone", "iPhone"), ("iPad", "iPad"), ("Android", "Android"), ("Windows", "Windows"), ("Mac OS X", "Mac"), ("Linux", "Linux"))
BROWSERS = (("Edg/", "Edge"), ("SamsungBrowser/", "Samsung"), ("CriOS/", "Chrome"), ("FxiOS/", "Firefox"), ("Firefox/", "Firefox"), ("Chrome/", "Chrome"), ("Version/", "Safari"))


def short_agent(agent: Column) -> Column:
    """System, browser and its major version; the first that matches decides, so the order is part of the meaning."""
    system = F.coalesce(*[F.when(F.contains(agent, F.lit(k)), F.lit(v)) for k, v in SYSTEMS], F.lit("?"))
    found = [F.when(F.regexp_like(agent, F.lit(f"{k}[0-9]+")), F.concat(system, F.lit(f" {v} "), F.regexp_extract(agent, f"{k}([0-9]+)", 1))) for k, v in BROWSERS]
    rest = F.when(F.coalesce(agent, F.lit("")) == "", F.lit("(no browser named)")).otherwise(F.concat(system, F.lit(" "), F.substring(agent, 1, 40)))
    return F.coalesce(*found, rest)


@F.pandas_udf(T.BooleanType())
def looped(text: pd.Series) -> pd.Series:
    """A decoding loop: more than 40 bytes that zlib shrinks by more than 2.4."""

    def one(x: str | None) -> bool:
        raw = (x or "").encode()
        return len(raw) > 40 and len(raw) / len(zlib.compress(raw)) > 2.4

    return text.map(one)


def passage_keys(ws: Column) -> Column:
    """Words as passages compare them: a lone conjunction joins the word after it, a lone hamza the word before. One pass from the left."""
    # a word joins the key before it if it is a hamza, or if that key is a conjunction that still waits
    waits = F.lit("و")

    def step(done: Column, w: Column) -> Column:
        last = F.element_at(done["keys"], -1)
        joins = (F.size(done["keys"]) > 0) & ((w == "ء") | done["open"])
        keys = F.when(joins, F.concat(F.slice(done["keys"], 1, F.size(done["keys"]) - 1), F.array(F.concat(last, w)))).otherwise(F.concat(done["keys"], F.array(w)))
        return F.struct(keys.alias("keys"), (~joins & (w == waits)).alias("open"))

    start = F.struct(F.array().cast("array<string>").alias("keys"), F.lit(False).alias("open"))
    return F.aggregate(ws, start, step, lambda done: done["keys"])


#: fixed values: what a download's error says and what it means, the first that fits
ERRORS = (
    ("auth", ("sign in to confirm", "not a bot")),
    ("rate", ("429", "too many requests", "try again later", "page needs to be reloaded")),
    ("gone", ("private video", "unavailable", "removed", "members-only", "copyright", "age", "not available", "terminated", "blocked")),
)


def error_kind(message: Column) -> Column:
    found = [F.when(F.lower(message).rlike("|".join(parts)), kind) for kind, parts in ERRORS]
    return F.coalesce(*found, F.lit("fail"))


def clean_title(title: Column) -> Column:
    """Without what stands in brackets, single spaces, no dash or colon at the ends, the first letter in upper case."""
    bare_title = F.trim(F.regexp_replace(F.regexp_replace(title, r"\s*\(.*?\)\s*", " "), r"\s+", " "), F.lit(" -:"))
    return F.concat(F.upper(F.substring(bare_title, 1, 1)), F.substr(bare_title, F.lit(2)))


def for_display(reading: Column, source: Column) -> Column:
    """The text's own reading if it is vowelled or nothing else is there."""
    return F.when(vowelled(reading) | source.isNull() | (source == ""), reading).otherwise(source)


def hallucinated(text: Column, whole: list[str], parts: list[str]) -> Column:
    bare_text = F.trim(text, F.lit(" .!؟?،,"))
    hit = bare_text.isin(whole) if whole else F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit | looped(text)
