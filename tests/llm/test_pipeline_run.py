"""run() as a whole against a brute-force version, with null and repeated ids, repeated rows, nulls, clashing columns, and an empty table."""

import collections
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_operators import _corpus, _jaccard, _repeats, _words
from waymark.llm import mixing, quality
from waymark.llm.queries import tokenizer_path

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string, size string, taken string, row string, doc string, component_id string, sequence_id string, keep_id string, text_sha256 string, _rest string"
CLASHES = len(COLUMNS.split(",")) - 5
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _top(v):
    """The largest value of v's sketch bucket."""
    shift = max(v.bit_length() - 5, 0)
    return ((v >> shift) + 1 << shift) - 1


def _quantile(values, q):
    values = sorted(_top(v) for v in values)
    return next(v for i, v in enumerate(values, 1) if i * 100 >= q * len(values))


def _good(rows):
    """Rows that pass the base rule and the limits of their group."""
    measured = []
    for r in rows:
        text, w = r[1] or "", _words(r[1])
        n, lines = len(w), [x for x in text.split("\n") if x.encode().split()]
        if n >= 20 and 100 * _repeats(w) <= 30 * n:
            chars, symbols = sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text)
            dup = len(lines) - len(set(lines))
            measured.append((r, {"word_length": 100 * chars // n, "symbols": 10000 * symbols // n, "dup_lines": 10000 * dup // len(lines), "words": n, "lines": len(lines)}))
    kept = []
    for r, m in measured:
        for level in (lambda x: x[0][2:4] == r[2:4], lambda x: x[0][2] == r[2], lambda x: True):  # noqa: B023
            group = [x[1] for x in measured if level(x)]
            if len(group) >= quality.MIN_GROUP:
                break

        def at(metric, q):
            return _quantile([x[metric] for x in group], q)  # noqa: B023

        bad = False
        for name, (_, low, high, reach, _) in quality.METRICS.items():
            middle = at(name, 50)
            unit = middle // 16 if name == "word_length" else 10000 // at("words" if name == "symbols" else "lines", 50)
            bad |= m[name] > middle + reach * max(at(name, high) - middle, unit)
            bad |= low is not None and m[name] < middle - reach * max(middle - at(name, low), unit)
        if not bad:
            kept.append(r)
    return kept


def _expected(rows):
    rows = _good(rows)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1].translate(FOLD)].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    found = _jaccard([(i, r[1]) for i, r in enumerate(rows)], 5, 80)
    members = collections.defaultdict(list)
    for i, (_, c) in found.items():
        members[c].append(rows[i])
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in members.values()]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "text": [r[1] for r in rows], "source": [r[3] for r in rows]}))
    taken = {(i, s, n): t // n for i, s, n, t in con.execute(f"SELECT doc_id, source, size, taken FROM ({mixing.ORACLE})").fetchall()}
    tokenizer = Tokenizer.from_file(tokenizer_path())
    out = collections.Counter()
    for r in rows:
        ids = np.array([*tokenizer.encode(r[1], add_special_tokens=False).ids, 0], "<u4")
        size, at, piece = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            out[r[0], piece, at, size, zlib.crc32(ids[at : at + size].tobytes())] += taken[r[0], r[3], len(_words(r[1]))]
            at, size, piece = at + size, 2048, piece + 1
    return +out


def test_run(spark, tmp_path):
    rnd = random.Random(4)
    vocabulary = [f"word{i}" for i in range(500)]
    rows = [(*r[:5], *["x"] * CLASHES) for r in _corpus(7)]
    for n in range(300):  # enough for groups that are judged by their own limits
        text = " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 80)))
        text += " ###" * rnd.choice([0, 0, 0, 0, 0, 0, 1, 9])
        rows.append((1000 + n, text, "en", rnd.choice(["s0", "s1"]), 0, *["y"] * CLASHES))
    long = [r for r in rows if r[1] and 60 < len(_words(r[1])) < 200]
    rows += [long[0], long[0], long[1]]  # repeated rows
    rows += [(long[2][0], " ".join(rnd.choice(vocabulary) for _ in range(50)), *long[2][2:])]  # one id, two texts
    rows += [(None, long[3][1], *long[3][2:]), (None, " ".join(rnd.choice(vocabulary) for _ in range(60)), *long[4][2:])]
    rows += [(None, " ".join(rnd.choice(vocabulary) for _ in range(61)), "en", None, 0, *["z"] * CLASHES), (None, None, *long[4][2:])]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == _expected(rows)
    assert any(r.doc_id is None for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_run_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.createDataFrame([(1, None, None, None, 0, *["x"] * CLASHES)], COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns
