"""Operators against brute force on small tables with nulls, empties, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from waymark.llm import bytespans, exactdup, jaccard, lmscore, mixing, packing, quality, substrings, suffixes, urlrules, warc
from waymark.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, kept string, size string"


def _corpus(seed=0):
    """Unrelated texts, exact and near copies, shared passages, one very long text, nulls, empties."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(300)]

    def prose(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    passage = prose(60)
    texts = [prose(rnd.randint(1, 120)) for _ in range(40)]
    texts += [texts[0], texts[0].upper(), texts[1], texts[1]]
    base = prose(150).split()
    for _ in range(30):  # a group of near copies, larger than a short posting list
        copy = list(base)
        for _ in range(rnd.randint(0, 4)):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary) + "x"
        texts.append(" ".join(copy))
    texts += [prose(20) + " " + passage + " " + prose(20) for _ in range(5)]
    texts += [prose(4000) + " " + passage, None, "", " \n\t ", "one two", "one two", "a b\nc d\na b\n\n c", "x " * 400]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["s0", "s0", "s1", None]), 0, "s", "k", "z") for i, t in enumerate(texts)]
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def corpus():
    return _corpus()


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().split()


def test_lm_scoring(docs, corpus, none):
    one, two = collections.Counter(), collections.Counter()
    for r in corpus:
        w = _words(r[1])
        one.update(w)
        two.update(zip(w, w[1:], strict=False))
    total = sum(one.values())
    got = {r.doc_id: r for r in lmscore.stupid_backoff(docs).collect()}
    assert len(got) == len(corpus)
    for r in corpus:
        w, score = _words(r[1]), 0.0
        for i, x in enumerate(w):
            if i and two[w[i - 1], x] >= 2:
                score += np.log(two[w[i - 1], x] / one[w[i - 1]])
            else:
                score += np.log(one[x] / total) + (np.log(0.4) if i else 0)
        assert abs(got[r[0]].log_score - score) < 1e-6 and got[r[0]].n_words == len(w)
        assert (got[r[0]].mean_log_score is None) == (not w)
    assert lmscore.stupid_backoff(none).count() == 0


def test_lm_scoring_of_trigrams(spark):
    rows = spark.createDataFrame([(1, "a b c a b c a b d"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in lmscore.stupid_backoff(rows, order=3).collect()}
    # a, then b after a (4 of 4), then c after a b (3 of 4)
    assert abs(got[2].log_score - (np.log(4 / 12) + np.log(1.0) + np.log(3 / 4))) < 1e-9


def _targets(sizes, weights=(1, 2, 3)):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        give = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if give[s] > 3 * sizes[s]]
        if not over:
            return fixed | give
        fixed |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(docs, corpus, none):
    got = mixing.mix(docs).collect()
    sizes = collections.Counter()
    for r in corpus:
        sizes[r[3]] += len(_words(r[1]))
    want = _targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(none).count() == 0
    assert mixing.repeat_rows(docs, mixing.mix(docs)).groupBy().agg(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(taken.values())


def test_mixing_with_salted_sources(docs, monkeypatch):
    plain = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == plain


def test_mixing_of_capped_and_empty_sources(spark):
    rows = spark.createDataFrame([(1, "a", "p"), (2, "b " * 50, "q"), (3, None, "r"), (4, "c " * 7, None), (None, "d", None)], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.mix(rows).collect()}
    want = _targets({"p": 1, "q": 50, "r": 0, None: 8})
    assert all(abs(got[s] - want[s]) < 1e-9 for s in want)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(docs, corpus, none, keep):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = collections.defaultdict(list)
    for r in corpus:
        groups[(r[1] or "").translate(fold)].append(r[0])
    got = {r.doc_id: r for r in exactdup.exact_dedup(docs, keep=keep).collect()}
    assert len(got) == len(corpus)
    for text, ids in groups.items():
        stays = min(ids) if keep == "smallest" else max(ids)
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (stays, len(ids), i == stays, hashlib.sha256(text.encode()).hexdigest())
    assert exactdup.exact_dedup(none).count() == 0


def test_exact_dedup_of_rows_without_ids(spark):
    rows = spark.createDataFrame([(None, "a"), (None, "A"), (7, "a"), (7, "a"), (None, "z")], "doc_id long, text string")
    got = sorted(map(tuple, exactdup.exact_dedup(rows).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(None, 7, 4, False), (None, 7, 4, False), (7, 7, 4, True), (7, 7, 4, True), (None, None, 1, True)], key=str)


@given(st.lists(st.binary(max_size=6).map(lambda b: bytes(x % 3 for x in b)), max_size=40), st.sampled_from([b"", b"h" * 5000]))
@settings(deadline=None, max_examples=60)
def test_spilling_trie(keys, prefix):
    """Every key is in the trie or comes back, rounds end, and equal keys meet; a shared prefix of 5 kB changes nothing."""
    got, waiting, rounds = collections.Counter(), [(prefix + k, 1) for k in keys], 0
    while waiting:
        trie = exactdup.SpillingTrie(lambda a, b: a + b, memory=6000)
        waiting = [x for k, n in waiting for x in trie.insert(k, n)]
        found = dict(trie.items())
        assert not set(found) & set(got)
        got.update(found)
        rounds += 1
        assert rounds <= len(keys) + 1
    assert got == collections.Counter(prefix + k for k in keys)


def test_exact_dedup_with_spills(docs, corpus):
    owners = exactdup.exact_owners(docs, memory=2000).collect()
    groups = collections.defaultdict(list)
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for r in corpus:
        groups[(r[1] or "").translate(fold)].append(r[0])
    assert sorted((r.length, r.keep_id, r.group_size) for r in owners) == sorted((len(t.encode()), min(ids), len(ids)) for t, ids in groups.items())


def test_url_rules(spark):
    urls = ["http://a.example.com/en/712?x", "https://EXAMPLE.com/en/8", "http://x.org/es/", "http://org/es/1", "http://xorg/es/1", "http://example.net/de/8.html", "http://net/de/8", "ftp://a.net/fr", "no scheme", "", None, "http://a.com", "http://h.com?u=http://b.org/es/", "x://Q.Com/en/#f"]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    want = [("example.com/en/7", "allow"), ("com/en/", "block"), ("org/es/", "block"), ("org/es/", "block"), (None, "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/en/", "block")]
    for limit in (urlrules.MAX_RULES_BYTES, 0):
        got = urlrules.judge(rows, max_rules_bytes=limit).orderBy("page_id").collect()
        assert [(r.rule, r.verdict) for r in got] == want
    assert (got[0].host, got[0].path, got[8].host, got[8].path) == ("a.example.com", "/en/712", "", "")


def test_packing(docs, corpus, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    got = packing.best_fit_packing(docs, tokenizer_path()).toPandas()
    for i, text, *_ in corpus:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.length[1:] == 2048).all()
        assert (mine.start == mine.length.cumsum() - mine.length).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    bins = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (bins.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert bins.length.sum().max() <= 2048 and bins.ngroups <= -(-got.length.sum() // 2048) + 1
    assert packing.best_fit_packing(none, tokenizer_path()).count() == 0


def test_sequences_hold_all_tokens(docs):
    made = packing.sequences(docs, tokenizer_path()).collect()
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 2048 for r in made)


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(0, 5))
@settings(deadline=None, max_examples=50)
def test_genetic_packing_is_valid(sizes, seed):
    length = np.array(sorted(sizes, reverse=True))
    for bins in packing.evolve(length, [], 50, seed):
        assert np.bincount(bins, weights=length).max() <= 50 and set(bins) == set(range(bins.max() + 1))


def test_pre_tokens_match_the_library():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from waymark.llm.tokens import Encoder

    rnd = random.Random(1)
    letters = "ab'sStremvld 1²٣é\n\t   　!?\"’中😀\x1c\x85​<|>"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(3000)] + ["<|endoftext|> a", "", "it's 's we'llx"]
    ids, ends = Encoder(tokenizer_path()).encode(pa.array(texts, pa.large_string()))
    for i, e in enumerate(Tokenizer.from_file(tokenizer_path()).encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] : ends[i + 1]].tolist() == e.ids


def test_warc_round_trip(spark):
    long = "p" * 100
    rows = [(3, "http://a", long), (1, "http://b", long), (2, None, "short"), (5, "u", "short"), (4, "http://é", None), (6, "x", "é" * 50), (7, "y", "é" * 50), (None, "z", "alone " * 30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    path = warc.write(pages)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows)
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("response", None), 4: ("response", None), 6: ("response", None), 7: ("revisit", 6), None: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    whole = {r.page_id: bytes(r.record) for r in warc.whole(spark, path).collect()}
    head, _, body = whole[1].partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\n") and body.endswith(long.encode() + b"\r\n\r\n")
    size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
    assert len(body) == size + 4
    payloads = {r.page_id: bytes(r.payload) for r in warc.whole(spark, path).collect()}
    assert payloads == {i: (html or "").encode() for i, _, html in rows}  # revisits too
    assert spark.read.parquet(f"{path}/payloads").count() == 5


def _jaccard(rows, k, percent):
    sets = {}
    for i, text, *_ in rows:
        w = [x.lower() for x in _words(text)]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in sets:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join(docs, corpus, none, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs, k, percent).collect()}
    assert got == _jaccard(corpus, k, percent)
    if k == 4:
        assert jaccard.near_duplicates(none).count() == 0


def test_jaccard_join_of_rows_without_ids(spark):
    text = " ".join(f"v{i}" for i in range(30))
    rows = spark.createDataFrame([(None, text), (9, text), (9, text), (None, "other words than those above"), (4, None)], "doc_id long, text string")
    got = sorted((tuple(r)[0], tuple(r)[2]) for r in jaccard.near_duplicates(rows).collect() if r.doc_id is not None)
    assert got == [(4, 4), (9, 9), (9, 9)]
    assert sorted(str(r.component_id) for r in jaccard.near_duplicates(rows).filter("doc_id is null").collect()) == ["9", "None"]


def test_repeated_bytes(docs, corpus, none):
    size = 60
    count = collections.Counter(b[j : j + size] for r in corpus for b in [(r[1] or "").encode()] for j in range(len(b) - size + 1))
    got = {r.doc_id: r for r in bytespans.repeated_bytes(docs, size, 30).collect()}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - size + 1):
            if count[b[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        runs = len([x for x in bytes(gone).split(b"\0") if x])
        kept = hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(b), sum(gone), runs, kept)
    assert bytespans.repeated_bytes(none).count() == 0


def test_repeated_bytes_ignores_ids(spark):
    rows = spark.createDataFrame([(None, "q" * 30 + "abcdefghijklmnopqrstuvwxyz" * 8), (1, "abcdefghijklmnopqrstuvwxyz" * 8), (1, "short")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in bytespans.repeated_bytes(rows).collect())
    assert got == [(5, 0), (208, 208), (238, 208)]


@given(st.lists(st.binary(max_size=50).map(lambda b: bytes(x % 2 for x in b)), max_size=30), st.data())
@settings(deadline=None, max_examples=80)
def test_deep_shallow_sort(strings, data):
    prefix = data.draw(st.sampled_from([b"", b"\0" * 35, b"\1\0" * 40]))
    strings = [prefix + s for s in strings]
    group = np.array([data.draw(st.integers(0, 2)) for _ in strings], np.int64)
    size = np.array([len(s) for s in strings], np.int64)
    start = np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64) if len(size) else size
    order, shared = suffixes.sort(np.frombuffer(b"".join(strings) or b"\0", np.uint8), start, size, group)
    rows = [(group[i], strings[i]) for i in order]
    assert rows == sorted((g, s) for g, s in zip(group, strings, strict=True))
    for a, b, n in zip(rows, rows[1:], shared[1:], strict=False):
        want = -1 if a[0] != b[0] else suffixes.common_prefix(a[1], b[1])
        assert n == want


def _passages(rows, window):
    own = {}
    for i, text, *_ in rows:
        w = _words(text)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            own[key] = min(own.get(key, i), i)
    out = {}
    for i, text, *_ in rows:
        w = _words(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if own[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def test_repeated_passages(docs, corpus, none):
    got = substrings.repeated_passages(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()} == _passages(corpus, 13)
    cleaned = {r.doc_id: r.text for r in substrings.removed_texts(docs).collect()}
    want = _passages(corpus, 13)
    assert all(hashlib.sha256((t or "").encode()).hexdigest() == want[i][2] for i, t in cleaned.items())
    assert substrings.repeated_passages(none).count() == 0


def test_repeated_passages_of_equal_and_missing_ids(spark):
    text = " ".join(f"u{i}" for i in range(20))
    rows = spark.createDataFrame([(3, text), (3, text), (None, text), (5, text + " tail")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.repeated_passages(rows).collect())
    assert got == [("3", 0), ("3", 0), ("5", 20), ("None", 20)]


def _repeats(w, n=8):
    seen = collections.defaultdict(list)
    for j in range(len(w) - n + 1):
        seen[tuple(w[j : j + n])].append(j)
    return len({j + k for places in seen.values() if len(places) > 1 for j in places for k in range(n)})


def test_quality_counts(docs, corpus, none):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(corpus)
    for i, text, *_ in corpus:
        text, w = text or "", _words(text)
        spoken = [x for x in text.split("\n") if x.encode().split()]
        want = (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(spoken) - len(set(spoken)), _repeats(w))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.judge(none).count() == 0


def test_quality_limits_follow_the_source(spark):
    rnd = random.Random(2)

    def prose(n, sign=""):
        return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "rho"]) + str(rnd.randrange(999)) + sign for _ in range(n))

    rows = [(i, prose(60), "en", "plain") for i in range(300)] + [(1000 + i, prose(60, "#"), "en", "signs") for i in range(300)] + [(5000, prose(60, "###"), "en", "plain")]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    # one symbol a word is usual in one source and not in the other
    assert all(got[i] for i in [*range(300), *range(1000, 1300)]) and not got[5000]


def test_sketch_error(spark):
    values = [random.Random(3).randrange(10**6) for _ in range(2000)]
    rows = spark.createDataFrame([(v,) for v in [*range(40), *values]], "v long").select("v", quality.top_of(quality.bucket(F.col("v"))).alias("top"))
    assert all(r.v <= r.top <= r.v * 17 / 16 + 1 for r in rows.collect())
