"""The pipeline's decisions, stage by stage, against brute force on a small table."""

import collections

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, _corpus, _jaccard, _words


def test_stages(spark):
    rows = _corpus(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality_rules"](spark, docs, "").cache()
    assert good.columns == docs.columns
    assert {len(_words(r.text)) >= 20 for r in good.collect()} == {True}
    unique = stages["exact_dedup"](spark, good, "").cache()
    least = {}
    for r in good.collect():
        key = r.text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        least[key] = min(least.get(key, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(least.values())
    apart = stages["ngram_jaccard_join"](spark, unique, "").cache()
    left = [tuple(r) for r in unique.collect()]
    want = {i for i, (_, c) in _jaccard(left, 5, 80).items() if i == c}
    assert {r.doc_id for r in apart.collect()} == want
    mixed = stages["mixing"](spark, apart, "").cache()
    assert mixed.columns == docs.columns
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert set(copies) <= want and max(copies.values()) <= 3
    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    assert collections.Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_repeated_rows_become_one(spark):
    rows = [r for r in _corpus(6) if r[1] and len(_words(r[1])) > 30][:6]
    docs = spark.createDataFrame([*rows, *rows], SCHEMA)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "").collect()) == sorted({r[0] for r in rows})
