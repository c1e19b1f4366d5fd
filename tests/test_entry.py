import importlib
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["item_id", "doc_id", "line_id", "shared"]


@pytest.mark.parametrize("name", ["label_at", "inside_spans", "nearest_purchase", "activity_runs", "visitors", "grid_rows", "shared_passages", "retrieve_texts"])
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("events", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, got.select(*names).collect())) == sorted(map(key, want.fetchall()))


def test_imports_without_the_corpus_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("waymark.llm")] + ["corpus_pipeline", "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, name, raising=False)
    monkeypatch.setitem(sys.modules, "waymark.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    alone = importlib.import_module("__spark_entry__")
    assert "locate_passage" in alone.queries() and "pipeline" not in alone.queries()
