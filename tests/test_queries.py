"""Every query of the engine with SQL equals DuckDB's result at the smallest size; the others run."""

import duckdb
import pytest

from obsidra.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in TABLES:
        out.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return out


def rows(found, names, columns):
    text = lambda v: "~" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    at = [names.index(c) for c in columns]
    return sorted(tuple(text(r[i]) for i in at) for r in found)


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, con, name):
    got = plans.QUERIES[name](spark, SF)
    if name not in plans.ORACLES:
        assert not got.isEmpty()
        return
    want = con.sql(plans.ORACLES[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got.collect(), got.columns, columns) == rows(want.fetchall(), want.columns, columns)


def test_entry_without_the_corpus_operators(monkeypatch, spark):
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("obsidra.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "obsidra.llm", None)
    monkeypatch.setitem(sys.modules, "obsidra.llm.queries", None)
    assert set(entry.queries()) == set(plans.QUERIES)
    assert entry.entry(spark).count() > 0
