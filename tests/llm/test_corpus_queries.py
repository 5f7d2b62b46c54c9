"""The registered queries at the smallest size: schemas of the contracts, whole tables, oracles in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CONTRACTS = {
    "op1_": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op4_": ["vec_id", "n_links", "component_id", "kept"],
    "op5_": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op6_": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op10_": ["query_id", "rank", "vec_id", "score"],
}


def test_one_query_per_operator():
    names = list(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


@pytest.mark.parametrize("prefix", CONTRACTS)
def test_columns(spark, prefix):
    name = next(x for x in entry.queries() if x.startswith(prefix))
    assert entry.queries()[name](spark, SF).columns[: len(CONTRACTS[prefix])] == CONTRACTS[prefix]


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n.startswith("op")))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    text = lambda row: tuple("~" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    assert sorted(map(text, got.select(columns).collect())) == sorted(map(text, want.project(", ".join(columns)).fetchall()))
