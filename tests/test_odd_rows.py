"""Queries on rows that the smallest tables don't hold, against their SQL."""

from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from obsidra.plans import queries as plans


def against_sql(spark, folder, name, **tables):
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows if isinstance(rows, pa.Table) else pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(plans.ORACLES[name])
    got = plans.QUERIES[name](spark, str(folder)).select(*want.columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))
    return got


def test_references_cut_short_in_articles(spark, tmp_path):
    heads = ["a &amp;&amp", "b&lt", "c &lt;d&gt; &#39;&quot;e&nbsp;f &amp;lt; &amp;amp", "g & h &#3", "i &copy &eacute; j&"]
    page = lambda h: f"<html><head><title>{h}</title></head><body><h1>{h}</h1><article><h1>{h}</h1><p>x {h} <a href='/?a=1&b=2'>y</a></p></article></body></html>"
    rows = [{"page_id": i, "url": "https://e.com/", "html": page(h)} for i, h in enumerate(heads)] + [{"page_id": 9, "url": "https://e.com/", "html": "<title>k &amp;&amp</title><p>z"}]
    got = against_sql(spark, tmp_path, "articles_of_pages", pages=rows)
    assert {r["title"] for r in got} >= {"a &&amp", "k &amp;&amp"}


def test_revisits_within_a_second_of_the_interval(spark, tmp_path):
    edge = datetime(2024, 1, 19)
    around = [timedelta(microseconds=n) for n in (-1, 0, 1, 500_000, 999_999, 1_000_000, 1_000_001)]
    rows = [{"event_id": 11 + 70 * i, "ts": edge + d} for i, d in enumerate(around)]
    got = against_sql(spark, tmp_path, "revisits_due", events=rows)
    assert [r["again"] for r in sorted(got)] == [True] * 5 + [False] * 2
