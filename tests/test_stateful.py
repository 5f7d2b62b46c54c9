"""Stateful streams against the batch ledger and a plain store of requests, batch by batch and across restarts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from obsidra.operators import reports
from obsidra.streaming import stateful

START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.ROCKSDB)
    yield spark
    spark.conf.set(name, before)


def fed(spark, tmp_path, schema, batches, stream):
    """Results after each batch; the query is started anew for each of them, on one checkpoint."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        read = spark.readStream.schema(schema).parquet(str(source))
        got = []
        query = stream(read).writeStream.outputMode("update").foreachBatch(lambda d, _: got.extend(d.collect())).option("checkpointLocation", str(out)).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        yield n, got


def test_ledger_equals_the_batch_ledger(rocks, tmp_path):
    rng = random.Random(4)
    schema = "scope string, reservation string, op string, amount double, at timestamp"
    batches, clock = [], 0
    for n in range(4):
        rows = []
        for _ in range(25):
            clock += rng.randrange(20)
            rows.append((rng.choice("ab"), f"r{rng.randrange(n * 8, n * 8 + 14)}", rng.choice(["reserve", "reserve", "settle", "release"]), float(rng.randrange(9)), START + timedelta(seconds=clock)))
        batches.append([*rows, rows[3]])
        clock += 100 * n
    latest = {}
    for n, got in fed(rocks, tmp_path, schema, batches, lambda s: stateful.ledger_stream(s, 120)):
        for r in got:
            latest[r["scope"]] = (r["settled"], r["held"])
        seen = [r for b in batches[: n + 1] for r in b]
        now = max(r[4] for r in seen)  # the watermark after the batch
        want = reports.budget_ledger(rocks.createDataFrame(seen, schema), F.lit(now), 120)
        assert latest == {r["scope"]: (float(r["settled"]), float(r["held"])) for r in want.collect()}


def test_requests_are_answered_once(rocks, tmp_path):
    schema = "key string, request string, op string, fingerprint string, response string, at timestamp"
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [("k", "1", "begin", "f", None, at(0)), ("k", "2", "begin", "f", None, at(1)), ("q", "1", "begin", "x", None, at(1)), ("bad key", "1", "begin", "f", None, at(1))],
        [("k", "1", "complete", None, "done", at(2)), ("k", "3", "begin", "f", None, at(3)), ("k", "4", "begin", "g", None, at(4)), ("q", "1", "release", None, None, at(4)), ("q", "2", "begin", "y", None, at(5))],
        [("k", "5", "begin", "f", None, at(50)), ("q", "3", "begin", "x", None, at(50))],
        [("k", "6", "begin", "g", None, at(101)), ("k", "7", "begin", "g", None, at(102))],
    ]
    want = [
        {("k", "1", "run", None), ("k", "2", "in_progress", None), ("q", "1", "run", None), ("bad key", "1", "invalid", None)},
        {("k", "3", "replayed", "done"), ("k", "4", "conflict", None), ("q", "2", "run", None)},
        {("k", "5", "replayed", "done"), ("q", "3", "conflict", None)},
        {("k", "6", "run", None), ("k", "7", "in_progress", None)},  # what was known is forgotten
    ]
    for n, got in fed(rocks, tmp_path, schema, batches, lambda s: stateful.answered_once(s, 100)):
        assert {tuple(r) for r in got} == want[n], n
