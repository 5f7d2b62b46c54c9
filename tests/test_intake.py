"""Intake of a feed: numbers without gaps, nothing seen by halves, replays without effect."""

import pytest
from pyspark.sql import functions as F

from obsidra.streaming.intake import Intake

SCHEMA = "observation_id string, section string, arrival long, cursor string"


def routes(items):
    return items.select("observation_id", "sequence", F.explode(F.when(F.col("section") == "news", F.array(F.lit("parse"), F.lit("store"))).otherwise(F.array(F.lit("unknown")))).alias("stage"))


def batch(spark, *rows):
    return spark.createDataFrame([(o, s, a, f"c{a}") for o, s, a in rows], SCHEMA)


def seen(intake):
    return sorted((r["sequence"], r["observation_id"]) for r in intake.items().collect())


def test_batches_are_seen_whole(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "intake")
    intake = Intake(spark, path, routes, cuts=4)
    assert intake.items() is None and intake.cursor() is None
    assert intake.accept(batch(spark, ("o3", "news", 3), ("o1", "x", 1), ("o1", "x", 2)), 0) == 2
    assert seen(intake) == [(1, "o1"), (2, "o3")] and intake.cursor() == "c3"
    assert intake.accept(batch(spark, ("o9", "x", 9)), 0) == 0  # a replay
    second = batch(spark, ("o1", "x", 4), ("o4", "news", 5), ("o5", "x", 6))
    for step in ("items", "routed", "publish"):  # killed before each write
        with monkeypatch.context() as m:
            add = Intake.add
            m.setattr(Intake, "add", lambda self, table, *a, **k: (_ for _ in ()).throw(OSError(step)) if table == step else add(self, table, *a, **k))
            if step == "publish":
                m.setattr(Intake, "_publish", lambda *_: (_ for _ in ()).throw(OSError(step)))
            with pytest.raises(OSError):
                Intake(spark, path, routes, cuts=4).accept(second, 1)
        again = Intake(spark, path, routes)
        assert seen(again) == [(1, "o1"), (2, "o3")] and again.cursor() == "c3" and again.routed().count() == 3
    assert again.accept(second, 1) == 2 and again.cursor() == "c6"
    assert seen(again) == [(1, "o1"), (2, "o3"), (3, "o4"), (4, "o5")]
    assert sorted((r["sequence"], r["stage"]) for r in again.routed().collect()) == [(1, "unknown"), (2, "parse"), (2, "store"), (3, "parse"), (3, "store"), (4, "unknown")]
    assert again.accept(batch(spark, ("o7", "x", 7)), 2, open_=False) == 0 and again.cursor() == "c7" and len(seen(again)) == 4
    assert again.accept(batch(spark, ("o8", "x", 8)), 0, "other") == 1 and again.cursor("other") == "c8" and [r["sequence"] for r in again.items(3, 1).collect()] == [4]


def test_stream_goes_on_after_it_was_killed(spark, tmp_path, monkeypatch):
    source, path = str(tmp_path / "in"), str(tmp_path / "intake")
    batch(spark, *[(f"o{i}", "news", i) for i in range(6)]).coalesce(1).write.parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = stream.writeStream.foreachBatch(Intake(spark, path, routes, cuts=2).sink()).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    with monkeypatch.context() as m:
        m.setattr(Intake, "_publish", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(Exception, match="killed"):
            run()
    batch(spark, *[(f"o{i}", "x", i) for i in range(4, 9)]).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    intake = Intake(spark, path, routes)
    assert seen(intake) == [(i + 1, f"o{i}") for i in range(9)] and intake.routed().count() == 15 and intake.cursor() == "c8"
