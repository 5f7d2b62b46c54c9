"""Merging: the acceptance cases, and equality with a sequential fold on random records."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from obsidra.operators import merge, series

SCHEMA = "entity string, fields map<string,string>, cleared array<string>, at long, sequence long, observation string, delivery_key string, arrival long"


def records(spark, rows):
    made = spark.createDataFrame([(e, f, c, at, seq, o, d, i) for i, (e, f, c, at, seq, o, d) in enumerate(rows)], SCHEMA)
    order = F.struct(F.col("at").alias("observed_at"), F.coalesce("sequence", F.lit(-1)).alias("sequence"), F.col("observation").alias("observation_id"))
    return made.withColumn("order", order).drop("at", "sequence", "observation")


def one(spark, rows):
    r = records(spark, rows)
    return merge.snapshots(r).collect()[0], {h["delivery_key"]: h for h in merge.history(r).collect()}


def test_new_entity_has_version_one(spark):
    s, h = one(spark, [("e", {"a": "1"}, [], 1, None, "o1", "d1")])
    assert s["version"] == 1 and s["fields"] == {"a": "1"} and h["d1"]["status"] == "written"


def test_redelivery_changes_nothing(spark):
    s, h = one(spark, [("e", {"a": "1"}, [], 1, None, "o1", "d1"), ("e", {"a": "2"}, [], 2, None, "o2", "d1")])
    assert s["version"] == 1 and s["fields"] == {"a": "1"} and len(h) == 1


def test_newer_updates_and_partial_keeps_others(spark):
    s, _ = one(spark, [("e", {"a": "1", "b": "1"}, [], 1, None, "o1", "d1"), ("e", {"a": "2"}, [], 2, None, "o2", "d2")])
    assert s["fields"] == {"a": "2", "b": "1"} and s["version"] == 2


def test_clear_competes_as_a_write(spark):
    rows = [("e", {"a": "1"}, [], 1, None, "o1", "d1"), ("e", {}, ["a"], 3, None, "o3", "d2"), ("e", {"a": "2"}, [], 2, None, "o2", "d3")]
    s, h = one(spark, rows)
    assert s["fields"] == {} and s["cleared_fields"] == ["a"] and h["d3"]["status"] == "stale"
    s, _ = one(spark, [*rows, ("e", {"a": "4"}, [], 4, None, "o4", "d4")])
    assert s["fields"] == {"a": "4"} and s["cleared_fields"] == []


def test_late_is_stale_and_mixed_is_partial(spark):
    s, h = one(spark, [("e", {"a": "2"}, [], 2, None, "o2", "d1"), ("e", {"a": "1"}, [], 1, None, "o1", "d2"), ("e", {"a": "1", "b": "1"}, [], 1, None, "o1", "d3")])
    assert h["d2"]["status"] == "stale" and h["d3"]["status"] == "partially_stale" and h["d3"]["applied_fields"] == ["b"] and s["version"] == 3


def test_sequence_decides_equal_times_and_equal_orders_are_stale(spark):
    s, _ = one(spark, [("e", {"a": "1"}, [], 1, 5, "o1", "d1"), ("e", {"a": "2"}, [], 1, 6, "o0", "d2"), ("e", {"a": "3"}, [], 1, None, "o9", "d3")])
    assert s["fields"] == {"a": "2"}
    s, h = one(spark, [("e", {"a": "1"}, [], 1, 5, "o1", "d1"), ("e", {"a": "2"}, [], 1, 5, "o1", "d2")])
    assert s["fields"] == {"a": "1"} and h["d2"]["status"] == "stale"


def test_invalid_records_are_named(spark):
    rows = records(spark, [("e", {"a": "null"}, [], 1, None, "o", "d1"), ("e", {"a": "1"}, ["a"], 1, None, "o", "d2"), ("e", {}, ["a", "a"], 1, None, "o", "d3"), ("", {"a": "1"}, [], 1, None, "o", "d4"), ("e", {"a": "1"}, [], 1, None, "o", "d5")])
    got = {r["delivery_key"]: r["problem"] for r in merge.problems_of(rows).collect()}
    assert got["d1"].startswith("null") and got["d2"].startswith("fields are both") and got["d3"].startswith("cleared") and got["d4"].startswith("key") and got["d5"] is None


def fold(rows):
    state, seen, versions = {}, set(), {}
    for e, f, c, at, seq, o, d in rows:
        if d in seen:
            continue
        seen.add(d)
        versions[e] = versions.get(e, 0) + 1
        rank = (at, -1 if seq is None else seq, o)
        for name, op, value in [*((k, "set", v) for k, v in f.items()), *((k, "clear", None) for k in c)]:
            if (e, name) not in state or rank > state[e, name][0]:
                state[e, name] = (rank, op, value)
    return {k: v[1:] for k, v in state.items()}, versions


def test_equals_a_sequential_fold(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1500):
        names = rng.sample("abcde", rng.randrange(1, 4))
        cut = rng.randrange(len(names) + 1)
        rows.append((f"e{rng.randrange(25)}", {n: str(i) for n in names[:cut]}, names[cut:], rng.randrange(30), rng.choice([None, 1, 2]), f"o{rng.randrange(5)}", f"d{rng.randrange(1000)}"))
    want, versions = fold(rows)
    r = records(spark, rows)
    got = {(x["entity"], x["field"]): (x["op"], x["value"]) for x in merge.field_state(merge.writes(merge.first_deliveries(r))).collect()}
    assert got == want
    assert {x["entity"]: x["version"] for x in merge.snapshots(r).collect()} == versions
    assert merge.state_difference(merge.field_state(merge.writes(merge.first_deliveries(r))), merge.field_state(merge.writes(merge.first_deliveries(r.repartition(3))))).count() == 0


def test_store_survives_restarts_and_failed_commits(spark, tmp_path, monkeypatch):
    from obsidra.sources.stores import EntityStore

    def batch(*rows):
        return spark.createDataFrame(
            [(e, {"v": v}, [], (datetime(2024, 1, 1, 0, n), n, "o"), d, n) for e, v, n, d in rows],
            "entity string, fields map<string,string>, cleared array<string>, order struct<observed_at:timestamp,sequence:long,observation_id:string>, delivery_key string, arrival long",
        )

    state = lambda store: {r["entity"]: r["value"] for r in store.state().collect()}
    path = str(tmp_path / "store")
    assert state(EntityStore(spark, path)) == {}
    EntityStore(spark, path).commit(batch(("a", "1", 1, "d1"), ("c", "1", 1, "d0")))
    again = EntityStore(spark, path)
    again.commit(batch(("a", "9", 9, "d1"), ("b", "2", 2, "d2")))  # d1 is known
    assert state(again) == state(EntityStore(spark, path)) == {"a": "1", "b": "2", "c": "1"}
    assert again.records().count() == 3 and again.delivery("d1").count() == 1
    with monkeypatch.context() as m:
        m.setattr(EntityStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            EntityStore(spark, path).commit(batch(("a", "3", 3, "d3")))
    fresh = EntityStore(spark, path)
    assert state(fresh)["a"] == "1" and fresh.delivery("d3").count() == 0 and fresh.records().count() == 3
    fresh.commit(batch(("a", "4", 4, "d4"), ("a", "4", 4, None)))
    assert state(EntityStore(spark, path))["a"] == "4" and fresh.entities().where("entity = 'a'").first()["version"] == 3


def test_windows_do_not_depend_on_stretches(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.randrange(5000), rng.randrange(300)) for i in range(400)]
    d = spark.createDataFrame(rows, "g int, s long, n long").withColumn("t", F.col("s") + F.col("n"))
    peaks = [{r["g"]: r["peak"] for r in series.max_concurrency(d, ["g"], "s", "t", stretch).collect()} for stretch in (7, 1 << 40)]
    most = {r["g"]: r["most"] for r in series.max_in_window(d, ["g"], "s", 30).collect()}
    for g in (0, 1):
        own = [(s, s + n) for k, s, n in rows if k == g]
        assert peaks[0][g] == peaks[1][g] == max(sum(a <= s < b for a, b in own) for s, _ in own)
        assert most[g] == max(sum(s - 30 < a <= s for a, _ in own) for s, _ in own)
    numbered = series.numbered_rows(d, ["g"], [F.col("s"), F.col("n")], F.floor(F.col("s") / 100), "i", "all").collect()
    for g in (0, 1):
        own = sorted((r for r in numbered if r["g"] == g), key=lambda r: r["i"])
        assert [r["i"] for r in own] == list(range(1, 201)) and [(r["s"], r["n"]) for r in own] == sorted((r["s"], r["n"]) for r in own) and {r["all"] for r in own} == {200}


def store_batch(spark, *rows):
    return spark.createDataFrame(
        [(e, {"v": v}, [], (datetime(2024, 1, 1, n // 60, n % 60), n, "o"), d, n) for e, v, n, d in rows],
        "entity string, fields map<string,string>, cleared array<string>, order struct<observed_at:timestamp,sequence:long,observation_id:string>, delivery_key string, arrival long",
    )


def test_reads_of_one_key_open_one_cut(spark, tmp_path):
    from obsidra.sources.stores import EntityStore

    store = EntityStore(spark, str(tmp_path / "store"), cuts=8)
    assert store.entity_records("e1").count() == 0 and store.delivery("d1").count() == 0 and store.entity_state("e1").count() == 0
    for n in range(3):
        store.commit(store_batch(spark, *[(f"e{k}", str(n), 10 * n + 1, f"d{k}-{n}") for k in range(40)]))
    everything = store.records().inputFiles()
    for rows in (store.entity_records("e7"), store.entity_state("e7"), store.delivery("d7-2")):
        cuts = {f.split("cut=")[1].split("/")[0] for f in rows.inputFiles()}
        assert len(cuts) == 1 and len(rows.inputFiles()) <= 3 < len(everything)
    assert [(r["entity"], r["fields"]["v"]) for r in store.delivery("d7-2").collect()] == [("e7", "2")]
    assert store.entity_state("e7").first()["value"] == "2" and store.entity("e7").first()["version"] == 3 and store.delivery("none").count() == 0
    first = store.entity_history("e7", 2).collect()
    rest = store.entity_history("e7", 2, store.history_cursor(first[-1])).collect()
    assert [r["version"] for r in first + rest] == [3, 2, 1] and {r["status"] for r in first} == {"written"}


def test_runs_are_merged_and_swept(spark, tmp_path, monkeypatch):
    from obsidra.sources import runs
    from obsidra.sources.stores import EntityStore

    monkeypatch.setattr(runs.RunTables.compact, "__defaults__", (2,))
    path = str(tmp_path / "store")
    store = EntityStore(spark, path, cuts=2)
    want = {}
    for n in range(1, 8):
        order = 50 - n if n % 3 == 0 else n * 10
        store.commit(store_batch(spark, *[(f"e{k}", f"{n}", order, f"d{k}-{n}") for k in range(4)], ("e0", "again", 1000, "d0-1")))
        want = {f"e{k}": max([want.get(f"e{k}", (-1, ""))] + [(order, f"{n}")], key=lambda x: x[0]) for k in range(4)}
        if n == 1:
            want["e0"] = max(want["e0"], (order, "1"))
    manifest = store.manifest()
    levels = [sorted(level for _, level in listed) for cuts in manifest.runs.values() for listed in cuts.values()]
    assert all(len(set(x)) == len(x) and max(x) >= 2 for x in levels)  # fan 2: one run a level, as digits of a counter
    assert {r["entity"]: r["value"] for r in store.state().collect()} == {e: v for e, (_, v) in want.items()}
    assert store.records().count() == 28 and store.entity("e0").first()["version"] == 7
    assert store.vacuum(1) > 0 and store.records().count() == 28 and EntityStore(spark, path).entity_history("e1").count() == 7
    assert store.vacuum(1) == 0


def test_objects_by_key(spark, tmp_path):
    from obsidra.sources.stores import ObjectStore

    store = ObjectStore(spark, str(tmp_path / "objects"), cuts=4)
    assert store.table().count() == 0 and store.get("k1").count() == 0
    made = lambda tag: spark.createDataFrame([(f"k{i}", f"id{i}", "s", "m", datetime(2024, 1, 1), f"{tag}{i}", 1, bytearray(b"x")) for i in range(20)], "object_key string, object_id string, source_id string, material_id string, stored_at timestamp, sha256 string, size_bytes bigint, content binary")
    assert store.put(made("a").where("object_key < 'k15'")).count() == 0
    conflicts = store.put(made("b"))
    assert {r["object_key"] for r in conflicts.collect()} == {r["object_key"] for r in made("a").where("object_key < 'k15'").collect()}
    assert store.table().count() == 20 and store.get("k19").first()["sha256"] == "b19" and len({f.split("cut=")[1][0] for f in store.get("k19").inputFiles()}) == 1
    assert store.put(made("b").where("object_key = 'k19'")).count() == 0 and store.generation == 4


def test_migration_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    from obsidra.sources import migration
    from obsidra.sources.stores import EntityStore

    source = EntityStore(spark, str(tmp_path / "source"), cuts=4)
    for n in range(2):
        source.commit(store_batch(spark, *[(f"e{k}", str(n), 10 - n if k % 2 else 10 + n, f"d{k}-{n}") for k in range(12)], *([("e0", "none", 20, None)] if n else [])))
    target = EntityStore(spark, str(tmp_path / "target"), cuts=2)
    assert len(list(migration.migrate(source, target, 1, most_steps=2))) == 2
    with monkeypatch.context() as m:
        m.setattr(EntityStore, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            list(migration.migrate(source, EntityStore(spark, target.path), 1))
    assert migration.verified(source, target).count() > 0
    steps = list(migration.migrate(source, EntityStore(spark, target.path), 1))
    assert sum(map(len, steps)) == 2 and migration.verified(source, target).count() == 0 and target.records().count() == 25
    assert list(migration.migrate(source, target)) == []
    other = EntityStore(spark, str(tmp_path / "other"), cuts=2)
    other.commit(store_batch(spark, ("e1", "x", 5, "own")))
    with pytest.raises(migration.VersionConflict):
        list(migration.migrate(source, other))
