"""Stores of objects, entity history and state, and deliveries. One writer per store.

Tables are sorted runs cut by key (:mod:`.runs`): a commit's cost follows its batch, a read of one key opens one cut. A commit
becomes visible when its manifest is named, so a failed one leaves the old state, whoever opens the store next.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import object_id, object_key
from ..operators.dedup import first_rows
from ..operators.merge import field_state, first_deliveries, history, snapshots, writes
from ..operators.paging import clamp_limit, encode_cursor, page
from ..session import checkpointed
from .runs import Manifest, RunTables

OBJECTS = "object_key string, object_id string, source_id string, material_id string, stored_at timestamp, sha256 string, size_bytes bigint, content binary"
ORDER = "struct<observed_at:timestamp,sequence:bigint,observation_id:string>"
STATE = f"entity string, field string, op string, value string, order {ORDER}, arrival bigint"
RECORDS = f"entity string, fields map<string,string>, cleared array<string>, order {ORDER}, delivery_key string, arrival bigint"


def raw_format(param: Column, entry: Column, is_web_page: Column) -> Column:
    """Format of a raw object: as asked, as configured, else html for pages and json for others."""
    return F.coalesce(param, entry, F.when(is_web_page, "html").otherwise("json"))


def raw_objects(materials: DataFrame, extension: Column) -> DataFrame:
    """Object rows of materials (source_id, material_id, observation_id, fetched_at, content)."""
    key = object_key(F.col("source_id"), F.col("material_id"), F.col("observation_id"), F.col("fetched_at"), extension)
    return materials.select(key.alias("object_key"), object_id(key).alias("object_id"), "source_id", "material_id", F.col("fetched_at").alias("stored_at"), F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("bigint").alias("size_bytes"), "content")


def data_object_key(delivery: Column) -> Column:
    return F.concat(F.lit("data/"), F.sha2(delivery, 256), F.lit(".json"))


class ObjectStore(RunTables):
    """Write-once objects by key."""

    tables = {"objects": ("object_key", ["object_key"])}

    def ensure(self) -> None:
        """Makes an empty store if there is none."""
        if not self.generation:
            self._publish(Manifest(1, self.cuts, {}, {"objects": json.loads(self._empty().schema.json())}))

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], OBJECTS)

    def table(self) -> DataFrame:
        found = self.read_runs()
        return found if found is not None else self._empty()

    def read_runs(self, cuts: list[int] | None = None) -> DataFrame | None:
        return RunTables.read(self, "objects", self.manifest(), cuts)

    def put(self, objects: DataFrame) -> DataFrame:
        """Adds what is new and returns the conflicts: known keys with another hash, which are not written.

        Only the cuts that the batch's keys fall into are read, keys and hashes alone.
        """
        self.ensure()
        manifest = self.manifest()
        batch = first_rows(objects.select(*[f.split()[0] for f in OBJECTS.split(", ")]), ["object_key"], "stored_at")
        touched = [r[0] for r in batch.select(self.cut(F.col("object_key"), manifest).alias("c")).distinct().collect()]  # at most all cuts
        known = RunTables.read(self, "objects", manifest, touched)
        if known is None:
            fresh, conflicts = batch, None
        else:
            known = known.select("object_key", F.col("sha256").alias("__sha"))
            met = checkpointed(batch.drop("content").join(known, "object_key").select("object_key", "sha256", F.col("__sha").alias("stored_sha256")))
            conflicts = met.where("sha256 != stored_sha256")
            fresh = batch.join(met.select("object_key"), "object_key", "left_anti").select(*batch.columns)
        manifest.number += 1
        self.add("objects", fresh, manifest)
        self.compact(manifest)
        self._publish(manifest)
        return conflicts if conflicts is not None else batch.limit(0).select("object_key", "sha256", F.col("sha256").alias("stored_sha256"))

    def read(self, ids: list[str]) -> DataFrame:
        return self.table().where(F.col("object_id").isin(ids))

    def get(self, key: str) -> DataFrame:
        """The object of a key: files of one cut are opened."""
        manifest = self.manifest()
        found = self.read_runs([self.cut_of(key, manifest)])
        return (found if found is not None else self._empty()).where(F.col("object_key") == key)

    def list(self, source_id: str | None = None, material_id: str | None = None, since: Any = None, until: Any = None, cursor: str | None = None, limit: int = 100) -> DataFrame:
        rows = self.table().drop("content")
        for column, value in (("source_id", source_id), ("material_id", material_id)):
            if value is not None:
                rows = rows.where(F.col(column) == value)
        if since is not None:
            rows = rows.where(F.col("stored_at") >= F.lit(since))
        if until is not None:
            rows = rows.where(F.col("stored_at") < F.lit(until))
        return page(rows, [("stored_at", False), ("object_id", False)], limit, cursor)


def folded(state_rows: DataFrame) -> DataFrame:
    """One row per entity and field of several runs' states: the greatest order, of equals the earlier commit's."""
    latest = F.max_by(F.struct("op", "value", "arrival"), F.struct(F.col("order"), (-F.col("arrival")).alias("first")))
    return state_rows.groupBy("entity", "field").agg(latest.alias("s"), F.max("order").alias("order")).select("entity", "field", "s.op", "s.value", "order", "s.arrival")


class EntityStore(RunTables):
    """History of change records, the field state folded from them, and known deliveries.

    A commit adds a run of each: its new records, the state folded from them alone, and their delivery keys. Reading the
    state folds the runs, which is the same aggregate again; merging runs makes them few.
    """

    tables = {"history": ("entity", ["entity", "arrival"]), "state": ("entity", ["entity", "field"]), "deliveries": ("delivery_key", ["delivery_key"])}
    merge = {"state": folded}

    def records(self) -> DataFrame:
        """All accepted records of commits that were completed."""
        found = self.read("history", self.manifest())
        if found is None:
            raise ValueError("the store holds no records")
        return found

    def commit(self, batch: DataFrame, facts: dict[str, Any] | None = None) -> DataFrame:
        """Adds new deliveries of a batch and returns the field state after it; a known delivery changes nothing.

        ``facts`` are noted with the commit: they are seen if and only if the batch is.
        """
        manifest = self.manifest()
        manifest.facts.update(facts or {})
        fresh = first_deliveries(batch)
        keys = batch.where("delivery_key IS NOT NULL").select("delivery_key").distinct()
        if manifest.runs.get("deliveries"):
            touched = [r[0] for r in keys.select(self.cut(F.col("delivery_key"), manifest).alias("c")).distinct().collect()]  # at most all cuts
            known = self.read("deliveries", manifest, touched)
            if known is not None:
                fresh = fresh.join(known.select("delivery_key"), "delivery_key", "left_anti").select(*batch.columns)
        manifest.number += 1
        written = self.add("history", fresh, manifest)
        if written:
            fresh = self.spark.read.schema(batch.schema).parquet(*written)
            self.add("state", field_state(writes(fresh)).withColumn("arrival", F.lit(manifest.number).cast("long")), manifest)
            self.add("deliveries", fresh.where("delivery_key IS NOT NULL").select("delivery_key", "entity"), manifest)
            self.compact(manifest)
        self._publish(manifest)
        return self.state()

    def _or_empty(self, found: DataFrame | None, schema: str) -> DataFrame:
        return found if found is not None else self.spark.createDataFrame([], schema)

    def state(self) -> DataFrame:
        return folded(self._or_empty(self.read("state", self.manifest()), STATE)).drop("arrival")

    def entity_records(self, key: str) -> DataFrame:
        """Accepted records of one entity: files of one cut are opened, whatever the store holds."""
        manifest = self.manifest()
        return self._or_empty(self.read("history", manifest, [self.cut_of(key, manifest)]), RECORDS).where(F.col("entity") == key)

    def entity_state(self, key: str) -> DataFrame:
        """Field state of one entity, from its cut."""
        manifest = self.manifest()
        found = self._or_empty(self.read("state", manifest, [self.cut_of(key, manifest)]), STATE)
        return folded(found.where(F.col("entity") == key)).drop("arrival")

    def entities(self) -> DataFrame:
        return snapshots(self.records())

    def entity(self, key: str) -> DataFrame:
        return snapshots(self.entity_records(key))

    def entity_history(self, key: str, limit: int | None = None, cursor: str | None = None) -> DataFrame:
        """Versions of one entity, newest first: a page after ``cursor`` (:meth:`history_cursor` of the last row seen)."""
        return page(history(self.entity_records(key)), [("version", True)], clamp_limit(limit), cursor)

    @staticmethod
    def history_cursor(row: Any) -> str:
        return encode_cursor([row["version"]])

    def delivery(self, key: str) -> DataFrame:
        """The record of a delivery: one cut of the deliveries, then one of the history."""
        manifest = self.manifest()
        listed = self.read("deliveries", manifest, [self.cut_of(key, manifest)])
        first = listed.where(F.col("delivery_key") == key).select("entity").first() if listed is not None else None
        if first is None:
            return self._or_empty(self.read("history", manifest, []), RECORDS).limit(0)
        rows = self.read("history", manifest, [self.cut_of(first[0], manifest)])
        return rows.where((F.col("entity").eqNullSafe(F.lit(first[0]))) & (F.col("delivery_key") == key))
