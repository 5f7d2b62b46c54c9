"""Moving an entity store to another one: replay of its history by cuts of keys, with progress that survives, and a check.

A step takes the history of some cuts and commits it to the target; which cuts are done is noted by the same commit, so a
step is done as a whole or not at all and a migration that was stopped goes on where it was. Deliveries that the target
knows change nothing. What the target holds already of an entity must be what the source holds first of it: else the
step is refused before anything is written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import field_state, first_deliveries, writes
from .stores import EntityStore

DONE = "migrated_cuts"


class VersionConflict(RuntimeError):
    """Entities that the target knows otherwise than the source."""


def versions(records: DataFrame) -> DataFrame:
    """One row per entity: version, and a digest of its field state."""
    fields = field_state(writes(records)).select("entity", F.struct("field", "op", "value").alias("f"))
    digests = fields.groupBy("entity").agg(F.sha2(F.to_json(F.array_sort(F.collect_list("f"))), 256).alias("state"))
    return records.groupBy("entity").agg(F.count(F.lit(1)).alias("version")).join(digests, "entity", "left")


def conflicts(source: DataFrame, target: DataFrame) -> DataFrame:
    """Entities of which the target holds records that the source doesn't: (entity, records)."""
    return target.join(source.select("entity"), "entity", "left_semi").join(source.select("delivery_key"), "delivery_key", "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("records"))


def migrate(source: EntityStore, target: EntityStore, cuts_at_once: int = 8, most_steps: int | None = None) -> Iterator[list[int]]:
    """Commits the source's history to the target, some cuts a step; yields the cuts of each step done. Exhaust it to migrate all."""
    held = source.manifest()
    done = set(target.manifest().facts.get(DONE, []))
    todo = sorted(set(held.runs.get("history", {})) - done)
    for k in range(0, len(todo), cuts_at_once):
        if most_steps is not None and k // cuts_at_once >= most_steps:
            return
        step = todo[k : k + cuts_at_once]
        rows = source.read("history", held, step)
        if target.generation and target.manifest().runs.get("history"):
            found = conflicts(rows, target.records()).limit(5).collect()
            if found:
                raise VersionConflict(f"the target holds other records of {[r['entity'] for r in found]}")
        done |= set(step)
        target.commit(rows, {DONE: sorted(done)})
        yield step


def verified(source: EntityStore, target: EntityStore) -> DataFrame:
    """Entities that differ: (entity, source_version, target_version, same_state); none after a whole migration."""
    left = versions(first_deliveries(source.records())).select("entity", F.col("version").alias("source_version"), F.col("state").alias("__a"))
    right = versions(first_deliveries(target.records())).select("entity", F.col("version").alias("target_version"), F.col("state").alias("__b"))
    both = left.join(right, "entity", "full_outer").withColumn("same_state", F.col("__a").eqNullSafe(F.col("__b")))
    return both.where(~F.col("source_version").eqNullSafe(F.col("target_version")) | ~F.col("same_state")).drop("__a", "__b")
