"""Versioned entity state: order-aware last-writer-wins merging of change records.

A change record sets and clears fields of one entity under one order key (observed_at, sequence, observation_id). A
write applies when its key is strictly greater than that of every earlier arrival for the field; otherwise it is stale
and only history keeps it. Versions count accepted deliveries. Records are columns: entity (canonical key), fields
(map<string,string> of JSON values), cleared (array<string>), order (struct), delivery_key, arrival (sortable).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .series import numbered_rows


def problems_of(record: DataFrame) -> DataFrame:
    """``record`` with ``problem``: why it can't be merged, else null."""
    nulls = F.exists(F.map_values("fields"), lambda v: v.isNull() | (v == "null"))
    both = F.size(F.array_intersect(F.coalesce("cleared", F.array().cast("array<string>")), F.map_keys("fields"))) > 0
    twice = F.size("cleared") != F.size(F.array_distinct("cleared"))
    return record.withColumn(
        "problem",
        F.when(F.col("fields").isNull(), "fields must be an object")
        .when(nulls, "null is not a value")
        .when(both, "fields are both set and cleared")
        .when(twice, "cleared contains duplicates")
        .when(F.coalesce(F.col("entity"), F.lit("")) == "", "key is required"),
    )


def first_deliveries(records: DataFrame, key: str = "delivery_key", arrival: str = "arrival") -> DataFrame:
    """The first arrival of every delivery; records without a key are deliveries of their own.

    Aggregated per key before the shuffle, whatever a key's frequency.
    """
    keyed = records.where(F.col(key).isNotNull())
    first = keyed.groupBy(F.col(key).alias("__key")).agg(F.min_by(F.struct(*records.columns), F.col(arrival)).alias("r")).select("r.*")
    return first.unionByName(records.where(F.col(key).isNull()))


def writes(records: DataFrame) -> DataFrame:
    """One row per field written: entity, field, op (set or clear), value, order, delivery_key, arrival."""
    made = F.concat(
        F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("field"), F.lit("set").alias("op"), e["value"].alias("value"))),
        F.transform(F.coalesce("cleared", F.array().cast("array<string>")), lambda f: F.struct(f.alias("field"), F.lit("clear").alias("op"), F.lit(None).cast("string").alias("value"))),
    )
    return records.select("entity", "order", "delivery_key", "arrival", F.explode(made).alias("w")).select("entity", "w.*", "order", "delivery_key", "arrival")


#: Arrivals that one window takes at most, where they are numbers: longer histories are cut and joined by their bests.
ARRIVALS = 1 << 20


def judged(write_rows: DataFrame) -> DataFrame:
    """Writes with ``applied``: strictly newer than all that arrived before for the field.

    Two passes: the best order of each stretch of arrivals, then the best before each write inside its stretch.
    """
    key = ["entity", "field"]
    rows = write_rows.withColumn("__part", F.floor(F.col("arrival") / ARRIVALS))
    parts = rows.groupBy(*key, "__part").agg(F.max("order").alias("__most"))
    before = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(k).alias(f"__{k}") for k in key], F.col("__part").alias("__p"), F.max("__most").over(before).alias("__earlier"))
    same = (F.col("__part") == F.col("__p")) & F.col("entity").eqNullSafe(F.col("__entity")) & F.col("field").eqNullSafe(F.col("__field"))
    inside = Window.partitionBy(*key, "__part").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(F.max("order").over(inside), F.col("__earlier"))
    joined = rows.join(parts, same)
    return joined.withColumn("applied", best.isNull() | (F.col("order") > best)).select(*write_rows.columns, "applied")


def field_state(write_rows: DataFrame) -> DataFrame:
    """(entity, field, op, value, order) that holds now: the greatest order, its first arrival among equals.

    A plain aggregate, combined before the shuffle: no window and no sort over an entity's history.
    """
    latest = F.max_by(F.struct("op", "value"), F.struct(F.col("order"), (-F.col("arrival")).alias("first")))
    return write_rows.groupBy("entity", "field").agg(latest.alias("s"), F.max("order").alias("order")).select("entity", "field", "s.op", "s.value", "order")


def snapshots(records: DataFrame) -> DataFrame:
    """Current state of every entity: fields, cleared_fields, field_orders, version, updated (last arrival)."""
    accepted = first_deliveries(records)
    state = field_state(writes(accepted))
    fields = state.groupBy("entity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("op") == "set", F.struct("field", "value"))))).alias("fields"),
        F.array_sort(F.collect_list(F.when(F.col("op") == "clear", F.col("field")))).alias("cleared_fields"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "order")))).alias("field_orders"),
    )
    versions = accepted.groupBy("entity").agg(F.count(F.lit(1)).alias("version"), F.max("arrival").alias("updated"))
    return versions.join(fields, "entity", "left")


def history(records: DataFrame) -> DataFrame:
    """One row per accepted delivery: version, applied and stale fields (sorted), status."""
    accepted = first_deliveries(records)
    numbered = numbered_rows(accepted, ["entity"], [F.col("arrival")], F.floor(F.col("arrival") / ARRIVALS), "version")
    fields = judged(writes(accepted)).groupBy("entity", "delivery_key", "arrival").agg(
        F.array_sort(F.collect_list(F.when(F.col("applied"), F.col("field")))).alias("applied_fields"),
        F.array_sort(F.collect_list(F.when(~F.col("applied"), F.col("field")))).alias("stale_fields"),
    )
    none = F.array().cast("array<string>")
    same = F.col("entity").eqNullSafe(F.col("__entity")) & F.col("delivery_key").eqNullSafe(F.col("__delivery_key")) & (F.col("arrival") == F.col("__arrival"))
    return (
        numbered.select("entity", "delivery_key", "arrival", "order", "version")
        .join(fields.select(*[F.col(c).alias(f"__{c}") for c in ("entity", "delivery_key", "arrival")], "applied_fields", "stale_fields"), same, "left")
        .withColumns({"applied_fields": F.coalesce("applied_fields", none), "stale_fields": F.coalesce("stale_fields", none)})
        .withColumn("status", status_of(F.col("applied_fields"), F.col("stale_fields")))
        .drop("__entity", "__delivery_key", "__arrival")
    )


def status_of(applied: Column, stale: Column) -> Column:
    """written, partially_stale or stale."""
    return F.when(F.size(stale) == 0, "written").when(F.size(applied) > 0, "partially_stale").otherwise("stale")


def state_as_of(records: DataFrame, moment: Column) -> DataFrame:
    """Field state from what was observed up to ``moment``."""
    return field_state(writes(first_deliveries(records.where(F.col("order.observed_at") <= moment))))


def merged_update(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Field state after a batch: states and writes are one shape, so folding is the same aggregate again."""
    shape = ["entity", "field", "op", "value", "order", "arrival"]
    old = current.withColumn("arrival", F.lit(-(2**62)).cast("long")).select(*shape)
    return field_state(old.unionByName(writes(first_deliveries(batch)).select(*shape)))


def state_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Fields whose value or operation differs between two field states, with both sides."""
    left = a.select("entity", "field", F.struct("op", "value").alias("left"))
    right = b.select("entity", "field", F.struct("op", "value").alias("right"))
    return left.join(right, ["entity", "field"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))


def latest_attributes(rows: DataFrame, key: list[str], at: str, always: list[str], kept: list[str]) -> DataFrame:
    """Upsert by key: ``always`` columns take the newest row's value, ``kept`` ones the newest value that isn't null."""
    aggs = [F.max_by(c, at).alias(c) for c in always] + [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in kept]
    return rows.groupBy(*key).agg(F.max(at).alias(at), *aggs)
