"""Identity expressions: entity, object, delivery and material keys, and the order of observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Source segment of object keys of materials without a source.
NO_SOURCE = "_standalone"
#: File names that one common system reserves.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]
#: Most revisions counted within one second of edits.
MOST_REVISIONS = 999


def key_digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def canonical_json(natural: dict[str, Column]) -> Column:
    """Compact JSON of string members with sorted names."""
    named = [F.coalesce(natural[n].cast("string")).alias(n) for n in sorted(natural)]
    return F.to_json(F.struct(*named), {"ignoreNullFields": "false"})


def canonical_map_json(natural: Column) -> Column:
    """The same for a map column of strings."""
    names = F.array_sort(F.map_keys(natural))
    bare = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    return F.concat(F.lit("{"), F.array_join(F.transform(names, lambda k: F.concat(bare(k), F.lit(":"), bare(natural[k]))), ","), F.lit("}"))


def canonical_key(scope: Column, natural: Column) -> Column:
    """``scope|{"a":"1","b":"2"}``."""
    return F.concat(scope, F.lit("|"), natural)


def canonical_scope(key: Column) -> Column:
    """The scope of a canonical key, which may itself hold bars: all before the last ``|{``."""
    return F.regexp_extract(key, r"^(?s)(.*)\|\{", 1)


def safe_segment(value: Column) -> Column:
    """One path segment that is valid on common file systems."""
    cleaned = F.regexp_replace(F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_"), r"^\.+|\.+$", "")
    cleaned = F.when(cleaned == "", "_").otherwise(cleaned)
    return F.when(F.lower(F.substring_index(cleaned, ".", 1)).isin(RESERVED), F.concat(F.lit("_"), cleaned)).otherwise(cleaned)


def object_key(source_id: Column, material_id: Column, observation_id: Column, fetched_at: Column, extension: Column) -> Column:
    day = F.date_format(fetched_at, "yyyy/MM/dd")
    return F.concat_ws("/", safe_segment(F.coalesce(source_id, F.lit(NO_SOURCE))), day, safe_segment(material_id), F.concat(safe_segment(observation_id), F.lit("."), extension))


def object_id(key: Column) -> Column:
    return F.concat(F.lit("obj_"), F.substring(key_digest(key), 1, 32))


def material_id(url: Column) -> Column:
    return F.concat(F.lit("web:"), F.substring(key_digest(url), 1, 32))


def channel_material_id(channel: Column, message: Column) -> Column:
    return F.concat(F.lit("tg:"), channel.cast("string"), F.lit(":"), message.cast("string"))


def observation_id(*parts: Column) -> Column:
    """A repeatable id of an observation: its time first, so that ids sort as times do."""
    return F.concat(F.lit("obs_"), F.date_format(parts[0], "yyyyMMddHHmmssSSSSSS"), F.substring(key_digest(F.concat_ws("\u0001", *[p.cast("string") for p in parts])), 1, 8))


def entity_delivery_key(delivery: Column, index: Column) -> Column:
    return F.concat(delivery, F.lit("#"), index.cast("string"))


def object_delivery_key(delivery: Column, index: Column, kind: str = "raw") -> Column:
    """The first raw object goes by the key of its call."""
    numbered = F.concat(delivery, F.lit(f"#{kind}"), index.cast("string"))
    return F.when(index == 0, delivery).otherwise(numbered) if kind == "raw" else numbered


def item_key(item: Column, stage: Column, edge: Column) -> Column:
    """Downstream items have keys of their own, equal on every replay."""
    return F.concat_ws("#", item, stage, edge.cast("string"))


def order_key(observed_at: Column, sequence: Column, observation: Column) -> Column:
    """Total order of observations: time, sequence (missing: -1), id."""
    return F.struct(observed_at.alias("observed_at"), F.coalesce(sequence.cast("long"), F.lit(-1)).alias("sequence"), observation.alias("observation_id"))


def build_key(fields: Sequence[tuple[str, Column]]) -> Column:
    """Natural key of the declared fields as canonical JSON; null if one is missing or no scalar."""
    present = F.lit(True)
    for _, value in fields:
        present = present & value.isNotNull()
    return F.when(present, canonical_json(dict(fields)))


def revision_sequence(messages: DataFrame, message: str = "message_id", second: str = "edit_second", digest: str = "sha", arrival: str = "arrival") -> DataFrame:
    """``messages`` with ``sequence``: edit second x 1000 plus the number of content changes within that second."""
    order = Window.partitionBy(message, second).orderBy(arrival)
    changed = (F.col(digest) != F.lag(digest).over(order)).cast("int")
    changes = F.sum(F.coalesce(changed, F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return messages.withColumn("sequence", F.col(second) * 1000 + F.least(changes, F.lit(MOST_REVISIONS)))
