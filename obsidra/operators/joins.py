"""Joins by rule: prefixes, stems, aliases, null-safe lookups, dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dictionary(rows: DataFrame, column: str, id_name: str = "id") -> DataFrame:
    """(value, id): ids are 128 bits of the value's SHA-256, equal on every run, so no numbering pass over all values is needed."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().withColumn(id_name, F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 32))


def encode(rows: DataFrame, column: str, table: DataFrame, id_name: str = "id") -> DataFrame:
    """``rows`` with the id of their value, under ``id_name``; a null has none. Whether the table is broadcast follows from its size at run time."""
    return rows.join(table.select(column, F.col(id_name)), column, "left")


def null_safe_lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left lookup in which null equals null."""
    other = table.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in table.columns if c not in keys])
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(other, condition, "left").drop(*[f"__{k}" for k in keys])


def longest_prefix(path: Column, table: Mapping[str, str]) -> Column:
    """Value of the longest prefix of ``path`` in a table of rules; null without one."""
    ordered = sorted(table.items(), key=lambda kv: (-len(kv[0]), kv[0]))
    return F.coalesce(*[F.when(F.startswith(path, F.lit(k)), F.lit(v)) for k, v in ordered]) if ordered else F.lit(None).cast("string")


def longest_prefix_join(rows: DataFrame, path: str, table: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """``rows`` with ``match``, the row of ``table`` with the longest prefix of their path, or null: every row stays.

    Each different path looks up its own prefixes (an equi join), the longest wins.
    """
    parts = F.split(path, separator)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), separator).alias("p"), n.alias("n")))
    paths = rows.select(path).where(F.col(path).isNotNull()).distinct()
    keyed = paths.withColumn("__x", F.explode(prefixes)).select(path, F.col("__x.p").alias("__prefix"), F.col("__x.n").alias("__n"))
    other = table.select(F.col(prefix).alias("__prefix"), F.struct(*table.columns).alias("__match"))
    best = keyed.join(other, "__prefix").groupBy(path).agg(F.max_by("__match", "__n").alias("match"))
    return rows.join(best, path, "left")


def stem_match(words: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Label of the first rule whose stem begins one of the words."""
    return F.coalesce(*[F.when(F.exists(words, lambda w: F.startswith(w, F.lit(stem))), F.lit(label)) for stem, label in rules]) if rules else F.lit(None).cast("string")


def seen_in_earlier(frontier: DataFrame, earlier: DataFrame, url: str = "url") -> DataFrame:
    return frontier.join(earlier.select(url), url, "left_semi")


def free_slots(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Stages of runs whose running items stay below their limit: (run_id, stage, running, free)."""
    running = items.groupBy("run_id", "stage").agg(F.count_if(F.col("status") == "running").alias("running"))
    return running.join(limits, "stage").withColumn("free", F.col("parallel_limit") - F.col("running")).where("free > 0")


def adopt_deferred(deferred: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Frontier entries that an earlier run put off, for the checkpoint of the same state key."""
    return deferred.alias("d").join(checkpoints.alias("c"), F.col("d.state_key") == F.col("c.state_key")).where("d.run_id != c.run_id").select("d.*", F.col("c.run_id").alias("adopted_by"))
