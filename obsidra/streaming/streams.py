"""The same logic over streams: merging by micro-batch, bounded de-duplication, revisions, budgets, windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.predicates import Fields, Resolver
from ..operators.routing import route_materials
from ..sources.stores import EntityStore


def materials_stream(spark, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Captured materials as files arrive; the number of files per trigger bounds what is unacknowledged."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def merge_into(store: EntityStore):
    """For ``foreachBatch``: commits a micro-batch; a replayed one changes nothing, its deliveries are known."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.commit(batch)

    return run


def first_deliveries_stream(stream: DataFrame, key: str, at: str, late: str) -> DataFrame:
    """At most one row of each delivery within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, at: str, width: str, late: str, by: list[str]) -> DataFrame:
    """Counts per window; rows later than the watermark are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count(F.lit(1)).alias("count"))


def routed_stream(stream: DataFrame, stages, collect: str, resolver: Resolver, fields: Fields, task_source: str, forward_unknown: bool) -> DataFrame:
    """Routing is stateless, so it is the batch operator."""
    return route_materials(stream, stages, collect, resolver, fields, task_source, forward_unknown)


def revisions_stream(stream: DataFrame, key: str = "material_id", second: str = "edit_second", sha: str = "sha") -> DataFrame:
    """New revisions of edited messages with their sequence; unchanged content is not passed on again."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, count, last = state.get if state.exists else (-1, 0, "")
        out = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                moment, digest = getattr(row, second), getattr(row, sha)
                if moment == at and digest == last:
                    continue
                count = min(count + 1, 999) if moment == at else 0
                at, last = int(moment), digest
                out.append((group[0], at * 1000 + count, digest))
        state.update((at, count, last))
        yield pd.DataFrame(out, columns=[key, "sequence", sha])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} string, sequence long, {sha} string", "at long, count long, last string", "append", GroupStateTimeout.NoTimeout)


def budget_stream(stream: DataFrame, limit: float, scope: str = "scope", window: str = "window", cost: str = "cost") -> DataFrame:
    """Every request with whether its scope's budget still holds it: cost is reserved in order of arrival."""

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        out = []
        for batch in batches:
            for value in batch[cost]:
                granted = spent + value <= limit
                spent += value if granted else 0.0
                out.append((*group, float(value), granted, spent))
        state.update((spent,))
        yield pd.DataFrame(out, columns=[scope, window, cost, "granted", "spent"])

    return stream.groupBy(scope, window).applyInPandasWithState(run, f"{scope} string, {window} string, {cost} double, granted boolean, spent double", "spent double", "append", GroupStateTimeout.NoTimeout)


def acknowledged(rows: DataFrame, seq: str, upto: Column) -> DataFrame:
    """Rows of an ordered buffer that are still to be handled."""
    return rows.where(F.col(seq) > upto)
