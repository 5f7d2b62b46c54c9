"""Feed intake: materials become items with gap-free sequence numbers, are routed, and move the feed's cursor, all at once.

A micro-batch of a feed is one commit of the store: its new items, what routing made of them, the numbers they took, the
feed's cursor and its epoch are named by one manifest. Before that rename nothing is seen; after it a replay of the
epoch is known by its number and changes nothing. A batch that failed half way is taken again from the start, with the
same numbers: they follow from what was published before.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import first_rows
from ..operators.series import numbered_rows
from ..sources.runs import CUTS, Manifest, RunTables

#: Rows of a batch that one window numbers.
STRETCH = 1 << 20


class Intake(RunTables):
    """Items by observation, in order of arrival, and routed rows by item.

    ``route`` makes routed rows (with ``observation_id``) of items; it must depend on them alone. ``arrival`` numbers the
    materials of a feed as they come; ``cursor`` is what the feed is asked with next, the last row's.
    """

    tables = {"items": ("observation_id", ["observation_id"]), "routed": ("observation_id", ["observation_id"])}

    def __init__(self, spark: SparkSession, path: str, route: Callable[[DataFrame], DataFrame], arrival: str = "arrival", cursor: str = "cursor", cuts: int = CUTS) -> None:
        super().__init__(spark, path, cuts)
        self.route, self.arrival, self.cursor_col = route, arrival, cursor

    def _feed(self, manifest: Manifest, feed: str) -> dict[str, Any]:
        return manifest.facts.setdefault("feeds", {}).setdefault(feed, {"epoch": -1, "cursor": None})

    def accept(self, batch: DataFrame, epoch: int, feed: str = "feed", open_: bool = True) -> int:
        """Takes a micro-batch in; how many items are new. ``open_=False`` (the run no longer accepts) moves the cursor alone.

        An observation that is known, or stands in the batch already, makes no item, but its cursor counts.
        """
        manifest = self.manifest()
        state = self._feed(manifest, feed)
        if epoch <= state["epoch"]:
            return 0
        manifest.number += 1
        last = batch.agg(F.max_by(self.cursor_col, self.arrival).alias("cursor")).first()["cursor"]
        count = 0
        if open_:
            fresh = first_rows(batch.drop(self.cursor_col), ["observation_id"], self.arrival)
            touched = [r[0] for r in batch.select(self.cut(F.col("observation_id"), manifest).alias("c")).distinct().collect()]  # at most all cuts
            known = self.read("items", manifest, touched)
            if known is not None:
                fresh = fresh.join(known.select("observation_id"), "observation_id", "left_anti")
            order = [F.col(self.arrival), F.col("observation_id")]
            items = numbered_rows(fresh.withColumn("feed", F.lit(feed)), ["feed"], order, F.floor(F.col(self.arrival) / STRETCH), "__n")
            start = manifest.facts.get("next", 1)
            items = items.withColumn("sequence", F.col("__n").cast("long") + F.lit(start - 1)).drop("__n")
            written = self.add("items", items, manifest)
            if written:
                items = self.spark.read.schema(items.schema).parquet(*written)
                count = items.count()
                self.add("routed", self.route(items), manifest)
            manifest.facts["next"] = start + count
            self.compact(manifest)
        state["epoch"] = epoch
        state["cursor"] = last if last is not None else state["cursor"]
        self._publish(manifest)
        return count

    def sink(self, feed: str = "feed"):
        """For ``foreachBatch``."""
        return lambda batch, epoch: self.accept(batch, epoch, feed) and None

    def cursor(self, feed: str = "feed") -> Any:
        """Where the feed goes on; None before its first batch."""
        return self._feed(self.manifest(), feed)["cursor"]

    def items(self, after: int = 0, limit: int | None = None) -> DataFrame | None:
        """Items beyond a sequence number, in order; None before the first one."""
        found = self.read("items", self.manifest())
        if found is None:
            return None
        found = found.where(F.col("sequence") > after)
        return found.orderBy("sequence").limit(limit) if limit else found

    def routed(self) -> DataFrame | None:
        return self.read("routed", self.manifest())
