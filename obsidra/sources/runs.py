"""Tables kept as sorted runs cut by a hash of their key, under one manifest that is replaced by a rename.

A write adds a run: one folder for each cut that it has rows of, sorted by key, so a read of one key opens the files of one
cut only and skips row groups by their bounds. Runs of a cut are merged once there are :data:`FAN` of one level, into one run
of the next: a cut has at most FAN - 1 runs of each level, and every row is rewritten once per level. A commit first
writes all of its runs, then the manifest that names them; what a failed commit left is named by none. One writer a store.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Runs of one level that are merged to one of the next.
FAN = 8
#: Cuts of a new store's tables.
CUTS = 64


@dataclass
class Manifest:
    """Runs by table and cut, each (name, level), the tables' schemas, and facts."""

    number: int = 0
    cuts: int = CUTS
    runs: dict[str, dict[int, list[tuple[str, int]]]] = field(default_factory=dict)
    schemas: dict[str, dict[str, Any]] = field(default_factory=dict)
    #: what a store notes beside its tables, seen together with them
    facts: dict[str, Any] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps({"cuts": self.cuts, "runs": self.runs, "schemas": self.schemas, "facts": self.facts}, separators=(",", ":"))

    @classmethod
    def read(cls, number: int, text: str) -> Manifest:
        d = json.loads(text)
        runs = {t: {int(c): [(n, level) for n, level in listed] for c, listed in cuts.items()} for t, cuts in d["runs"].items()}
        return cls(number, d["cuts"], runs, d["schemas"], d.get("facts", {}))

    def named(self) -> set[tuple[str, str]]:
        return {(t, name) for t, cuts in self.runs.items() for listed in cuts.values() for name, _ in listed}


class RunTables:
    """Tables by (key column, columns runs are sorted by); ``merge`` folds the rows of several runs of a table, by default it keeps all."""

    tables: dict[str, tuple[str, list[str]]] = {}
    merge: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def __init__(self, spark: SparkSession, path: str, cuts: int = CUTS) -> None:
        self.spark, self.path, self.cuts = spark, path.rstrip("/"), cuts

    def _fs(self, *parts: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _names(self, *parts: str) -> list[str]:
        fs, place = self._fs(*parts)
        return [x.getPath().getName() for x in fs.listStatus(place)] if fs.exists(place) else []

    @property
    def generation(self) -> int:
        """Number of the newest commit, as stored; 0 for none."""
        return max((int(n) for n in self._names("commits") if n.isdigit()), default=0)

    def manifest(self, number: int | None = None) -> Manifest:
        number = self.generation if number is None else number
        if not number:
            return Manifest(cuts=self.cuts)
        return Manifest.read(number, self.spark.read.text(f"{self.path}/commits/{number}", wholetext=True).first()[0])

    def _publish(self, manifest: Manifest) -> None:
        fs, new = self._fs("commits", f"_{manifest.number}")
        out = fs.create(new, True)
        out.write(bytearray(manifest.text().encode()))
        out.close()
        if not fs.rename(new, self._fs("commits", str(manifest.number))[1]):
            raise RuntimeError(f"commit {manifest.number} was made by another writer")

    def cut(self, key: Column, manifest: Manifest) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(manifest.cuts)).cast("int")

    def cut_of(self, key: Any, manifest: Manifest) -> int:
        return self.spark.range(1).select(self.cut(F.lit(key), manifest)).first()[0]

    def read(self, table: str, manifest: Manifest, cuts: Iterable[int] | None = None) -> DataFrame | None:
        """All runs of a table, or of some cuts; None where there is no run."""
        held = manifest.runs.get(table, {})
        paths = [f"{self.path}/{table}/{name}/cut={c}" for c in (sorted(held) if cuts is None else cuts) for name, _ in held.get(c, ())]
        return self.spark.read.schema(StructType.fromJson(manifest.schemas[table])).parquet(*paths) if paths else None

    def add(self, table: str, rows: DataFrame, manifest: Manifest, name: str | None = None, level: int = 0) -> list[str]:
        """Writes ``rows`` as a run and names it in ``manifest``; the folders written."""
        key, order = self.tables[table]
        name = name or str(manifest.number)
        place = f"{self.path}/{table}/{name}"
        cut = rows.withColumn("cut", self.cut(F.col(key), manifest)).hint("rebalance", "cut")
        cut.sortWithinPartitions("cut", *order).write.mode("overwrite").partitionBy("cut").parquet(place)
        manifest.schemas[table] = json.loads(rows.schema.json())
        written = [int(n[4:]) for n in self._names(table, name) if n.startswith("cut=")]
        for c in written:
            manifest.runs.setdefault(table, {}).setdefault(c, []).append((name, level))
        return [f"{place}/cut={c}" for c in written]

    def compact(self, manifest: Manifest, fan: int = FAN) -> None:
        """Merges runs until no cut of a table has ``fan`` of one level."""
        for table in manifest.runs:
            for level in range(64):
                full = {c: [r for r in listed if r[1] == level] for c, listed in manifest.runs[table].items()}
                full = {c: listed for c, listed in full.items() if len(listed) >= fan}
                if not full:
                    if all(r[1] <= level for listed in manifest.runs[table].values() for r in listed):
                        break
                    continue
                paths = [f"{self.path}/{table}/{name}/cut={c}" for c, listed in full.items() for name, _ in listed]
                rows = self.spark.read.schema(StructType.fromJson(manifest.schemas[table])).parquet(*paths)
                for c, listed in full.items():
                    manifest.runs[table][c] = [r for r in manifest.runs[table][c] if r not in listed]
                self.add(table, self.merge.get(table, lambda d: d)(rows), manifest, f"{manifest.number}m{level + 1}", level + 1)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes manifests but the newest ``keep`` and the runs that those don't name; how many folders and files went.

        A reader that still uses an older manifest loses its files: keep as many as readers may lag.
        """
        numbers = sorted((int(n) for n in self._names("commits") if n.isdigit()), reverse=True)
        kept = set().union(*[self.manifest(n).named() for n in numbers[:keep]]) if numbers else set()
        gone = [("commits", str(n)) for n in numbers[keep:]]
        gone += [(table, name) for table in self.tables for name in self._names(table) if (table, name) not in kept]
        for parts in gone:
            fs, place = self._fs(*parts)
            fs.delete(place, True)
        return len(gone)
