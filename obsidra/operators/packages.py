"""Registry of packages: versions, statuses, lineage, updates by three-way merging."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import differences, merge_lines
from ..functions.semver import is_version, latest, sort_key
from ..session import checkpointed

#: A fixed time for archive members (the earliest one a zip can hold).
ARCHIVE_TIME = (1980, 1, 1, 0, 0, 0)


def publishable(versions: DataFrame, published: DataFrame) -> DataFrame:
    """``versions`` with ``problem``: malformed, published already, or null."""
    known = published.select("package_id", "version", F.lit(True).alias("__known")).distinct()
    problem = F.when(~is_version(F.col("version")), "malformed version").when(F.col("__known"), "version exists")
    return versions.join(known, ["package_id", "version"], "left").withColumn("problem", problem).drop("__known")


def current_status(log: DataFrame) -> DataFrame:
    """Latest status of every version."""
    return log.groupBy("package_id", "version").agg(F.max_by("status", "at").alias("status"))


def latest_active(versions: DataFrame, log: DataFrame) -> DataFrame:
    """Highest active version of every package."""
    return versions.join(current_status(log).where("status = 'active'"), ["package_id", "version"], "left_semi").groupBy("package_id").agg(latest(F.col("version")).alias("version"))


def ordered_versions(versions: DataFrame) -> DataFrame:
    return versions.orderBy("package_id", sort_key(F.col("version")))


def lineage(packages: DataFrame, depth: int = 16) -> DataFrame:
    """(package_id, ancestor, distance) over fork parents; each round doubles the known distance."""
    step = packages.where("fork_parent is not null").select("package_id", F.col("fork_parent").alias("ancestor"), F.lit(1).alias("distance"))
    out, reach = step, 1
    while reach < depth:
        longer = out.alias("a").join(out.alias("b"), F.col("a.ancestor") == F.col("b.package_id")).select("a.package_id", "b.ancestor", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        out = checkpointed(out.unionByName(longer).groupBy("package_id", "ancestor").agg(F.min("distance").alias("distance")).where(F.col("distance") <= depth))
        reach *= 2
    return out


def merge_package(base: dict[str, str], ours: dict[str, str], theirs: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Files of a three-way merge and the names in conflict (there ours stays, or the marked text)."""
    out, conflicts = {}, []
    for name in sorted({*base, *ours, *theirs}):
        a, b, c = base.get(name), ours.get(name), theirs.get(name)
        if b == c or c == a:
            value = b
        elif b == a:
            value = c
        elif None in (b, c):
            value = b if b is not None else c
            conflicts.append(name)
        else:
            lines, n = merge_lines((a or "").split("\n"), b.split("\n"), c.split("\n"))
            value = "\n".join(lines)
            if n:
                conflicts.append(name)
        if value is not None:
            out[name] = value
    return out, conflicts


def version_difference(before: dict[str, str], after: dict[str, str]) -> list[tuple[str, str]]:
    """(file, added | removed | changed)."""
    return [(n, "added" if n not in before else "removed" if n not in after else "changed") for n in sorted({*before, *after}) if before.get(n) != after.get(n)]


def manifest_difference(before: dict, after: dict) -> list[tuple]:
    return differences(before, after)


def archive(files: dict[str, bytes]) -> bytes:
    """Zip whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, ARCHIVE_TIME), files[name], zipfile.ZIP_DEFLATED)
    return out.getvalue()


def archive_digest(files: dict[str, bytes]) -> str:
    return "sha256:" + hashlib.sha256(archive(files)).hexdigest()


def unpacked(data: bytes, most_files: int = 1000, most_bytes: int = 64 << 20) -> dict[str, bytes]:
    """Members of a zip; absolute paths, ways out of it, links and too much content are errors."""
    out: dict[str, bytes] = {}
    total = 0
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > most_files:
            raise ValueError("too many files")
        for info in infos:
            path = PurePosixPath(info.filename)
            if path.is_absolute() or ".." in path.parts or "\\" in info.filename or re.match("[A-Za-z]:", info.filename) or (info.external_attr >> 28) == 0xA:
                raise ValueError(f"unsafe path {info.filename!r}")
            total += info.file_size
            if total > most_bytes:
                raise ValueError("too large")
            with z.open(info) as f:
                out[info.filename] = f.read(most_bytes + 1)
    return out


def package_problems(manifest: Column, files: Column) -> Column:
    """Names that a package's manifest refers to and its files lack, and whether tests are there."""
    needed = F.array_except(F.concat(manifest["files"], F.array(manifest["entry_point"])), files)
    tests = F.exists(files, lambda f: F.startswith(f, F.lit("tests/")))
    return F.concat(F.transform(needed, lambda n: F.concat(F.lit("missing file "), n)), F.when(tests, F.array().cast("array<string>")).otherwise(F.array(F.lit("no tests"))))


def budget_status(usage: DataFrame, budgets: DataFrame) -> DataFrame:
    """Spent and left of every budget in its window."""
    spent = usage.groupBy("scope", "window").agg(F.sum("cost").alias("spent"))
    return budgets.join(spent, ["scope", "window"], "left").withColumn("spent", F.coalesce("spent", F.lit(0.0))).withColumn("left", F.greatest(F.col("limit") - F.col("spent"), F.lit(0.0)))
