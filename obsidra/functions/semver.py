"""Semantic versions as sortable columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?$"


def is_version(text: Column) -> Column:
    return F.coalesce(text.rlike(PATTERN), F.lit(False))


def sort_key(text: Column) -> Column:
    """A struct that sorts as precedence asks: numbers, a release after its pre-releases, numeric identifiers before others."""
    number = lambda i: F.regexp_extract(text, PATTERN, i).try_cast("decimal(38,0)")
    pre = F.regexp_extract(text, PATTERN, 4)
    parts = F.transform(
        F.split(pre, r"\."),
        lambda p: F.struct((~p.rlike(r"^\d+$")).alias("word"), F.when(p.rlike(r"^\d+$"), p.try_cast("decimal(38,0)")).alias("number"), F.when(~p.rlike(r"^\d+$"), p).alias("text")),
    )
    none = F.slice(parts, 1, 0)
    return F.when(is_version(text), F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (pre == "").alias("release"), F.when(pre == "", none).otherwise(parts).alias("pre")))


def latest(text: Column) -> Column:
    """Aggregate: the highest version."""
    return F.max_by(text, sort_key(text))
