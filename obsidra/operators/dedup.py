"""Duplicates and set differences: deliveries, items, URLs, canonicals, revisions, states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def first_rows(rows: DataFrame, key: Sequence[str], arrival: str) -> DataFrame:
    """The first row of each key; a partial aggregate, so a hot key is one row per task."""
    return rows.groupBy(*[F.col(k).alias(f"__{k}") for k in key]).agg(F.min_by(F.struct(*rows.columns), arrival).alias("r")).select("r.*")


def repeated_deliveries(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """``rows`` with ``repeated``: not the first arrival of its delivery.

    Of arrivals at one time the one with the smaller other columns is first, of equal rows any one; rows without a key are
    deliveries of their own.
    """
    others = [c for c in rows.columns if c not in (key, arrival)]
    place = F.struct(arrival, *others)
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n"))
    first = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.min(place).alias("__first"))
    marked = alike.join(first, F.col(key) == F.col("__key"), "left").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n"))))
    later = F.col(key).isNotNull() & ((place > F.col("__first")) | (F.col("__i") > 1))
    return marked.select(*rows.columns, later.alias("repeated"))


def admit(found: DataFrame, known: DataFrame, url: str, arrival: str, in_scope: Column, max_depth: int, depth: str = "depth") -> DataFrame:
    """New URLs of a discovery batch: normalised, in scope, within depth, once each and not known."""
    fresh = found.where(F.col(url).isNotNull() & in_scope & (F.col(depth) <= max_depth))
    return first_rows(fresh, [url], arrival).join(known.select(url), url, "left_anti")


def admit_counters(found: DataFrame, known: DataFrame, url: str, in_scope: Column, max_depth: int, depth: str = "depth") -> DataFrame:
    """What became of a batch: offered, malformed, out of scope, too deep, known, distinct new."""
    marked = found.join(known.select(F.col(url), F.lit(True).alias("__known")).distinct(), url, "left")
    fine = F.col(url).isNotNull()
    deep = F.col(depth) > max_depth
    return marked.agg(
        F.count(F.lit(1)).alias("offered"),
        F.count_if(~fine).alias("malformed"),
        F.count_if(fine & ~in_scope).alias("out_of_scope"),
        F.count_if(fine & in_scope & deep).alias("too_deep"),
        F.count_if(fine & in_scope & ~deep & F.col("__known").isNotNull()).alias("known"),
        F.count_distinct(F.when(fine & in_scope & ~deep & F.col("__known").isNull(), F.col(url))).alias("admitted"),
    )


def redirect_duplicates(captures: DataFrame, known: DataFrame) -> DataFrame:
    """Captures whose redirect target is already in the frontier."""
    return captures.where("final_url != url").join(known.select(F.col("url").alias("final_url")), "final_url", "left_semi")


def canonical_groups(pages: DataFrame, in_scope: Column, arrival: str) -> DataFrame:
    """One page per declared canonical (if in scope, else the page's own URL): the first."""
    target = F.when(F.col("canonical").isNotNull() & in_scope, F.col("canonical")).otherwise(F.col("url"))
    return first_rows(pages.withColumn("target", target), ["target"], arrival)


def canonical_evidence(pages: DataFrame) -> DataFrame:
    """Pages (url, canonical, sha) that declare another URL: content same, different or not_sampled."""
    target = pages.select(F.col("url").alias("canonical"), F.col("sha").alias("target_sha"))
    content = F.when(F.col("target_sha").isNull(), "not_sampled").when(F.col("target_sha") == F.col("sha"), "same").otherwise("different")
    return pages.where("canonical is not null and canonical != url").join(target, "canonical", "left").select("url", "canonical", content.alias("content"))


def canonical_decision(evidence: DataFrame) -> DataFrame:
    """Whether a plan should follow declared canonicals: some agree and none differs."""
    counts = evidence.agg(F.count_if(F.col("content") == "same").alias("same"), F.count_if(F.col("content") == "different").alias("different"), F.count(F.lit(1)).alias("declared"))
    return counts.withColumn("use_canonical", (F.col("same") > 0) & (F.col("different") == 0))


def changed_since_previous(captures: DataFrame, key: str, at: str, sha: str) -> DataFrame:
    """``captures`` with ``changed``: content differs from the observation before (the first counts as changed)."""
    from pyspark.sql import Window

    return captures.withColumn("changed", ~F.col(sha).eqNullSafe(F.lag(sha).over(Window.partitionBy(key).orderBy(at))))


def reconcile(source: DataFrame, target: DataFrame, key: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Per key: missing (in target), extra, changed or equal."""
    a = source.select(*key, F.struct(*compared).alias("a"))
    b = target.select(*key, F.struct(*compared).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")), "equal").otherwise("changed")
    return a.join(b, list(key), "full_outer").select(*key, state.alias("state"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets, with their side."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def origin_tags(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """Keys present in any table, with the sorted names of the tables that hold them."""
    parts = [df.select(key, F.lit(name).alias("origin")) for name, df in sorted(tables.items())]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.distinct().groupBy(key).agg(F.array_sort(F.collect_set("origin")).alias("origins"))


def event_identity(identity: Column, reason: Column) -> Column:
    """Hash of an event's canonical identity, or why there is none."""
    return F.when(reason.isNull(), F.concat(F.lit("ev_"), F.substring(F.sha2(F.to_json(identity), 256), 1, 32)))


def event_key(day: Column, kind: Column, anchor: Column) -> Column:
    return F.concat_ws(":", day.cast("string"), kind, anchor)


def bounded_intake(rows: DataFrame, known: DataFrame, key: str, order: list[Column], room: int) -> tuple[DataFrame, DataFrame]:
    """(queued, spilled): unknown rows in order up to ``room``, and the rest."""
    fresh = rows.join(known.select(key), key, "left_anti").withColumn("__row", F.monotonically_increasing_id())
    # written once: both parts must see the same rows under the same numbers, ties and rows without a key too
    fresh = checkpointed(fresh)
    queued = fresh.orderBy(*order, "__row").limit(room)
    return queued.drop("__row"), fresh.join(queued.select("__row"), "__row", "left_anti").drop("__row")
