"""Windows over ordered events: gaps, rates, concurrency, percentiles, budgets, downsampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Microseconds of one stretch of time: no window spans more than one of them.
STRETCH = 3_600_000_000


def _stretched(rows: DataFrame, by: Sequence[str], part: Column, total: Column, name: str) -> DataFrame:
    """``rows`` with their stretch (``__part``), ``total`` over all earlier stretches of the group (``name``) and over all (``__all``).

    Sums of stretches meet in a window with a row for each stretch, rows themselves do not.
    """
    cut = rows.withColumn("__part", part)
    sums = cut.groupBy(*by, "__part").agg(total.alias("__sum"))
    order = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__part").alias("__p"), F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias(name), F.sum("__sum").over(Window.partitionBy(*by)).alias("__all"))
    same = F.col("__part").eqNullSafe(F.col("__p"))
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return cut.join(sums, same).drop("__p", *[f"__{c}" for c in by])


def numbered_rows(rows: DataFrame, by: list[str], order: list[Column], part: Column, name: str, total: str | None = None) -> DataFrame:
    """``rows`` with their number from 1 in ``order`` within a group, in two passes over stretches; ``part`` must rise with the order."""
    cut = _stretched(rows, by, part, F.count(F.lit(1)), "__before")
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order))
    out = cut.withColumn(name, inside + F.col("__before"))
    if total:
        out = out.withColumn(total, F.col("__all"))
    return out.drop("__part", "__before", "__all")


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: Mapping[str, float], bins: int = 1024) -> DataFrame:
    """Nearest-rank percentiles of each group, exact: a pass finds the bin of each rank, another ranks the values of these bins."""
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("__v"))
    bounds = rows.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.count(F.lit(1)).alias("__n"))
    bounds = bounds.select(*[F.col(c).alias(f"__{c}") for c in by], "__low", "__high", "__n")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    place = F.floor((F.col("__v") - F.col("__low")) / F.nullif(F.col("__high") - F.col("__low"), F.lit(0)) * (bins - 1))
    binned = rows.join(bounds, same).drop(*[f"__{c}" for c in by]).withColumn("__bin", F.coalesce(place, F.lit(0)).cast("long"))
    order = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = binned.groupBy(*by, "__bin", "__n").agg(F.count(F.lit(1)).alias("__c")).withColumn("__upto", F.sum("__c").over(order))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.ceil(F.lit(share) * F.col("__n")), F.lit(1)).alias("rank")) for name, share in shares.items()])
    hit = filled.withColumn("__r", F.explode(ranks)).where("__r.rank <= __upto and __r.rank > __upto - __c")
    hit = hit.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__bin").alias("__b"), F.col("__r.name").alias("__name"), (F.col("__r.rank") - F.col("__upto") + F.col("__c")).alias("__rank"))
    values = binned.groupBy(*by, "__bin", "__v").agg(F.count(F.lit(1)).alias("__c")).join(hit, same & (F.col("__bin") == F.col("__b")))
    inside = Window.partitionBy(*by, "__bin", "__name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    found = values.withColumn("__sum", F.sum("__c").over(inside)).where("__sum >= __rank")
    return found.groupBy(*by).agg(*[F.min(F.when(F.col("__name") == name, F.col("__v"))).alias(name) for name in shares])


def start_gaps(events: DataFrame, by: list[str], at: str) -> DataFrame:
    """``events`` with ``gap``: time in microseconds since the start before."""
    return events.withColumn("gap", F.timestamp_diff("MICROSECOND", F.lag(at).over(Window.partitionBy(*by).orderBy(at, *[])), F.col(at)))


def mean_gaps(gaps: DataFrame, by: list[str], order: str, span: int = 5) -> DataFrame:
    """Mean of every ``span`` consecutive gaps; of all of them where there are fewer."""
    inside = Window.partitionBy(*by).orderBy(order)
    whole = Window.partitionBy(*by)
    rows = gaps.where("gap is not null")
    mean, n, k = F.avg("gap").over(inside.rowsBetween(-span + 1, 0)), F.count(F.lit(1)).over(whole), F.row_number().over(inside)
    return rows.withColumns({"mean_gap": mean, "__n": n, "__k": k}).where((F.col("__k") >= span) | (F.col("__n") < span) & (F.col("__k") == F.col("__n"))).drop("__n", "__k")


def compensated_gaps(gaps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each gap's best mean with a neighbour."""
    w = Window.partitionBy(*by).orderBy(order)
    pair = lambda other: (F.col("gap") + other) / 2
    return gaps.where("gap is not null").withColumn("compensated", F.coalesce(F.greatest(pair(F.lag("gap").over(w)), pair(F.lead("gap").over(w))), F.col("gap").cast("double")))


def max_in_window(events: DataFrame, by: list[str], micros: str, width: int) -> DataFrame:
    """Most events in any half-open window of ``width`` microseconds; ``micros``: a long column.

    Events of one instant are counted first. A stretch holds 64 widths and sees the last width of the one before.
    """
    counts = events.groupBy(*by, micros).agg(F.count(F.lit(1)).alias("__c"))
    part = F.floor(F.col(micros) / (64 * width))
    seen = F.when(F.floor((F.col(micros) + width - 1) / (64 * width)) > part, F.array(part, part + 1)).otherwise(F.array(part))
    both = counts.withColumn("__part", F.explode(seen)).withColumn("__own", F.col("__part") == part)
    w = Window.partitionBy(*by, "__part").orderBy(micros).rangeBetween(-(width - 1), 0)
    return both.withColumn("__n", F.sum("__c").over(w)).where("__own").groupBy(*by).agg(F.max("__n").alias("most"))


def max_concurrency(intervals: DataFrame, by: list[str], start: str, end: str, stretch: int = STRETCH) -> DataFrame:
    """Most intervals open at once (numbers, microseconds say); an end comes before a start of the same instant.

    Changes are summed per instant first, so a busy instant is one row; what is open at a stretch's start is a sum of sums.
    """
    edges = intervals.where(F.col(end).isNotNull()).select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("change")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("change")))).alias("e")).select(*by, "e.*")
    steps = _stretched(edges.groupBy(*by, "at").agg(F.sum("change").alias("change")), by, F.floor(F.col("at") / stretch), F.sum("change"), "__before")
    running = F.sum("change").over(Window.partitionBy(*by, "__part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return steps.withColumn("open", running + F.col("__before")).groupBy(*by).agg(F.greatest(F.max("open"), F.lit(0)).alias("peak"))


def counter_rates(samples: DataFrame, by: list[str], at: str, total: str) -> DataFrame:
    """Growth and rate per second of a counter; null without a sample before, never negative."""
    w = Window.partitionBy(*by).orderBy(at)
    before, elapsed = F.lag(total).over(w), F.timestamp_diff("MICROSECOND", F.lag(at).over(w), F.col(at)) / 1e6
    delta = F.when(before.isNotNull(), F.greatest(F.lit(0), F.col(total) - before))
    return samples.withColumn("delta", delta).withColumn("rate", F.when(elapsed > 0, F.col("delta") / elapsed))


def downsample(samples: DataFrame, order: list[str], keep: int, by: list[str] = (), part: Column | None = None) -> DataFrame:
    """``keep`` evenly spaced rows, the first and last among them (index i * (n - 1) / (k - 1), half to even).

    ``part``: stretches that rise with ``order``, by default hours of its first column, a time.
    """
    part = part if part is not None else F.floor(micros(F.col(order[0])) / STRETCH)
    rows = numbered_rows(samples, [*by], [F.col(c) for c in order], part, "__i", "__n").withColumn("__i", F.col("__i") - 1)
    if keep < 2:
        return rows.where(F.col("__i") < keep).drop("__i", "__n")
    wanted = F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / (keep - 1)).cast("long"))
    return rows.where((F.col("__n") <= keep) | F.array_contains(wanted, F.col("__i").cast("long"))).drop("__i", "__n")


def budget_window(period: str, at: Column, run: Column | None = None) -> Column:
    """Counter window of a budget period; ISO weeks go by the ISO year."""
    if period == "day":
        return F.concat(F.lit("day:"), F.date_format(at, "yyyy-MM-dd"))
    if period == "week":
        year = F.date_part(F.lit("YEAROFWEEK"), at)
        return F.concat(F.lit("week:"), F.lpad(year.cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))
    if period == "month":
        return F.concat(F.lit("month:"), F.date_format(at, "yyyy-MM"))
    if period == "total":
        return F.lit("total")
    if period == "run":
        return F.concat(F.lit("run:"), run if run is not None else F.lit(None).cast("string"))
    raise ValueError(f"unknown budget period {period!r}")


def budget_resets(period: str, at: Column) -> Column:
    """When the window ends; null for total and run."""
    unit = {"day": "DAY", "week": "WEEK", "month": "MONTH"}.get(period)
    if unit is None:
        return F.lit(None).cast("timestamp")
    step = {"DAY": "INTERVAL 1 DAY", "WEEK": "INTERVAL 7 DAYS", "MONTH": "INTERVAL 1 MONTH"}[unit]
    return F.date_trunc(unit, at) + F.expr(step)


def running_spend(rows: DataFrame, scope: list[str], window: str, order: list[str], cost: str) -> DataFrame:
    """``rows`` with ``spent``: cost so far within scope and window, in two passes over hours of the first order column."""
    by = [*scope, window]
    cut = _stretched(rows, by, F.floor(micros(F.col(order[0])) / STRETCH), F.sum(cost), "__before")
    w = Window.partitionBy(*by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("spent", F.sum(cost).over(w) + F.col("__before")).drop("__part", "__before", "__all")


def backoff_ms(initial: Column, multiplier: Column, cap: Column, attempt: Column) -> Column:
    """Delay before the next attempt, without jitter."""
    return F.least(initial * F.pow(multiplier, F.greatest(attempt - 1, F.lit(0))), cap).cast("long")


def queue_rank(waiters: DataFrame, host: str, since: str, token: str) -> DataFrame:
    """``waiters`` with the number of older ones."""
    return waiters.withColumn("older", F.rank().over(Window.partitionBy(host).orderBy(since, token)) - 1)


def running_misses(rows: DataFrame, by: list[str], order: str, missed: Column, stop: int) -> DataFrame:
    """Rows up to and including the ``stop``-th miss in a row of each group; those after aren't asked for."""
    w = Window.partitionBy(*by).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(missed, 0).otherwise(1)).over(upto)
    marked = rows.withColumn("__run", run)
    streak = F.sum(F.when(missed, 1).otherwise(0)).over(Window.partitionBy(*by, "__run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    counted = marked.withColumn("__streak", streak)
    ended = F.coalesce(F.max((F.col("__streak") >= stop).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("__ended", ended).where("__ended = 0").drop("__run", "__streak", "__ended")
