"""Aggregate reports: runs, queues, usage, problems, catalogues, test results, link patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_n(values: Column, order: Column, n: int) -> Column:
    """Aggregate: the first ``n`` values in ``order``. Use on bounded groups; see :func:`samples` for others."""
    return F.transform(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), values.alias("v")))), 1, n), lambda s: s["v"])


def samples(rows: DataFrame, keys: list[str], value: str, order: str, n: int, salts: int = 64) -> DataFrame:
    """(keys, samples): the first ``n`` values of each group, taken in two steps so that no task collects a group."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(order, value), F.lit(salts)))
    rank = F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(order, value))
    few = salted.withColumn("__n", rank).where(F.col("__n") <= n)
    return few.groupBy(*keys).agg(first_n(F.col(value), F.struct(F.col(order), F.col(value)), n).alias("samples"))


def run_progress(items: DataFrame) -> DataFrame:
    return items.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("items"), F.max("updated_at").alias("updated_at"))


def output_summary(writes: DataFrame, identity: list[str], scope: list[str]) -> DataFrame:
    """Distinct outputs, counted by scope."""
    return writes.select(*identity, *[c for c in scope if c not in identity]).distinct().groupBy(*scope).agg(F.count(F.lit(1)).alias("outputs"))


def cost_by_currency(items: DataFrame) -> DataFrame:
    return items.groupBy("currency").agg(F.sum("cost").alias("cost")).orderBy(F.desc("cost"), "currency")


def queue_metrics(items: DataFrame, now: Column, by: list[str]) -> DataFrame:
    """Counts by state and the age of the oldest waiting item in seconds."""
    waiting = F.col("status") == "waiting"
    return items.groupBy(*by).agg(
        F.count_if(waiting).alias("waiting"),
        F.count_if(F.col("status") == "running").alias("running"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.max(F.when(waiting, F.timestamp_diff("SECOND", F.col("at"), now))).alias("oldest_s"),
    )


def in_flight(items: DataFrame, by: list[str]) -> DataFrame:
    busy = F.col("status").isin("waiting", "running")
    return items.groupBy(*by).agg(F.count_if(busy).alias("items"), F.count_distinct(F.when(busy, F.col("observation_id"))).alias("observations"))


def usage_scope(task: Column, source: Column) -> Column:
    """The most specific scope: task, then source, then platform."""
    return F.coalesce(F.concat(F.lit("task:"), task), F.concat(F.lit("source:"), source), F.lit("platform"))


def usage(rows: DataFrame, by: list[str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Requests, tokens and cost within ``since <= at < until``."""
    if since is not None:
        rows = rows.where(F.col("at") >= since)
    if until is not None:
        rows = rows.where(F.col("at") < until)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost")
    )


def problem_signature(signature: Column, failure: Column, codes: Column, status: Column) -> Column:
    """An unrecognised page's signature, else the kind of failure, else sorted diagnostic codes, else the status."""
    joined = F.array_join(F.array_sort(F.array_distinct(codes)), ",")
    return F.coalesce(
        F.concat(F.lit("unrecognized:"), signature), F.concat(F.lit("failed:"), failure), F.when(F.coalesce(F.size(codes), F.lit(0)) > 0, F.concat(F.lit("diagnostics:"), joined)), F.concat(F.lit("status:"), status)
    )


def problem_groups(rows: DataFrame, by: list[str], sample: str, at: str, n: int = 5) -> DataFrame:
    """Count, first and last time, and the first ``n`` samples of every group."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("count"), F.min(at).alias("first_seen"), F.max(at).alias("last_seen"))
    return counts.join(samples(rows, by, sample, at, n), by)


def reopened(groups: DataFrame, decisions: DataFrame, by: list[str]) -> DataFrame:
    """Groups with their status: the operator's latest decision, but open again if a hit came after ``resolved``."""
    latest = decisions.groupBy(*by).agg(F.max_by("status", "decided_at").alias("decided"), F.max("decided_at").alias("decided_at"))
    again = (F.col("decided") == "resolved") & (F.col("last_seen") > F.col("decided_at"))
    return groups.join(latest, by, "left").withColumn("status", F.when(again | F.col("decided").isNull(), "open").otherwise(F.col("decided"))).drop("decided", "decided_at")


def entity_types(entities: DataFrame) -> DataFrame:
    """Counts per type and in total (null type), in one pass."""
    return entities.rollup("entity_type").agg(F.count(F.lit(1)).alias("entities"))


def state_summary(snapshots: DataFrame) -> DataFrame:
    """Entities, their versions and the last arrival, per type and in total (null type)."""
    return snapshots.rollup("entity_type").agg(F.count(F.lit(1)).alias("entities"), F.sum("version").alias("versions"), F.max("updated").alias("updated"))


def budget_ledger(operations: DataFrame, now: Column, ttl_s: int) -> DataFrame:
    """Per scope: settled and held cost of its reservations (reservation, op, amount, at).

    A reservation counts with what it was settled at; a released one, or one neither settled nor released within ``ttl_s``
    seconds, counts nothing; any other holds what it reserved. Repeated operations count once.
    """
    of = lambda op, c: F.max(F.when(F.col("op") == op, F.col(c)))
    one = operations.groupBy("scope", "reservation").agg(of("reserve", "amount").alias("reserved"), of("reserve", "at").alias("since"), of("settle", "amount").alias("settled"), of("release", "at").isNotNull().alias("released"))
    open_ = F.col("settled").isNull() & ~F.col("released") & (F.timestamp_diff("SECOND", F.col("since"), now) <= ttl_s)
    return one.groupBy("scope").agg(F.coalesce(F.sum("settled"), F.lit(0)).alias("settled"), F.coalesce(F.sum(F.when(open_, F.col("reserved"))), F.lit(0)).alias("held"))


def object_statistics(objects: DataFrame) -> DataFrame:
    return objects.agg(F.count(F.lit(1)).alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def catalog_snapshot(products: DataFrame) -> DataFrame:
    """Stored products per source: total, priced (finite and above zero), schema-invalid, distinct attribute names."""
    priced = amount_valid(F.col("price"))
    names = products.select("source_id", F.explode_outer(F.map_keys("attributes")).alias("name")).groupBy("source_id").agg(F.count_distinct("name").alias("attribute_names"))
    return products.groupBy("source_id").agg(F.count(F.lit(1)).alias("products"), F.count_if(priced).alias("priced"), F.count_if(~F.col("valid")).alias("invalid"), F.count_distinct("entity_type").alias("types")).join(names, "source_id")


def amount_valid(amount: Column) -> Column:
    return F.coalesce(amount.isNotNull() & ~F.isnan(amount) & (amount > 0) & (amount < F.lit(float("inf"))), F.lit(False))


def test_status(results: DataFrame, by: list[str]) -> DataFrame:
    """A report fails with one failed case, passes when all passed."""
    worst = F.max(F.when(F.col("status") == "failed", 2).when(F.col("status") != "passed", 1).otherwise(0))
    return results.groupBy(*by).agg(F.when(worst == 2, "failed").when(worst == 0, "passed").otherwise("partial").alias("status"), F.count(F.lit(1)).alias("cases"))


def latest_per_context(reports: DataFrame, context: list[str], at: str, status: str, package: list[str]) -> DataFrame:
    """The last report of each context, summed up per package."""
    last = reports.groupBy(*package, *context).agg(F.max_by(status, at).alias(status))
    return last.groupBy(*package).agg(F.bool_and(F.col(status) == "passed").alias("all_passed"), F.count(F.lit(1)).alias("contexts"))


def pattern_frequency(links: DataFrame, pattern: str, url: str, examples: int = 3, most: int | None = None) -> DataFrame:
    """Links per pattern with the first examples, most common first."""
    out = links.groupBy(pattern).agg(F.count(F.lit(1)).alias("links")).join(samples(links, [pattern], url, url, examples), pattern)
    out = out.orderBy(F.desc("links"), pattern)
    return out.limit(most) if most else out


def pagination_templates(links: DataFrame, url: str, start: int = 3) -> DataFrame:
    """URL templates in which one number takes two values at least, the smallest of them at most ``start``."""
    head, rest = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1), F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"^https?://[^/?#]*", "")
    # a number stands after = or / and before the end or a separator
    number = r"(?<=[=/])\d{1,5}(?=$|[/&;#?])"
    cut = links.select(head.alias("head"), F.split(rest, number).alias("parts"), F.regexp_extract_all(rest, F.lit(number), F.lit(0)).alias("numbers"))
    put = cut.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.size("numbers") - 1),
                lambda i: F.struct(
                    F.concat(
                        F.col("head"),
                        F.aggregate(
                            F.sequence(F.lit(0), F.size("numbers")),
                            F.lit(""),
                            lambda s, j: F.concat(s, F.get("parts", j), F.when(j == F.size("numbers"), F.lit("")).when(j == i, F.lit("{n}")).otherwise(F.get("numbers", j))),
                        ),
                    ).alias("template"),
                    F.get("numbers", i).cast("int").alias("page"),
                ),
            )
        ).alias("t")
    )
    pages = put.select("t.*").distinct()
    return pages.groupBy("template").agg(F.count(F.lit(1)).alias("pages"), F.min("page").alias("least"), F.max("page").alias("most")).where(f"pages >= 2 and least <= {start}")


def source_times(rows: DataFrame, key: str, at: str, attributes: list[str]) -> DataFrame:
    """First and last time of a source, and its newest attributes that aren't null."""
    newest = [F.max_by(F.col(a), F.when(F.col(a).isNotNull(), F.col(at))).alias(a) for a in attributes]
    return rows.groupBy(key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), *newest)


def migration_survey(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("entities"), F.sum("version").alias("versions"), F.count_distinct(key).alias("keys"))


def attempts_by_path(events: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Ordered events of each key."""
    return events.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(at), F.col(value)))), lambda s: s[value]).alias("attempts"))


def severity(value: Column, threshold: Column, warn: float = 0.9, ceiling: bool = True) -> Column:
    """ok, warn or fail of a value against its threshold."""
    if ceiling:
        return F.when(value > threshold, "fail").when(value > threshold * warn, "warn").otherwise("ok")
    return F.when(value < threshold, "fail").when(value < threshold / warn, "warn").otherwise("ok")


def verdict(checks: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """The worst of all checks."""
    rank = F.max(F.when(F.col(status) == "fail", 2).when(F.col(status) == "warn", 1).otherwise(0))
    return checks.groupBy(*by).agg(F.element_at(F.array(F.lit("pass"), F.lit("warn"), F.lit("fail")), rank + 1).alias("verdict"))
