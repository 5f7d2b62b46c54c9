"""Checks of request traces, plans, contracts and replays."""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import series


def request_interval(requests_per_second: float = 0.0, min_delay_ms: float = 0.0) -> float:
    """Least time between requests to one host, in seconds."""
    return max(1 / requests_per_second if requests_per_second > 0 else 0.0, min_delay_ms / 1000)


def politeness(events: DataFrame, interval_s: float, tolerance_s: float, min_efficiency: float = 0.5, span: int = 5) -> DataFrame:
    """Per host (host, start): gaps, bursts and efficiency of a request trace, and a verdict."""
    gaps = series.start_gaps(events, ["host"], "start")
    fine = gaps.where("gap is not null").groupBy("host").agg(F.min("gap").alias("min_gap"), F.count_if(F.col("gap") < interval_s * 5e5).alias("sub_half_gaps"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY gap)").alias("p50_gap"))
    means = series.mean_gaps(gaps, ["host"], "start", span).groupBy("host").agg(F.min("mean_gap").alias("min_mean_gap"))
    pairs = series.compensated_gaps(gaps, ["host"], "start").groupBy("host").agg(F.min("compensated").alias("min_compensated"))
    moment = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("start").cast("timestamp_ntz"))
    burst = series.max_in_window(events.select("host", moment.alias("us")), ["host"], "us", 1_000_000)
    totals = events.groupBy("host").agg(F.count(F.lit(1)).alias("requests"), F.timestamp_diff("MICROSECOND", F.min("start"), F.max("start")).alias("duration"))
    out = totals.join(burst, "host").join(fine, "host", "left").join(means, "host", "left").join(pairs, "host", "left")
    least, rate = (interval_s - tolerance_s) * 1e6, (F.col("requests") - 1) / (F.col("duration") / 1e6)
    allowed = math.ceil(1 / interval_s) + 1 if interval_s > 0 else 2**31
    failed = (F.col("most") > allowed) | (F.col("min_mean_gap") < least) | (F.col("min_compensated") < least)
    slow = (F.col("min_gap") < least) | (rate < min_efficiency / interval_s if interval_s > 0 else F.lit(False))
    return out.withColumn("rate", rate).withColumn("verdict", F.when(F.coalesce(failed, F.lit(False)), "fail").when(F.coalesce(slow, F.lit(False)), "warn").otherwise("pass"))


def retry_checks(events: DataFrame, max_attempts: int, initial_ms: float, multiplier: float, cap_ms: float, tolerance: float = 0.1) -> DataFrame:
    """Per failing path (path, start, status): attempts, and whether each came after its backoff."""
    from pyspark.sql import Window

    w = Window.partitionBy("path").orderBy("start")
    rows = events.withColumns({"attempt": F.row_number().over(w), "waited": F.timestamp_diff("MICROSECOND", F.lag("start").over(w), F.col("start")) / 1000})
    due = F.least(F.lit(initial_ms) * F.pow(F.lit(multiplier), F.col("attempt") - 2), F.lit(cap_ms)) * (1 - tolerance)
    early = F.coalesce(F.col("waited") < due, F.lit(False))
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(early).alias("early"), F.max_by("status", "start").alias("last_status")).withColumn("ok", (F.col("attempts") <= max_attempts) & (F.col("early") == 0))


def estimated_materials(plan: Mapping[str, Any]) -> int:
    """Pages that a plan's strategies are likely to give: listed seeds, template products, listings times pages."""
    total = 0
    for s in plan.get("strategies", []):
        kind = s.get("type")
        if kind == "seed_list":
            total += len(s.get("urls", []))
        elif kind == "url_template":
            total += math.prod(len(v) for v in s.get("values", {}).values())
        elif kind in ("listing", "api_feed"):
            total += int(s.get("max_pages", 1)) * int(s.get("items_per_page", 1))
        else:
            total += int(s.get("estimate", 0))
    cap = plan.get("max_materials")
    return min(total, cap) if cap is not None else total


def verify_projection(source: DataFrame, target: DataFrame) -> DataFrame:
    """(canonical_key, version, side) that one side of a migration has and the other lacks."""
    a, b = source.select("canonical_key", "version"), target.select("canonical_key", "version")
    return a.exceptAll(b).withColumn("side", F.lit("source")).unionByName(b.exceptAll(a).withColumn("side", F.lit("target")))


def contract_breaks(old: Mapping[str, Any], new: Mapping[str, Any], at: str = "") -> list[tuple[str, str]]:
    """(pointer, what) in which a newer object schema refuses what the older one let pass."""
    out = []
    if old.get("type") and new.get("type") and old["type"] != new["type"]:
        out.append((at or "/", "type changed"))
    before, after = old.get("properties", {}), new.get("properties", {})
    out += [(f"{at}/{name}", "now required") for name in sorted(set(new.get("required", [])) - set(old.get("required", [])))]
    if new.get("additionalProperties", True) is False:
        out += [(f"{at}/{name}", "removed") for name in sorted(set(before) - set(after))]
    if "enum" in new:
        out += [(at or "/", f"value {v!r} removed") for v in old.get("enum", []) if v not in new["enum"]]
    for name in sorted(set(before) & set(after)):
        out += contract_breaks(before[name], after[name], f"{at}/{name}")
    return out


def example_of(schema: Mapping[str, Any]) -> Any:
    """The least instance of a schema: required members only, first values."""
    if "const" in schema:
        return schema["const"]
    if schema.get("enum"):
        return schema["enum"][0]
    kind = schema.get("type", "object")
    if kind == "object":
        return {n: example_of(schema.get("properties", {}).get(n, {"type": "string"})) for n in sorted(schema.get("required", []))}
    if kind == "array":
        return [example_of(schema.get("items", {"type": "string"}))] * int(schema.get("minItems", 0))
    return {"string": "x" * max(1, int(schema.get("minLength", 0))), "integer": int(schema.get("minimum", 0)), "number": float(schema.get("minimum", 0)), "boolean": False, "null": None}[kind]


def sanitized_rules(rules: Mapping[str, Any], domains: list[str]) -> dict[str, Any]:
    """The parts of a proposed rule set that stay on given domains."""
    from urllib.parse import urlsplit

    inside = lambda host: any(host == d or host.endswith("." + d) for d in domains)
    scope = dict(rules.get("scope") or {})
    scope["allowed_domains"] = sorted({d for d in scope.get("allowed_domains", []) if inside(d)} or domains)
    strategies = []
    for s in rules.get("strategies") or []:
        urls = [u for u in s.get("urls", []) if inside(urlsplit(u).hostname or "")]
        if urls or not s.get("urls"):
            strategies.append({**s, **({"urls": urls} if s.get("urls") else {})})
    return {**rules, "scope": scope, "strategies": strategies}


def sample_until(reserve: DataFrame, shape: str, order: str, classify, enough, batch: int, budget: int):
    """Adaptive sampling: picks diverse batches, has them classified, stops when ``enough(counts)`` or at the budget.

    ``classify(df)`` returns (order, material_type); ``enough`` takes {type: count}. Only picked rows reach the driver.
    """
    from .sampling import pick_diverse

    picked: list[Any] = []
    counts: dict[str, int] = {}
    seen: dict[str, int] = {}
    while len(picked) < budget and not enough(counts):
        left = reserve.where(~F.col(order).isin(picked)) if picked else reserve
        prior = reserve.sparkSession.createDataFrame(list(seen.items()), f"{shape} string, count long") if seen else None
        rows = pick_diverse(left, shape, order, min(batch, budget - len(picked)), prior)
        got = classify(rows).collect()
        if not got:
            break
        for r in rows.select(shape).collect():
            seen[r[0]] = seen.get(r[0], 0) + 1
        for key, kind in got:
            picked.append(key)
            counts[kind] = counts.get(kind, 0) + 1
    return counts
