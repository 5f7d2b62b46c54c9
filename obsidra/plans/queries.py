"""Queries over the driver's tables, one or more per operator, and the same results in DuckDB SQL where SQL has them.

``events`` stand for change records, usage, problems and telemetry; ``pages`` for captured web pages; ``documents`` for
materials with text; ``conversations`` for message streams; ``orders`` and its dimensions for runs and items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import documents as docs_
from ..functions import keys, pages, semver, text, times, urls
from ..operators import dedup, joins, merge, packages, paging, predicates, reports, routing, sampling, series, warehouse
from ..session import spread, table
from ..sources import discovery
from .registry import ORACLES, QUERIES, query

# ------------------------------------------------------------------ change records

#: Change records of events: two fields, one of them cleared now and then; four events share a delivery.
RECORDS_SQL = """
records AS (
    SELECT event_id, event_type, ts, event_type || '|{"user_id":"' || user_id || '"}' AS entity,
           CAST(floor(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS VARCHAR) AS k,
           event_id % 7 = 0 AS clears, 'd' || (event_id // 4) AS delivery_key, (event_id * 7919) % 1000003 AS arrival
    FROM events
), accepted AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY arrival) AS rn FROM records) WHERE rn = 1
), writes AS (
    SELECT entity, delivery_key, 'cents' AS field, 'set' AS op, CAST(cents AS VARCHAR) AS value, ts, event_id, arrival FROM accepted
    UNION ALL
    SELECT entity, delivery_key, 'k', CASE WHEN clears THEN 'clear' ELSE 'set' END, CASE WHEN clears THEN NULL ELSE k END, ts, event_id, arrival FROM accepted
), judged AS (
    SELECT *, coalesce(CAST(epoch_us(ts) AS HUGEINT) * 100000000 + event_id > max(CAST(epoch_us(ts) AS HUGEINT) * 100000000 + event_id)
        OVER (PARTITION BY entity, field ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS applied FROM writes
)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    cents = F.floor(F.col("value") * 100).cast("long").cast("string")
    clears = F.col("event_id") % 7 == 0
    return e.select(
        keys.canonical_key(F.col("event_type"), keys.canonical_json({"user_id": F.col("user_id")})).alias("entity"),
        F.when(clears, F.create_map(F.lit("cents"), cents)).otherwise(F.create_map(F.lit("cents"), cents, F.lit("k"), k)).alias("fields"),
        F.when(clears, F.array(F.lit("k"))).otherwise(F.array().cast("array<string>")).alias("cleared"),
        keys.order_key(F.col("ts"), F.lit(None).cast("long"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("order"),
        F.concat(F.lit("d"), F.floor(F.col("event_id") / 4).cast("string")).alias("delivery_key"),
        ((F.col("event_id") * 7919) % 1000003).alias("arrival"),
        "event_type",
    )


@query(f"WITH {RECORDS_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY ts DESC, event_id DESC, arrival) AS n FROM writes)"
       " SELECT entity, max(CASE WHEN field = 'cents' THEN value END) AS cents, max(CASE WHEN field = 'k' THEN value END) AS k, bool_or(op = 'clear') AS k_cleared,"
       " (SELECT count(*) FROM accepted a WHERE a.entity = latest.entity) AS version FROM latest WHERE n = 1 GROUP BY entity")
def entity_snapshot(spark, sf):
    s = merge.snapshots(records(spark, sf))
    return s.select("entity", F.try_element_at("fields", F.lit("cents")).alias("cents"), F.try_element_at("fields", F.lit("k")).alias("k"), (F.size("cleared_fields") > 0).alias("k_cleared"), "version")


@query(f"WITH {RECORDS_SQL}, v AS (SELECT delivery_key, row_number() OVER (PARTITION BY entity ORDER BY arrival) AS version FROM accepted)"
       " SELECT delivery_key, entity, version, count(*) FILTER (applied) AS applied, count(*) FILTER (NOT applied) AS stale,"
       " CASE WHEN count(*) FILTER (NOT applied) = 0 THEN 'written' WHEN count(*) FILTER (applied) > 0 THEN 'partially_stale' ELSE 'stale' END AS status"
       " FROM judged JOIN v USING (delivery_key) GROUP BY ALL")
def entity_history(spark, sf):
    h = merge.history(records(spark, sf))
    return h.select("delivery_key", "entity", F.col("version").cast("long").alias("version"), F.size("applied_fields").cast("long").alias("applied"), F.size("stale_fields").cast("long").alias("stale"), "status")


@query(f"WITH {RECORDS_SQL} SELECT split_part(entity, '|', 1) AS entity_type, count(*) AS writes, count(*) FILTER (NOT applied) AS stale FROM judged GROUP BY 1")
def stale_by_type(spark, sf):
    w = merge.judged(merge.writes(merge.first_deliveries(records(spark, sf))))
    return w.groupBy(keys.canonical_scope(F.col("entity")).alias("entity_type")).agg(F.count(F.lit(1)).alias("writes"), F.count_if(~F.col("applied")).alias("stale"))


@query(f"WITH {RECORDS_SQL} SELECT entity, count(*) AS version FROM accepted GROUP BY entity")
def entity_versions(spark, sf):
    return merge.first_deliveries(records(spark, sf)).groupBy("entity").agg(F.count(F.lit(1)).alias("version"))


@query(f"WITH {RECORDS_SQL}, upto AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_key ORDER BY arrival) AS n FROM records WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1),"
       " latest AS (SELECT entity, cents, row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) AS m FROM upto) SELECT entity, CAST(cents AS VARCHAR) AS cents FROM latest WHERE m = 1")
def state_as_of(spark, sf):
    s = merge.state_as_of(records(spark, sf), F.lit("2024-01-10 00:00:00").cast("timestamp_ntz"))
    return s.where("field = 'cents'").select("entity", F.col("value").alias("cents"))


@query(f"WITH {RECORDS_SQL}, latest AS (SELECT *, row_number() OVER (PARTITION BY entity, field ORDER BY ts DESC, event_id DESC, arrival) AS n FROM writes)"
       " SELECT entity, field, op, value FROM latest WHERE n = 1")
def incremental_merge(spark, sf):
    """Folding two batches gives what one gives."""
    r = records(spark, sf)
    first = F.crc32("delivery_key") % 2 == 0
    old = merge.field_state(merge.writes(merge.first_deliveries(r.where(first))))
    return merge.merged_update(old, r.where(~first)).select("entity", "field", "op", "value")


@query("SELECT 'd' || (event_id // 4) AS delivery_key, min((event_id * 7919) % 1000003) AS arrival, count(*) AS deliveries FROM events GROUP BY 1")
def delivery_dedup(spark, sf):
    r = records(spark, sf)
    return merge.first_deliveries(r).select("delivery_key", "arrival").join(r.groupBy("delivery_key").agg(F.count(F.lit(1)).alias("deliveries")), "delivery_key")


@query("SELECT event_id, (event_id * 7919) % 1000003 > min((event_id * 7919) % 1000003) OVER (PARTITION BY event_id // 4) AS repeated FROM events")
def repeated_deliveries(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.floor(F.col("event_id") / 4).alias("d"), ((F.col("event_id") * 7919) % 1000003).alias("arrival"))
    return dedup.repeated_deliveries(e, "d", "arrival").select("event_id", "repeated")


@query("SELECT user_id, arg_max(event_type, ts) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def latest_per_key(spark, sf):
    return merge.latest_attributes(table(spark, sf, "events"), ["user_id"], "ts", ["event_type"], [])


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, ts) AS event_type, arg_max(CASE WHEN event_type = 'error' THEN event_id END, ts) FILTER (event_type = 'error') AS last_error FROM events GROUP BY user_id")
def url_state_upsert(spark, sf):
    e = table(spark, sf, "events").withColumn("last_error", F.when(F.col("event_type") == "error", F.col("event_id")))
    return merge.latest_attributes(e, ["user_id"], "ts", ["event_type"], ["last_error"])


@query("WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 5 != 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 3 != 0)"
       " SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'extra' WHEN a.o_totalprice = b.o_totalprice THEN 'equal' ELSE 'changed' END AS state FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey")
def full_outer_reconcile(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = o.where("o_orderkey % 3 != 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return dedup.reconcile(o.where("o_orderkey % 5 != 0"), b, ["o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey, 'left' AS side FROM orders WHERE o_orderkey % 5 != 0 AND o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'right' FROM orders WHERE o_orderkey % 3 != 0 AND o_orderkey % 5 = 0")
def symmetric_difference(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey")
    return dedup.symmetric_difference(o.where("o_orderkey % 5 != 0"), o.where("o_orderkey % 3 != 0"))


@query("SELECT k, string_agg(origin, ',' ORDER BY origin) AS origins FROM (SELECT DISTINCT o_custkey AS k, 'orders' AS origin FROM orders UNION SELECT c_custkey, 'customer' FROM customer) GROUP BY k")
def key_origins(spark, sf):
    t = {"orders": table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("k"))}
    return dedup.origin_tags(t, "k").select("k", F.array_join("origins", ",").alias("origins"))


# ------------------------------------------------------------------ usage, budgets, problems, runs


def usage_rows(spark, sf):
    return table(spark, sf, "events").select(
        F.col("ts").alias("at"), "event_type", "user_id", "event_id", F.get_json_object("props", "$.k").cast("long").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"), F.floor(F.col("value") * 100).cast("long").alias("cost"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("t"), F.col("user_id") % 5)).alias("task_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("s"), F.col("user_id") % 7)).alias("source_id"),
    )


USAGE = "count(*) AS requests, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(event_id % 50) AS BIGINT) AS output_tokens, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cost"


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, {USAGE} FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def usage_by_day(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return reports.usage(usage_rows(spark, sf).withColumn("day", F.date_format("at", "yyyy-MM-dd")), ["day", "event_type"], at("2024-01-03 00:00:00"), at("2024-01-20 00:00:00"))


@query(f"SELECT CASE WHEN event_id % 3 = 0 THEN 'task:t' || (user_id % 5) WHEN event_id % 2 = 0 THEN 'source:s' || (user_id % 7) ELSE 'platform' END AS scope, {USAGE} FROM events GROUP BY 1")
def usage_by_scope(spark, sf):
    return reports.usage(usage_rows(spark, sf).withColumn("scope", reports.usage_scope(F.col("task_id"), F.col("source_id"))), ["scope"])


@query("SELECT w, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cost FROM (SELECT value, unnest(['day:' || strftime(ts, '%Y-%m-%d'), 'week:' || strftime(ts, '%G-W%V'), 'month:' || strftime(ts, '%Y-%m'), 'total']) AS w FROM events) GROUP BY w")
def budget_window_spend(spark, sf):
    u = usage_rows(spark, sf)
    w = F.explode(F.array(*[series.budget_window(p, F.col("at")) for p in ("day", "week", "month", "total")]))
    return u.select(w.alias("w"), "cost").groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query("SELECT user_id, event_id, spent FROM (SELECT user_id, event_id, CAST(sum(CAST(floor(value * 100) AS BIGINT)) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM events) WHERE spent > 5000")
def running_budget_breach(spark, sf):
    u = usage_rows(spark, sf).withColumn("window", series.budget_window("day", F.col("at")))
    return series.running_spend(u, ["user_id"], "window", ["at", "event_id"], "cost").where("spent > 5000").select("user_id", "event_id", "spent")


@query("WITH e AS (SELECT *, user_id % 20 AS src FROM events WHERE event_type = 'error'), r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY ts, event_id) AS n FROM e)"
       " SELECT src, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen, string_agg(CASE WHEN n <= 3 THEN CAST(event_id AS VARCHAR) END, ',' ORDER BY n) AS samples FROM r GROUP BY src")
def problem_groups(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'").withColumn("src", F.col("user_id") % 20)
    return reports.problem_groups(e, ["src"], "event_id", "ts", 3).select("src", "count", "first_seen", "last_seen", F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS stage, count(*) AS items, max(o_orderdate) AS updated_at FROM orders GROUP BY ALL")
def run_progress(spark, sf):
    return reports.run_progress(table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("stage"), F.col("o_orderdate").alias("updated_at")))


@query("SELECT o_orderpriority AS stage, count(*) FILTER (o_orderstatus = 'O') AS waiting, count(*) FILTER (o_orderstatus = 'P') AS running, count(*) FILTER (o_orderstatus = 'F') AS done,"
       " max(CASE WHEN o_orderstatus = 'O' THEN date_diff('second', o_orderdate, TIMESTAMP '1999-01-01') END) AS oldest_s FROM orders GROUP BY 1")
def queue_metrics(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_orderdate").alias("at"))
    return reports.queue_metrics(o, F.lit("1999-01-01 00:00:00").cast("timestamp_ntz"), ["stage"])


@query("SELECT o_orderpriority AS stage, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS items, count(DISTINCT CASE WHEN o_orderstatus IN ('O', 'P') THEN o_custkey END) AS observations FROM orders GROUP BY 1")
def in_flight_capacity(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "waiting").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return reports.in_flight(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stage"), status.alias("status"), F.col("o_custkey").alias("observation_id")), ["stage"])


@query("SELECT o_orderpriority AS category, count(*) AS outputs FROM (SELECT DISTINCT o_orderpriority, o_custkey FROM orders) GROUP BY 1")
def run_output_summary(spark, sf):
    return reports.output_summary(table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "category"), ["category", "o_custkey"], ["category"])


@query("SELECT event_type, count(*) AS entities FROM events GROUP BY event_type UNION ALL SELECT NULL, count(*) FROM events")
def entity_type_counts(spark, sf):
    return reports.entity_types(table(spark, sf, "events").withColumnRenamed("event_type", "entity_type")).withColumnRenamed("entity_type", "event_type")


@query("SELECT o_custkey, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, arg_max(o_orderpriority, CAST(epoch_us(o_orderdate) AS HUGEINT) * 100000000 + o_orderkey) AS priority FROM orders GROUP BY 1")
def source_seen(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", F.struct("o_orderdate", "o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority"))
    return o.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"), F.max_by("priority", "k").alias("priority"))


@query("SELECT l_orderkey AS report, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_and(l_returnflag = 'A') THEN 'passed' ELSE 'partial' END AS status, count(*) AS cases FROM lineitem GROUP BY 1")
def report_status(spark, sf):
    l = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report"), F.when(F.col("l_returnflag") == "R", "failed").when(F.col("l_returnflag") == "A", "passed").otherwise("skipped").alias("status"))
    return reports.test_status(l, ["report"])


@query("WITH p AS (SELECT p_brand AS source_id, p_type AS entity_type, CASE WHEN p_partkey % 11 = 0 THEN -1 ELSE p_retailprice END AS price, p_size > 25 AS valid FROM part)"
       " SELECT source_id, count(*) AS products, count(*) FILTER (price > 0) AS priced, count(*) FILTER (NOT valid) AS invalid, count(DISTINCT entity_type) AS types, CAST(2 AS BIGINT) AS attribute_names FROM p GROUP BY 1")
def catalog_snapshot(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("source_id"), F.col("p_type").alias("entity_type"), F.when(F.col("p_partkey") % 11 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("price"), (F.col("p_size") > 25).alias("valid"), F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string")).alias("attributes"))
    return reports.catalog_snapshot(p)


# ------------------------------------------------------------------ predicates and routing

CONDITION = {"all": [{"field": "event_type", "op": "in", "value": ["view", "click"]}, {"any": [{"field": "props.k", "op": "gte", "value": 50}, {"not": {"field": "value", "op": "lt", "value": 40}}]}]}


def event_fields() -> predicates.Fields:
    return predicates.Fields({"event_type": F.col("event_type"), "value": F.col("value")}, {"props": F.try_parse_json(F.col("props"))})


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND (CAST(json_extract(props, '$.k') AS DOUBLE) >= 50 OR NOT value < 40)")
def condition_filter(spark, sf):
    return table(spark, sf, "events").where(predicates.condition(CONDITION, event_fields())).select("event_id")


@query("SELECT count(*) AS events, count(*) AS missing_ne, count(*) AS missing_not_in, count(*) AS missing_not_exists, CAST(0 AS BIGINT) AS missing_eq, CAST(0 AS BIGINT) AS missing_lt,"
       " count(*) FILTER (CAST(json_extract(props, '$.k') AS BIGINT) != 5) AS ne, CAST(0 AS BIGINT) AS text_order FROM events")
def condition_missing_semantics(spark, sf):
    p = lambda f, op, v=None: F.count_if(predicates.predicate({"field": f, "op": op, "value": v}, event_fields()))
    return table(spark, sf, "events").agg(
        F.count(F.lit(1)).alias("events"), p("props.none", "ne", 1).alias("missing_ne"), p("props.none", "not_in", [1]).alias("missing_not_in"), p("props.none", "not_exists").alias("missing_not_exists"),
        p("props.none", "eq", 1).alias("missing_eq"), p("props.none", "lt", 1).alias("missing_lt"), p("props.k", "ne", 5).alias("ne"), p("props.k", "gt", "a").alias("text_order"),
    )


STAGES = [
    {"stage_id": "prices", "bindings": [{"source_ids": ["src0", "src1", "src2"], "content_kinds": ["en"]}], "inputs": [{"from": "collect"}]},
    {"stage_id": "news", "bindings": [{"source_ids": ["src2", "src3", "src4"]}], "inputs": [{"from": "collect", "when": {"field": "n_chars", "op": "gte", "value": 1000}}]},
    {"stage_id": "other", "inputs": [{"from": "collect", "select": "unmatched_materials"}]},
    {"stage_id": "archive", "inputs": [{"from": "collect"}]},
]
ROUTED_SQL = "WITH d AS (SELECT *, source IN ('src0', 'src1', 'src2') AND lang = 'en' AS prices, source IN ('src2', 'src3', 'src4') AS news FROM documents)"


def material_columns() -> dict[str, Column]:
    return {"source_id": F.col("source"), "section": F.lit(None).cast("string"), "url": F.lit(None).cast("string"), "media_type": F.lit(None).cast("string"), "content_kind": F.col("lang")}


@query(f"{ROUTED_SQL} SELECT doc_id, 'prices' AS stage_id FROM d WHERE prices UNION ALL SELECT doc_id, 'news' FROM d WHERE news AND n_chars >= 1000 UNION ALL SELECT doc_id, 'other' FROM d WHERE NOT prices AND NOT news UNION ALL SELECT doc_id, 'archive' FROM d")
def route_fanout(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    out = routing.route_materials(d, STAGES, "collect", material_columns(), predicates.Fields({"n_chars": F.col("n_chars")}), "src9", True)
    return out.select("doc_id", "stage_id")


@query(f"{ROUTED_SQL} SELECT doc_id FROM d WHERE NOT prices AND NOT news")
def unmatched_else_branch(spark, sf):
    return routing.unknown_materials(table(spark, sf, "documents").select("doc_id", "source", "lang"), STAGES, material_columns(), "src9").select("doc_id")


@query("SELECT event_id || '#store#0' AS next_key, 'store' AS stage_id FROM events WHERE event_type != 'error' AND value > 50 UNION ALL SELECT event_id || '#review#1', 'review' FROM events WHERE event_type = 'error' UNION ALL SELECT event_id || '#copy#2', 'copy' FROM events")
def route_results(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").cast("string").alias("item_key"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), "value")
    edges = [{"to": "store", "when": {"field": "value", "op": "gt", "value": 50}}, {"to": "review", "select": "problems"}, {"to": "copy", "select": "input_material"}]
    return routing.route_results(e, edges, predicates.Fields({"value": F.col("value")})).select("next_key", "stage_id")


@query("SELECT page_id, CASE WHEN NOT (url LIKE 'http%') THEN 'scheme' WHEN NOT regexp_matches(url, '^https?://([^/:?#]*\\.)?example\\.(com|net)([/:?#]|$)') THEN 'host' WHEN NOT regexp_matches(url, '^https?://[^/]*/(en|fr)') THEN 'path outside path_prefixes' WHEN url LIKE '%utm_source=%' THEN 'matches scope.exclude' END AS reason FROM pages")
def scope_check(spark, sf):
    rules = {"allowed_domains": ["example.com", "example.net"], "include_subdomains": True, "path_prefixes": ["/en", "/fr"], "exclude": [{"type": "regex", "value": "utm_source="}]}
    reason = predicates.scope_reason(F.col("url"), rules)
    return table(spark, sf, "pages").select("page_id", F.when(F.startswith(reason, F.lit("host")), "host").when(F.startswith(reason, F.lit("scheme")), "scheme").otherwise(reason).alias("reason"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://[^/]*\\.example\\.com/en/[^/]*$')")
def url_glob(spark, sf):
    return table(spark, sf, "pages").where(predicates.url_pattern({"type": "glob", "value": "**.example.com/en/*"}, F.col("url"))).select("page_id").where(F.col("page_id").isNotNull())


ROBOTS = "User-agent: *\nDisallow: /\n\nUser-agent: ObsBot\nDisallow: /en/\nAllow: /en/7\nDisallow: /*.html$\nCrawl-delay: 2\nSitemap: https://a.example.com/s.xml\n"


@query("SELECT page_id, CASE WHEN regexp_matches(p, '^/en/7') THEN CASE WHEN regexp_matches(p, '\\.html$') THEN false ELSE true END WHEN regexp_matches(p, '^/en/') OR regexp_matches(p, '\\.html$') THEN false ELSE true END AS allowed"
       " FROM (SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://[^/]*', '') AS p FROM pages)")
def robots_allowed(spark, sf):
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("path")) for a, p in predicates.robots_rules(ROBOTS, "ObsBot/1.0")])
    target = F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^https?://[^/]*", "")
    return table(spark, sf, "pages").select("page_id", predicates.robots_allowed(target, rules).alias("allowed"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'")
def stored_within(spark, sf):
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    return table(spark, sf, "events").where(predicates.stored_within(F.col("ts"), at("2024-01-05 00:00:00"), at("2024-01-06 00:00:00"))).select("event_id")


# ------------------------------------------------------------------ joins


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_exists(spark, sf):
    return joins.seen_in_earlier(table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def anti_not_exists(spark, sf):
    found = table(spark, sf, "customer").select("c_custkey", F.lit(0).alias("depth"))
    known = table(spark, sf, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return dedup.admit(found, known, "c_custkey", "depth", F.lit(True), 0).select("c_custkey")


@query("SELECT o_orderkey, c_mktsegment, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 300000")
def inner_projection_view(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 300000").select("o_orderkey", F.col("o_custkey").alias("url"), "o_orderstatus")
    return warehouse.article_analysis(o, table(spark, sf, "customer").select(F.col("c_custkey").alias("url"), "c_mktsegment")).drop("url")


@query("SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 2 = 0 LEFT JOIN region ON n_regionkey = r_regionkey")
def left_projection_view(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("event_id"), "n_name", "n_regionkey")
    s = warehouse.article_with_event(table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("event_id")), n)
    r = table(spark, sf, "region").select(F.col("r_regionkey").alias("event_id"), "r_name")
    return warehouse.article_with_event(s.withColumn("event_id", F.col("n_regionkey")), r).select("s_suppkey", "n_name", "r_name")


@query("SELECT n_name, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def received_bounds(spark, sf):
    history = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("canonical_key"), F.col("o_orderdate").alias("received_at"))
    entities = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("string").alias("canonical_key"), F.col("n_name").alias("scope"))
    return warehouse.received_bounds(history, entities).withColumnRenamed("scope", "n_name")


@query("SELECT d.doc_id, d.source, s.n AS documents FROM documents d JOIN (SELECT source, count(*) AS n FROM documents GROUP BY 1) s ON d.source = s.source")
def dictionary_encode(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    ids = joins.dictionary(d, "source")
    encoded = joins.encode(d, "source", ids)
    counts = encoded.groupBy("id").agg(F.count(F.lit(1)).alias("documents"))
    return encoded.join(counts, "id").select("doc_id", "source", "documents")


@query("WITH m AS (SELECT doc_id, source AS name, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS kind FROM documents), n AS (SELECT name, kind, count(*) AS uses FROM m GROUP BY ALL) SELECT m.doc_id, n.uses FROM m LEFT JOIN n ON m.name IS NOT DISTINCT FROM n.name AND m.kind IS NOT DISTINCT FROM n.kind")
def null_safe_lookup(spark, sf):
    m = table(spark, sf, "documents").select("doc_id", F.col("source").alias("name"), F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("kind"))
    return joins.null_safe_lookup(m, m.groupBy("name", "kind").agg(F.count(F.lit(1)).alias("uses")), ["name", "kind"]).select("doc_id", "uses")


PREFIXES = {"STANDARD": "a", "STANDARD ANODIZED": "b", "ECONOMY": "c", "PROMO BURNISHED": "d"}


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD ANODIZED%' THEN 'b' WHEN p_type LIKE 'PROMO BURNISHED%' THEN 'd' WHEN p_type LIKE 'STANDARD%' THEN 'a' WHEN p_type LIKE 'ECONOMY%' THEN 'c' END AS kind FROM part")
def longest_prefix(spark, sf):
    return table(spark, sf, "part").select("p_partkey", joins.longest_prefix(F.col("p_type"), PREFIXES).alias("kind"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), '(^| )bl') THEN 'bl' WHEN regexp_matches(lower(p_name), '(^| )s') THEN 's' END AS stem FROM part")
def stem_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", joins.stem_match(F.split(F.lower("p_name"), " "), [("bl", "bl"), ("s", "s")]).alias("stem"))


@query("WITH r AS (SELECT o_custkey AS run_id, o_orderpriority AS stage, count(*) FILTER (o_orderstatus = 'P') AS running FROM orders GROUP BY ALL), l AS (SELECT DISTINCT o_orderpriority AS stage, CAST(2 AS BIGINT) AS parallel_limit FROM orders) SELECT run_id, stage, running, parallel_limit - running AS free FROM r JOIN l USING (stage) WHERE parallel_limit > running")
def free_slots(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("stage"), F.when(F.col("o_orderstatus") == "P", "running").otherwise("done").alias("status"))
    return joins.free_slots(o, o.select("stage").distinct().withColumn("parallel_limit", F.lit(2).cast("long"))).select("run_id", "stage", "running", "free")


# ------------------------------------------------------------------ series and windows


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_nearest_rank(spark, sf):
    return series.percentiles(table(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


@query("WITH e AS (SELECT event_type, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 1000000) AS BIGINT) * 60 AS t FROM events), p AS (SELECT event_type, s AS moment, 1 AS c FROM e UNION ALL SELECT event_type, t, -1 FROM e), g AS (SELECT event_type, moment, sum(c) AS c FROM p GROUP BY ALL)"
       " SELECT event_type, CAST(greatest(max(o), 0) AS BIGINT) AS peak FROM (SELECT event_type, sum(c) OVER (PARTITION BY event_type ORDER BY moment) AS o FROM g) GROUP BY 1")
def peak_concurrency(spark, sf):
    e = table(spark, sf, "events").select("event_type", micros(F.col("ts")).alias("s"), F.floor(F.col("value") * 1000000).cast("long").alias("d")).withColumn("t", F.col("s") + F.col("d") * 60)
    return series.max_concurrency(e, ["event_type"], "s", "t")


def micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


@query("SELECT event_type, max(n) AS most FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1")
def max_in_window(spark, sf):
    return series.max_in_window(table(spark, sf, "events").select("event_type", micros(F.col("ts")).alias("us")), ["event_type"], "us", 3_600_000_000)


@query("SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events")
def start_gaps(spark, sf):
    return series.start_gaps(table(spark, sf, "events"), ["user_id"], "ts").select("user_id", "event_id", "gap")


@query("WITH g AS (SELECT user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events), k AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, sum(gap) OVER (PARTITION BY user_id ORDER BY ts ROWS 4 PRECEDING) AS s, least(row_number() OVER w, 5) AS m FROM g WHERE gap IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts))"
       " SELECT user_id, event_id, round(CAST(s AS DOUBLE) / m, 3) AS mean_gap FROM k WHERE i >= 5 OR (n < 5 AND i = n)")
def mean_gaps(spark, sf):
    g = series.start_gaps(table(spark, sf, "events"), ["user_id"], "ts")
    return series.mean_gaps(g, ["user_id"], "ts").select("user_id", "event_id", F.round("mean_gap", 3).alias("mean_gap"))


@query("SELECT user_id, event_id, CASE WHEN b IS NOT NULL THEN greatest(0, t - b) END AS delta FROM (SELECT user_id, event_id, event_id % 1000 AS t, lag(event_id % 1000) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events)")
def counter_delta(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", (F.col("event_id") % 1000).alias("total"))
    return series.counter_rates(e, ["user_id"], "ts", "total").select("user_id", "event_id", "delta")


@query("WITH e AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id FROM e WHERE i IN (0, n - 1) OR i IN (SELECT unnest([CAST(round_even(j * (n - 1) / 10.0, 0) AS BIGINT) for j in range(0, 11)]))")
def downsample(spark, sf):
    return series.downsample(table(spark, sf, "events"), ["ts", "event_id"], 11, ["event_type"]).select("event_type", "event_id")


@query("SELECT conv_id, count(*) AS turns, min(turn) AS first_turn, arg_min(role, turn) AS first_role, count(*) FILTER (repeated) AS repeated_roles FROM (SELECT *, coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS repeated FROM conversations) GROUP BY 1")
def conversation_turns(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    same = F.coalesce(F.col("role") == F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(False))
    return c.withColumn("repeated", same).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.min("turn").alias("first_turn"), F.min_by("role", "turn").alias("first_role"), F.count_if("repeated").alias("repeated_roles"))


@query("SELECT event_id, CAST(least(100 * pow(2.0, greatest(CAST(event_id % 8 AS INTEGER) - 1, 0)), 3000) AS BIGINT) AS ms FROM events")
def backoff(spark, sf):
    return table(spark, sf, "events").select("event_id", series.backoff_ms(F.lit(100.0), F.lit(2.0), F.lit(3000.0), F.col("event_id") % 8).alias("ms"))


# ------------------------------------------------------------------ order, pages, sampling


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 50")
def list_objects_page(spark, sf):
    return paging.page(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), [("o_orderdate", False), ("o_orderkey", False)], 50)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 400000 OR (o_totalprice = 400000 AND o_orderkey > 10) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def keyset_page(spark, sf):
    cursor = paging.encode_cursor([400000, 10])
    return paging.page(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), [("o_totalprice", True), ("o_orderkey", False)], 100, cursor)


@query("WITH s AS (SELECT doc_id, lang || '/' || source AS shape, row_number() OVER (PARTITION BY lang || '/' || source ORDER BY doc_id) AS n FROM documents) SELECT doc_id, shape FROM s ORDER BY n, doc_id LIMIT 150")
def diverse_pick(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "lang", "source").alias("shape"))
    return sampling.pick_diverse(d, "shape", "doc_id", 150)


@query("WITH t AS (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL), s AS (SELECT source, sum(CASE WHEN c < 3 THEN c ELSE 0 END) AS rare, sum(c) AS n, count(*) AS k FROM t GROUP BY 1), r AS (SELECT source, 1.0::DOUBLE - rare::DOUBLE / n AS coverage, n::DOUBLE AS n, 1.0 - (1.0 - 0.9::DOUBLE) / greatest(1, 3 - k + 1) AS lvl FROM s)"
       " SELECT source, round(coverage, 6) AS coverage, round((1.0 - greatest(1.0 - coverage, least(20.0 / (n + 20), 1.0 - pow(1.0 - lvl, 1.0 / n)))) * 0.8, 6) AS confidence FROM r")
def coverage_confidence(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("lang").alias("material_type"), F.lit(0.8).alias("confidence"))
    return sampling.confidence(d, ["source"], 3, F.lit(20), 0.9, 3).select("source", F.round("coverage", 6).alias("coverage"), F.round("confidence", 6).alias("confidence"))


@query("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_suppkey ORDER BY n, q) - 1 AS INTEGER) AS template_id, 'https://e.com/' || lower(s_name[1:8]) || '/' || n || '?q=' || CASE q WHEN 0 THEN 'x%20y' ELSE CAST(s_nationkey AS VARCHAR) END AS url"
       " FROM (SELECT *, unnest(range(1, s_suppkey % 3 + 1)) AS n FROM supplier), (SELECT unnest([0, 1]) AS q)")
def url_template_expand(spark, sf):
    """Pages of each supplier by a template: up to two page numbers, two searches."""
    s = table(spark, sf, "supplier")
    pages_ = F.when(F.col("s_suppkey") % 3 > 0, F.sequence(F.lit(1), (F.col("s_suppkey") % 3).cast("int")))
    values = {"who": F.array(F.lower(F.substring("s_name", 1, 8))), "page": pages_, "q": F.array(F.lit("x y"), F.col("s_nationkey").cast("string"))}
    return discovery.template_rows(s, "https://e.com/{who}/{page}?q={q}", values).select("s_suppkey", "template_id", "url")


# ------------------------------------------------------------------ content, URLs, pages


@query("SELECT text_sha, count(*) AS copies, min(doc_id) AS first_doc FROM (SELECT doc_id, sha256(text) AS text_sha FROM documents) GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", keys.key_digest(F.col("text")).alias("text_sha"))
    return d.groupBy("text_sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query("SELECT event_id, coalesce(event_type != lag(event_type) OVER (PARTITION BY user_id ORDER BY ts), true) AS changed FROM events")
def changed_since_previous(spark, sf):
    return dedup.changed_since_previous(table(spark, sf, "events"), "user_id", "ts", "event_type").select("event_id", "changed")


@query("SELECT page_id, 'web:' || substr(sha256(url), 1, 32) AS material_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page FROM pages")
def page_identity(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", keys.material_id(url).alias("material_id"), urls.host_of(url).alias("host"), F.coalesce(urls.query_param(url, "page"), F.lit("")).alias("page"))


@query("SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/' || regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/'), '[0-9]+\\.html$', '*.html'), '/[0-9]+$', '/*') || CASE WHEN regexp_replace(url, '#.*$', '') LIKE '%?%' THEN '?q' ELSE '' END AS shape FROM pages")
def url_shape(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_shape(F.col("url")).alias("shape"))


@query("SELECT pattern, count(*) AS links FROM (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) || '/' || regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]*', ''), '/'), '[0-9]+\\.html$', '*.html'), '/[0-9]+$', '/*') || coalesce('?' || array_to_string(list_sort(list_distinct([split_part(x, '=', 1) || '=*' for x in string_split(nullif(regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1), ''), '&')])), '&'), '') AS pattern FROM pages) GROUP BY 1")
def link_patterns(spark, sf):
    p = table(spark, sf, "pages").select("url", urls.link_pattern(F.col("url")).alias("pattern"))
    return p.groupBy("pattern").agg(F.count(F.lit(1)).alias("links"))


@query("WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS base, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) AS q FROM pages), n AS (SELECT page_id, lower(regexp_extract(base, '^https?://[^/]*')) || coalesce(nullif(regexp_replace(regexp_replace(base, '^https?://[^/]*', ''), '/+$', ''), ''), '/') AS base, list_sort(list_filter(string_split(q, '&'), lambda x: x != '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref)='))) AS q FROM p)"
       " SELECT page_id, base || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM n")
def url_normalize(spark, sf):
    rules = urls.UrlRules(strip_params=("utm_*", "ref"), trailing_slash="remove")
    return table(spark, sf, "pages").select("page_id", urls.url_normalize(F.col("url"), rules).alias("canonical"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def page_titles(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.title(F.col("html")).alias("title"))


@query("SELECT page_id, pos, href FROM (SELECT page_id, unnest(range(0, len(l))) AS pos, unnest(l) AS href FROM (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<svg\\b[^>]*>.*?</svg\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<template\\b[^>]*>.*?</template\\s*>', ' ', 'g'), '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1) AS l FROM pages))")
def page_hrefs(spark, sf):
    found = pages.link_rows(spread(table(spark, sf, "pages").select("page_id", "html"), "page_id"), "a")
    return found.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query("SELECT page_id, length(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script\\b[^>]*>.*?</script\\s*>|<style\\b[^>]*>.*?</style\\s*>|<svg\\b[^>]*>.*?</svg\\s*>|<noscript\\b[^>]*>.*?</noscript\\s*>|<template\\b[^>]*>.*?</template\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS n FROM pages")
def visible_text_length(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(pages.visible_text(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id, round(coalesce(len(list_filter(['the', 'license', 'en'], lambda w: list_contains(l, w)))::DOUBLE / 3, 0), 6) AS score FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}]+') AS l FROM documents)")
def search_score(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(text.search_score(F.lit("the License en"), F.col("text")), 6).alias("score"))


@query("SELECT p_partkey FROM part WHERE contains(lower(concat_ws(' ', CAST(p_partkey AS VARCHAR), p_name)), 'blue')")
def search_entities(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("canonical_key"), F.struct("p_name").alias("key"), F.struct("p_size").alias("fields"))
    return paging.search_entities(p, "Blue").select("p_partkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS other_found FROM events")
def json_paths(spark, sf):
    doc = F.try_parse_json(F.col("props"))
    _, k = docs_.get_path(doc, "k", "bigint")
    found, _ = docs_.get_path(doc, "none.deeper")
    return table(spark, sf, "events").select("event_id", k.alias("k"), found.alias("other_found"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 5 = 0 THEN '\"bad\"' END AS misfit FROM events")
def extra_capture(spark, sf):
    e = table(spark, sf, "events").withColumn("doc", F.try_parse_json(F.when(F.col("event_id") % 5 == 0, F.lit('{"k":"bad"}')).otherwise(F.col("props"))))
    value, misfit = docs_.typed(F.col("doc"), "k", "bigint")
    return e.select("event_id", value.alias("k"), misfit.alias("misfit"))


@query("SELECT page_id, '_standalone/2024/03/05/web_' || substr(sha256(url), 1, 32) || '/obs' || page_id || '.html' AS object_key FROM pages")
def object_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", keys.object_key(F.lit(None).cast("string"), keys.material_id(F.col("url")), F.concat(F.lit("obs"), F.col("page_id").cast("string")), F.lit("2024-03-05 10:00:00").cast("timestamp_ntz"), F.lit("html")).alias("object_key"))


@query("SELECT package_id, version FROM (SELECT event_type AS package_id, arg_max((k // 20 + 1) || '.' || (k % 20) || '.0' || CASE WHEN event_id % 2 = 0 THEN '-rc.' || (event_id % 13) ELSE '' END, CAST(k AS HUGEINT) * 1000 + CASE WHEN event_id % 2 = 0 THEN event_id % 13 ELSE 500 END) AS version FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1)")
def semver_max(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    pre = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("-rc."), (F.col("event_id") % 13).cast("string"))).otherwise("")
    version = F.concat((F.floor(k / 20) + 1).cast("string"), F.lit("."), (k % 20).cast("string"), F.lit(".0"), pre)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("package_id")).agg(semver.latest(version).alias("version"))


@query("SELECT conv_id, turn, CAST(turn * 1000 + least(s, 999) AS BIGINT) AS sequence FROM (SELECT conv_id, turn, sum(c) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS s, turn // 4 AS sec FROM (SELECT conv_id, turn, CASE WHEN role != lag(role) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)) WHERE false"
       " UNION ALL SELECT conv_id, turn, CAST((turn // 4) * 1000 + least(sum(c) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn), 999) AS BIGINT) FROM (SELECT conv_id, turn, CASE WHEN sha256(role) != lag(sha256(role)) OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) THEN 1 ELSE 0 END AS c FROM conversations)")
def revision_sequence(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("edit_second"), keys.key_digest(F.col("role")).alias("sha"))
    return keys.revision_sequence(c, "conv_id", "edit_second", "sha", "turn").select("conv_id", "turn", F.col("sequence").cast("long").alias("sequence"))


@query("SELECT conv_id, count(*) - 1 AS depth FROM conversations GROUP BY 1 HAVING count(*) > 1")
def message_depth(spark, sf):
    """Longest chain of answers: each message answers the one before it in its conversation."""
    from pyspark.sql import Window

    name = lambda turn: F.concat_ws("/", "conv_id", turn)
    parent = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    c = table(spark, sf, "conversations").select(name("turn").alias("package_id"), F.when(parent.isNotNull(), name(parent)).alias("fork_parent"))
    chains = packages.lineage(c, 64).groupBy("package_id").agg(F.max("distance").alias("d"))
    return chains.groupBy(F.substring_index("package_id", "/", 1).cast("long").alias("conv_id")).agg(F.max("d").cast("long").alias("depth"))


@query("SELECT user_id, event_id, o AS older FROM (SELECT user_id, event_id, rank() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS o FROM events)")
def queue_rank(spark, sf):
    return series.queue_rank(table(spark, sf, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", F.col("older").cast("long").alias("older"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts) AS attempts FROM events WHERE event_type IN ('error', 'view') GROUP BY 1")
def attempts_by_path(spark, sf):
    e = table(spark, sf, "events").where("event_type IN ('error', 'view')").select("user_id", "ts", "event_type")
    return reports.attempts_by_path(e, "user_id", "ts", "event_type").select("user_id", F.array_join("attempts", ",").alias("attempts"))


@query("SELECT c_custkey AS scope, 'total' AS \"window\", CAST(300000 AS DOUBLE) AS \"limit\", round(coalesce(s, 0), 2) AS spent, round(greatest(300000 - coalesce(s, 0), 0), 2) AS \"left\" FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def budget_status(spark, sf):
    budgets = table(spark, sf, "customer").select(F.col("c_custkey").alias("scope"), F.lit("total").alias("window"), F.lit(300000.0).alias("limit"))
    used = table(spark, sf, "orders").select(F.col("o_custkey").alias("scope"), F.lit("total").alias("window"), F.col("o_totalprice").alias("cost"))
    return packages.budget_status(used, budgets).select("scope", "window", "limit", F.round("spent", 2).alias("spent"), F.round("left", 2).alias("left"))


@query("SELECT doc_id, coalesce(nullif(array_to_string(list_slice(list_filter(regexp_split_to_array(translate(lower(source), '_', '-'), '[^a-z0-9]+'), lambda x: x != ''), 1, 4), '-'), ''), '') AS slug, source || ' cut' AS name FROM documents")
def names_and_slugs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.slug(F.col("source"), 4).alias("slug"), text.norm_name(F.concat(F.lit(" «"), F.col("source"), F.lit("»  Cut! "))).alias("name"))


from . import contents, relations  # noqa: E402, F401  they register queries of their own
