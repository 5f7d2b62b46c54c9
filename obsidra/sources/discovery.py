"""Where URLs come from: seeds, templates, sitemaps, feeds, JSON APIs, crawled pages, recorded channels."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.documents import find_path, path_steps, safe_xml
from ..functions.urls import UrlRules, expand_template, url_normalize
from ..session import checkpointed
from ..functions.vectors import by_batch

ENTRY = "array<struct<url:string,lastmod:string>>"


def seed_list(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    """Given URLs at depth 0, in order."""
    return spark.createDataFrame([(u, 0, i) for i, u in enumerate(urls)], "url string, depth int, position int")


def template_urls(spark: SparkSession, template: str, values: Mapping[str, Sequence[Any]], most: int | None = None) -> DataFrame:
    """Cross product of a URI template's values, the last variable fastest.

    A row number is decoded into one value of each variable, so the product is a range, not a join.
    """
    total = prod(len(v) for v in values.values())
    rows = spark.range(min(total, most) if most is not None else total)
    columns, below = {}, total
    for name, options in values.items():
        below //= max(1, len(options))
        columns[name] = F.element_at(F.array(*[F.lit(str(o)) for o in options]), (F.floor(F.col("id") / below) % len(options) + 1).cast("int"))
    return rows.withColumns(columns).select("id", *values, expand_template(template, {n: F.col(n) for n in values}).alias("url"))


def template_rows(rows: DataFrame, template: str, values: Mapping[str, Column]) -> DataFrame:
    """``rows`` with ``template_id`` and ``url``: the product of each row's own values (arrays), the last variable fastest.

    A row with an empty or null array gives none. Numbers are decoded into values, so nothing is joined.
    """
    arrays = {n: F.coalesce(F.transform(c, lambda v: v.cast("string")), F.array().cast("array<string>")) for n, c in values.items()}
    held = rows.withColumns({f"__{n}": c for n, c in arrays.items()})
    total = reduce(lambda x, y: x * y, [F.size(f"__{n}") for n in arrays])
    numbered = held.withColumn("__total", total).where("__total > 0").withColumn("template_id", F.explode(F.sequence(F.lit(0), F.col("__total") - 1)))
    below, chosen = F.col("__total"), {}
    for n in arrays:
        below = F.floor(below / F.size(f"__{n}"))
        chosen[n] = F.get(F.col(f"__{n}"), (F.floor(F.col("template_id") / below) % F.size(f"__{n}")).cast("int"))
    return numbered.withColumn("url", expand_template(template, chosen)).select(*rows.columns, "template_id", "url")


def template_count(values: Mapping[str, Sequence[Any]]) -> int:
    """How many URLs a template gives."""
    return prod(len(v) for v in values.values())


def robots_sitemaps(text: Column) -> Column:
    """Sitemap lines of a robots file, once each, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), F.lit(1)), F.trim))


def sitemap_entries(body: Column, most: int | None = None) -> Column:
    """struct<kind, entries, dropped> of a sitemap: urlset, sitemapindex, feed or plain text of URLs."""

    @by_batch(f"struct<kind:string,entries:{ENTRY},dropped:int>")
    def run(raw):
        data = bytes(raw or b"")
        root = safe_xml(data) if data.lstrip()[:1] == b"<" else None
        if root is None:
            lines = [x.strip() for x in data.decode("utf-8", "replace").splitlines()] if data.lstrip()[:1] != b"<" else []
            found = [(x, None) for x in lines if re.match("https?://", x)]
            return ("text" if found else "unknown", found[:most], len(found) - len(found[:most]))
        name = root.tag.rpartition("}")[2]
        if name in ("urlset", "sitemapindex"):
            found = []
            for node in root:
                inner = {c.tag.rpartition("}")[2]: (c.text or "").strip() for c in node}
                if inner.get("loc"):
                    found.append((inner["loc"], inner.get("lastmod")))
        else:
            found = list(feed_links(root))
            name = "feed" if found else "unknown"
        return (name, found[:most], len(found) - len(found[:most]))

    return run(body)


def feed_links(root) -> Iterator[tuple[str, str | None]]:
    """(link, time) of the entries of RSS 2.0, RSS 1.0 and Atom."""
    local = lambda n: n.tag.rpartition("}")[2]
    for item in root.iter():
        if local(item) not in ("item", "entry"):
            continue
        link = guid = None
        rels: dict[str, str] = {}
        time = None
        for c in item:
            text = (c.text or "").strip()
            if local(c) == "link" and c.get("href"):
                rels.setdefault(c.get("rel", "alternate"), c.get("href"))
            elif local(c) == "link" and text:
                link = link or text
            elif local(c) == "guid" and c.get("isPermaLink", "true") != "false" and text.startswith("http"):
                guid = text
            elif local(c) in ("updated", "pubDate", "date", "published"):
                time = time or text or None
        about = next((v for k, v in item.attrib.items() if k.rpartition("}")[2] == "about"), None)
        found = link or guid or about or next((rels[r] for r in ("alternate", "related", "via") if r in rels), None)
        if found:
            yield found, time


def feed_entries(body: Column, most: int | None = None) -> Column:
    """Entries of a feed, all or the first ``most``."""

    @by_batch(ENTRY)
    def run(raw):
        root = safe_xml(bytes(raw or b""))
        return [] if root is None else list(itertools.islice(feed_links(root), most))

    return run(body)


def feed_autodiscovery(page: Column) -> Column:
    """Targets of alternate links of feed types."""
    tags = F.regexp_extract_all(page, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    feeds = F.filter(tags, lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?alternate") & t.rlike(r"(?i)type\s*=\s*[\"']?application/(rss|atom|rdf)\+xml"))
    return F.transform(feeds, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))


def listing_digest(urls: Column) -> Column:
    """Digest of a page's items whatever their order."""
    return F.substring(F.sha2(F.array_join(F.array_sort(urls), "\n"), 256), 1, 32)


def listing_pages(pages: DataFrame, by: str, number: str, urls: str, status: str) -> DataFrame:
    """Pages of a listing up to the first that is empty, repeats the one before, or wasn't answered."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(number)
    marked = pages.withColumn("digest", listing_digest(F.col(urls)))
    stop = (F.size(urls) == 0) | ~F.col(status).between(200, 299) | F.coalesce(F.lag("digest").over(w) == F.col("digest"), F.lit(False))
    return marked.withColumn("__stop", stop).withColumn("__ended", F.max(F.col("__stop").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__ended = 0").drop("__stop", "__ended")


def api_items(body: Column, items_path: str, url_path: str | None = None, lastmod_path: str | None = None) -> Column:
    """array<struct<url, lastmod, item>> of a JSON answer; item is the item's own document."""
    items, url, last = path_steps(items_path), path_steps(url_path) if url_path else None, path_steps(lastmod_path) if lastmod_path else None

    @by_batch("array<struct<url:string,lastmod:string,item:string>>")
    def run(text):
        try:
            document = json.loads(text)
        except (TypeError, ValueError):
            return []
        first = lambda node, steps: next((str(v) for v in find_path(node, steps) if v is not None), None) if steps else None
        found = find_path(document, items)
        rows = found[0] if len(found) == 1 and isinstance(found[0], list) else found
        return [(first(r, url), first(r, last), json.dumps(r, separators=(",", ":"), ensure_ascii=False, sort_keys=True)) for r in rows]

    return run(body)


def partition_bodies(base: Mapping[str, Any], field: str, children: Mapping[str, Sequence[str]], start: Sequence[str], depth: int, most: int) -> list[dict[str, Any]]:
    """Request bodies for a value and its known parts, breadth first, to ``depth`` and ``most`` bodies."""
    out, level, seen = [], list(start), set(start)
    for _ in range(depth + 1):
        out += [{**base, field: v} for v in level]
        level = [c for v in level for c in children.get(v, ()) if not (c in seen or seen.add(c))]
    return out[:most]


def crawl(seeds: DataFrame, links: DataFrame, max_depth: int, rules: UrlRules = UrlRules()) -> DataFrame:
    """(url, depth, parent) reachable from ``seeds`` over a link table (url, target), breadth first to ``max_depth``.

    Each level is checkpointed: the plan doesn't grow, and a lost executor costs one level.
    """
    link = links.select(F.col("url").alias("parent"), url_normalize(F.col("target"), rules).alias("url")).where("url is not null").distinct()
    level = seeds.select(url_normalize(F.col("url"), rules).alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent")).where("url is not null").dropDuplicates(["url"])
    seen = level = checkpointed(level)
    for depth in range(1, max_depth + 1):
        step = link.join(level.select(F.col("url").alias("parent")), "parent").groupBy("url").agg(F.min("parent").alias("parent"))
        level = checkpointed(step.join(seen.select("url"), "url", "left_anti").select("url", F.lit(depth).alias("depth"), "parent"))
        if level.isEmpty():
            break
        seen = checkpointed(seen.unionByName(level))
    return seen


def recorded_channel(spark: SparkSession, path: str) -> DataFrame:
    """Messages of recorded channels (JSON documents with channel and messages), one row each."""
    schema = "channel struct<channel_id:string,username:string,title:string>, messages array<struct<id:bigint,date:string,text:string,edit_date:string,views:bigint,author:string>>, events array<struct<pts:bigint,message:struct<id:bigint,date:string,text:string,edit_date:string,views:bigint,author:string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    history = raw.select("channel.*", F.lit(None).cast("bigint").alias("pts"), F.explode("messages").alias("m"))
    changes = raw.select("channel.*", F.explode("events").alias("e")).select("channel_id", "username", "title", F.col("e.pts").alias("pts"), F.col("e.message").alias("m"))
    return history.unionByName(changes).select("channel_id", "username", "pts", F.col("m.id").alias("message_id"), F.try_to_timestamp("m.date").alias("date"), F.try_to_timestamp("m.edit_date").alias("edit_date"), F.col("m.text").alias("text"), F.col("m.views").alias("views"))


def channel_history(messages: DataFrame, after: int | None = None, since: Any = None) -> DataFrame:
    """Oldest first after an id and since a time."""
    rows = messages.where(F.col("pts").isNull())
    if after is not None:
        rows = rows.where(F.col("message_id") > after)
    if since is not None:
        rows = rows.where(F.col("date") >= F.lit(since))
    return rows.orderBy("channel_id", "message_id")


def channel_changes(messages: DataFrame, after_pts: int) -> DataFrame:
    """New and edited messages of the change feed after a position."""
    return messages.where(F.col("pts") > after_pts).orderBy("channel_id", "pts")


def content_bytes(kind: Column, encoding: Column, data: Column, sha: Column) -> Column:
    """Bytes of inline content; null if the stated hash is another."""
    raw = F.when(encoding == "base64", F.try_to_binary(data, F.lit("base64"))).otherwise(data.cast("binary"))
    return F.when((kind == "inline") & (sha.isNull() | (F.sha2(raw, 256) == sha)), raw)


def stored_materials(materials: DataFrame, source_id: str, observation_ids: Sequence[str] | None = None, since: Any = None, until: Any = None) -> DataFrame:
    """Materials of the task's own source, by ids or half-open time range, for running again."""
    rows = materials.where(F.col("source_id") == source_id)
    if observation_ids is not None:
        rows = rows.where(F.col("observation_id").isin(list(observation_ids)))
    if since is not None:
        rows = rows.where(F.col("stored_at") >= F.lit(since))
    return rows.where(F.col("stored_at") < F.lit(until)) if until is not None else rows
