"""Material documents from captures and messages, and walks over what was captured."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import channel_material_id, material_id
from ..functions.pages import html_meta
from ..functions.text import search_score
from ..functions.times import parse_datetime_lenient
from ..functions.urls import content_kind
from ..session import checkpointed
from .discovery import feed_autodiscovery, feed_entries, robots_sitemaps, sitemap_entries


def content_ref(body: Column, text: Column) -> Column:
    """Inline content with size and hash."""
    return F.struct(F.lit("inline").alias("kind"), F.lit("utf-8").alias("encoding"), text.alias("data"), F.octet_length(body).cast("long").alias("size_bytes"), F.sha2(body, 256).alias("sha256"))


def web_materials(captures: DataFrame) -> DataFrame:
    """Material documents of page captures (url, final_url, canonical_url, source_id, observation_id, fetched_at,
    media_type, status, etag, body as text)."""
    raw, page = F.col("body").cast("binary"), html_meta(F.col("body"))
    return captures.select(
        material_id(F.col("canonical_url")).alias("material_id"),
        "observation_id",
        F.struct(F.lit("web").alias("kind"), F.col("source_id")).alias("source"),
        F.struct("url", "final_url", "canonical_url").alias("locator"),
        "fetched_at",
        parse_datetime_lenient(page["published"]).alias("published_at"),
        parse_datetime_lenient(page["modified"]).alias("edited_at"),
        F.struct("media_type", content_kind(F.col("media_type"), F.col("final_url")).alias("content_kind")).alias("format"),
        F.struct(F.sha2(raw, 256).alias("content_sha256"), F.col("etag").alias("source_revision")).alias("revision"),
        content_ref(raw, F.col("body")).alias("content"),
        F.struct(page["title"].alias("title")).alias("metadata"),
    )


def channel_materials(messages: DataFrame) -> DataFrame:
    """Material documents of channel messages (channel_id, message_id, date, edit_date, text, views)."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return messages.select(
        channel_material_id(F.col("channel_id"), F.col("message_id")).alias("material_id"),
        F.struct(F.lit("telegram").alias("kind"), F.col("channel_id").alias("source_id")).alias("source"),
        F.struct(F.struct("channel_id", "message_id").alias("telegram")).alias("locator"),
        F.col("date").alias("published_at"),
        F.col("edit_date").alias("edited_at"),
        F.struct(F.sha2(raw, 256).alias("content_sha256"), F.col("edit_date").isNotNull().alias("is_edit")).alias("revision"),
        content_ref(raw, F.col("text")).alias("content"),
        F.struct("views").alias("metadata"),
    )


def without_content(materials: DataFrame) -> DataFrame:
    """Materials without their inline data."""
    return materials.withColumn("content", F.col("content").dropFields("data"))


def observation_of(materials: DataFrame) -> DataFrame:
    """Order keys of materials."""
    return materials.select("material_id", F.struct(F.col("fetched_at").alias("observed_at"), F.lit(-1).cast("long").alias("sequence"), "observation_id").alias("order"))


def sitemap_walk(captures: DataFrame, roots: DataFrame, depth: int | None = None, most: int | None = None) -> DataFrame:
    """(url, lastmod) listed by the sitemaps reachable from ``roots`` (url), by captured bodies (url, body binary).

    An index adds its sitemaps to the next level; every level joins the captures once and is checkpointed.
    All levels are walked, or the first ``depth``; a sitemap is visited once, so loops end. What the limits leave out is in
    :func:`sitemap_walk_counted`.
    """
    return sitemap_walk_counted(captures, roots, depth, most)[0]


def sitemap_walk_counted(captures: DataFrame, roots: DataFrame, depth: int | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The walk, and (url, dropped) of what limits cut: entries beyond ``most`` of a sitemap, sitemaps below ``depth`` (dropped null)."""
    parsed = captures.select("url", sitemap_entries(F.col("body"), most).alias("s"))
    level, seen, found, cut = roots.select("url").distinct(), roots.select("url").distinct(), None, None
    add = lambda a, b: b if a is None else a.unionByName(b)
    for _ in itertools.count() if depth is None else range(depth):
        read = checkpointed(level.join(parsed, "url"))
        hit = read.select("s.kind", F.explode("s.entries").alias("e")).select("kind", "e.*")
        found = add(found, hit.where("kind != 'sitemapindex'").select("url", "lastmod"))
        cut = add(cut, read.where("s.dropped > 0").select("url", F.col("s.dropped").alias("dropped")))
        level = checkpointed(hit.where("kind = 'sitemapindex'").select("url").distinct().join(seen, "url", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    cut = add(cut, level.select("url", F.lit(None).cast("int").alias("dropped")))
    return found.groupBy("url").agg(F.max("lastmod").alias("lastmod")), cut


def robots_roots(robots: DataFrame) -> DataFrame:
    """Sitemaps that captured robots files (url, body) declare, else the well-known place."""
    declared = robots_sitemaps(F.col("body"))
    fallback = F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), F.lit("/sitemap.xml"))
    return robots.select(F.explode(F.when(F.size(declared) > 0, declared).otherwise(F.array(fallback))).alias("url")).distinct()


def feed_links(seeds: DataFrame, captures: DataFrame) -> DataFrame:
    """(feed, url, lastmod): entries of seed feeds, and of the feeds that seed pages point to."""
    own = seeds.select("url").join(captures, "url")
    pointed = own.select(F.explode(feed_autodiscovery(F.col("body").cast("string"))).alias("url"))
    feeds = own.select("url", "body").unionByName(pointed.join(captures, "url").select("url", "body")).dropDuplicates(["url"])
    return feeds.select(F.col("url").alias("feed"), F.explode(feed_entries(F.col("body"))).alias("e")).select("feed", "e.*")


def api_pages(pages: DataFrame, by: str, number: str, items: str, cursor: str | None = None) -> DataFrame:
    """Pages of an API up to the first without items, with a cursor seen before, or without a new item."""
    w = Window.partitionBy(by).orderBy(number)
    first = pages.select(by, number, F.explode(items).alias("i")).groupBy(by, "i").agg(F.min(number).alias("at"))
    fresh = first.groupBy(by, F.col("at").alias(number)).agg(F.count(F.lit(1)).alias("__new"))
    marked = pages.join(fresh, [by, number], "left")
    stop = F.coalesce("__new", F.lit(0)) == 0
    if cursor:
        seen = F.row_number().over(Window.partitionBy(by, cursor).orderBy(number)) > 1
        stop = stop | (F.col(cursor).isNotNull() & seen)
    marked = marked.withColumn("__stop", stop.cast("int"))
    return marked.withColumn("__ended", F.max("__stop").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__ended = 0").drop("__new", "__stop", "__ended")


def search_sources(catalogue: DataFrame, query: str, texts: Sequence[str], most: int = 10) -> DataFrame:
    """Catalogue entries by the share of the query's words that they hold."""
    scored = catalogue.withColumn("score", search_score(F.lit(query), F.concat_ws(" ", *texts)))
    return scored.where("score > 0").orderBy(F.desc("score"), *catalogue.columns[:1]).limit(most)


def replay_order(streams: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """Event streams merged by one order."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.orderBy(*order)


def retained(collections: DataFrame, now: Column, days: int) -> DataFrame:
    """Collections that are unfinished or not older than ``days``."""
    return collections.where(F.col("finished_at").isNull() | (F.col("finished_at") > now - F.expr(f"INTERVAL {days} DAYS")))
