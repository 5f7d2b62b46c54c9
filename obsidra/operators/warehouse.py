"""News star schema: typed rows, dictionaries, child tables and views from entity snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.documents import positioned, typed
from ..functions.times import parse_timestamp_strict
from .joins import dictionary, null_safe_lookup

#: Members of an article that have a column of their own.
ARTICLE = {"url": "string", "title": "string", "source": "string", "published_at": "string", "language": "string", "views": "bigint"}


def article_rows(snapshots: DataFrame, document: str = "fields") -> DataFrame:
    """Typed article rows of snapshots (canonical_key, fields as JSON text); what doesn't fit is in ``extra``."""
    doc = F.try_parse_json(F.col(document))
    columns, misfits = {}, []
    for name, kind in ARTICLE.items():
        value, misfit = typed(F.col("__doc"), name, kind)
        columns[name] = parse_timestamp_strict(value) if name == "published_at" else value
        misfits.append(F.when(misfit.isNotNull(), F.struct(F.lit(name).alias("key"), misfit.alias("value"))))
    members = F.from_json(document, "map<string,string>")
    other = F.map_entries(F.map_filter(members, lambda k, _: ~k.isin([*ARTICLE, "tags", "entities"])))
    extra = F.map_from_entries(F.concat(F.filter(F.array(*misfits), lambda x: x.isNotNull()), F.coalesce(other, F.array().cast("array<struct<key:string,value:string>>"))))
    return snapshots.withColumn("__doc", doc).select("canonical_key", *[c.alias(n) for n, c in columns.items()], extra.alias("extra"), F.col("__doc").alias("__doc"))


def article_tags(snapshots: DataFrame, document: str = "fields") -> tuple[DataFrame, DataFrame]:
    """(article_tag, tag): position and tag id per article, and the dictionary. Items that are no text leave a gap."""
    items = snapshots.select("canonical_key", F.explode(positioned(F.try_parse_json(F.col(document)), "tags")).alias("t")).select("canonical_key", F.col("t.pos").alias("position"), F.col("t.value").alias("tag")).where("tag is not null")
    tags = dictionary(items, "tag", "tag_id")
    return items.join(tags, "tag").select("canonical_key", "position", "tag_id"), tags


def named_entities(mentions: DataFrame) -> DataFrame:
    """Dictionary of (name, kind), in which a null kind equals a null kind."""
    return mentions.select("name", "kind").distinct().withColumn("entity_id", F.xxhash64("name", F.coalesce("kind", F.lit("\u0000"))))


def with_entity_ids(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    return null_safe_lookup(mentions, entities, ["name", "kind"])


def article_analysis(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """View: articles with their analysis, by URL."""
    return articles.alias("a").join(analyses.alias("n"), "url")


def article_with_event(analyses: DataFrame, events: DataFrame) -> DataFrame:
    """View: analyses with their event, if any."""
    return analyses.join(events, "event_id", "left")


def widen_source(current: DataFrame, seen: DataFrame) -> DataFrame:
    """Sources after more snapshots: the newest sets attributes, older ones only fill nulls, times widen."""
    rows = current.unionByName(seen)
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("last_seen"))).alias(c)
    return rows.groupBy("source_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), newest("name"), newest("kind"))


def received_bounds(history: DataFrame, entities: DataFrame) -> DataFrame:
    """First and last receipt per scope of the entities that still exist."""
    return history.join(entities.select("canonical_key", "scope"), "canonical_key").groupBy("scope").agg(F.min("received_at").alias("first"), F.max("received_at").alias("last"))


def analysis_rows(documents: DataFrame, document: str = "data") -> DataFrame:
    """Rows of a model's answer: one per listed mention (name, kind, tonality)."""
    items = F.try_variant_get(F.try_parse_json(F.col(document)), "$.entities", "array<struct<name:string,kind:string,tonality:string>>")
    return documents.select("url", F.posexplode(items).alias("position", "m")).select("url", "position", "m.*")


def verified_quotes(rows: DataFrame, text: Column, quote: Column) -> DataFrame:
    """Evidence rows whose quote stands in the source text."""
    from .predicates import quote_check

    return rows.where(quote_check(text, quote))
