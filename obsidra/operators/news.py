"""Analyses of articles checked against their texts: quotes aligned to spans, then article rows and event rows.

A quote stands in a text if their folded forms match: letters and digits in lower case, everything between them one
space. The folded text keeps the place of each of its characters, so a match gives the span of the source. An answer
is taken as a VARIANT with ``title``, ``evidence`` (a list of quotes), ``entities`` (name, attitude, evidence with quote and attribution)
and ``event`` (canonical with action, place, date and actor; summary, identity_confidence, evidence).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pages import apart
from ..functions.times import clamp_event_date, date_in_quote
from .dedup import event_identity


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Signs of a word, in a class of a pattern.
_WORD = r"\p{L}\p{M}\p{N}"


def _folded(text: Column) -> Column:
    """Words in small letters (one kind of sigma, whatever stood beside it), single spaces between them and at both ends."""
    words = F.translate(F.lower(F.regexp_replace(text, f"[^{_WORD}]+", " ")), "ς", "σ")
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def folded_text(text: Column) -> Column:
    """struct<text, lengths>: the folded form, and the lengths of what stands in ``text`` in turn: a gap (with one sign more at the start) and a word."""
    pieces = F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(f"[{_WORD}]+|[^{_WORD}]+"), F.lit(0))
    return F.struct(_folded(text).alias("text"), F.transform(pieces, lambda p: F.length(p)).alias("lengths"))


def quote_span(folded: Column, quote: Column) -> Column:
    """struct<start, end> of the first place in a text (given :func:`folded_text`) where ``quote`` stands, in characters; null if nowhere or empty.

    A match begins and ends with words, so the words before it tell its place in the source.
    """
    spaces = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    upto = lambda pieces: F.aggregate(F.slice(folded["lengths"], F.lit(1), pieces), F.lit(-1), lambda total, n: total + n)

    def found(n: Column) -> Column:
        place = F.instr(folded["text"], n)
        before = spaces(F.left(folded["text"], place - 1))
        words = spaces(n) - 1
        return F.when((place > 0) & (F.length(n) > 2), F.struct(upto(2 * before + 1).alias("start"), upto(2 * (before + words)).alias("end")))

    return _let(_folded(quote), found)


def _texts(answer: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(answer, path, "array<variant>"), F.array().cast("array<variant>"))


def listed_quotes(answer: Column) -> Column:
    """array<struct<pointer, quote, attribution>>: all evidence of an answer."""
    one = lambda v, pointer, i: F.struct(
        F.concat(F.lit(pointer), i.cast("string")).alias("pointer"), F.coalesce(F.try_variant_get(v, "$.quote", "string"), F.lit("")).alias("quote"), F.try_variant_get(v, "$.attribution", "string").alias("attribution")
    )
    plain = lambda path, pointer: F.transform(_texts(answer, path), lambda v, i: one(v, pointer, i))
    within = F.flatten(
        F.transform(
            _texts(answer, "$.entities"),
            lambda e, k: F.transform(_texts(e, "$.evidence"), lambda v, i: F.struct(F.concat(F.lit("/entities/"), k.cast("string"), F.lit("/evidence/"), i.cast("string")).alias("pointer"), F.coalesce(F.try_variant_get(v, "$.quote", "string"), F.lit("")).alias("quote"), F.try_variant_get(v, "$.attribution", "string").alias("attribution"))),
        )
    )
    return F.concat(plain("$.evidence", "/evidence/"), within, plain("$.event.evidence", "/event/evidence/"))


def aligned(articles: DataFrame, text: str = "text", answer: str = "answer") -> DataFrame:
    """``articles`` with ``quotes``: all evidence of the answer with its span in the text, null where the text doesn't hold it."""
    rows = articles.withColumn("__folded", apart(folded_text(F.coalesce(F.col(text), F.lit("")))))  # folded once, not once a quote
    spans = F.transform(
        listed_quotes(F.col(answer)),
        lambda q: _let(quote_span(F.col("__folded"), q["quote"]), lambda s: F.struct(q["pointer"].alias("pointer"), q["quote"].alias("quote"), q["attribution"].alias("attribution"), s["start"].alias("start"), s["end"].alias("end"))),
    )
    return rows.withColumn("quotes", spans).drop("__folded")


def normalised(articles: DataFrame, least_confidence: float = 0.9, lag_days: int = 30, text: str = "text", answer: str = "answer") -> DataFrame:
    """One row per article: ``quotes``, ``problem``, ``event_id``, ``reason`` and ``event_day`` beside its columns (with ``published``, a date).

    problem: why the analysis is refused - ``no evidence`` of a quote in the text, ``unfounded attitude`` (an attitude that isn't
    neutral needs the author's own words), or null. event_id: hash of the event's canonical identity, or null with a
    reason: ``refused``, ``no event``, ``low confidence``, ``date not quoted`` (the date must be said in the event's evidence),
    ``date out of range``.
    """
    a = F.col(answer)
    rows = aligned(articles, text, answer)
    missing = F.exists("quotes", lambda q: q["start"].isNull())
    biased = F.exists(
        _texts(a, "$.entities"),
        lambda e: F.coalesce(F.try_variant_get(e, "$.attitude", "string"), F.lit("neutral")).isin("positive", "negative")
        & ~F.exists(_texts(e, "$.evidence"), lambda v: F.coalesce(F.try_variant_get(v, "$.attribution", "string") == "author", F.lit(False))),
    )
    problem = F.when(a.isNull(), "no analysis").when(missing, "no evidence").when(biased, "unfounded attitude")
    member = lambda path: F.try_variant_get(a, f"$.event{path}", "string")
    day = F.try_to_date(member(".canonical.date"), "yyyy-MM-dd")
    said = F.exists(F.filter("quotes", lambda q: q["pointer"].startswith("/event/")), lambda q: F.coalesce(date_in_quote(day, q["quote"]), F.lit(False)))
    confidence = F.coalesce(F.try_variant_get(a, "$.event.identity_confidence", "double"), F.lit(0.0))
    rows = rows.withColumns({"problem": problem, "event_day": clamp_event_date(day, F.col("published"), lag_days)})
    reason = (
        F.when(F.col("problem").isNotNull(), "refused")
        .when(F.try_variant_get(a, "$.event.canonical", "variant").isNull(), "no event")
        .when(confidence < least_confidence, "low confidence")
        .when(~said, "date not quoted")
        .when(F.col("event_day").isNull(), "date out of range")
    )
    identity = F.struct(*[F.lower(F.trim(member(f".canonical.{k}"))).alias(k) for k in ("action", "place", "actor")], day.cast("string").alias("date"))
    return rows.withColumn("reason", reason).withColumn("event_id", event_identity(identity, F.col("reason"))).withColumn("event_day", F.when(F.col("reason").isNull(), F.col("event_day")))


def event_rows(normal: DataFrame, answer: str = "answer", order: str = "published") -> DataFrame:
    """One row per event of normalised articles: event_id, day, summary of the earliest article, articles."""
    rows = normal.where("event_id IS NOT NULL").select("event_id", "event_day", F.try_variant_get(F.col(answer), "$.event.summary", "string").alias("summary"), F.struct(F.col(order), F.to_json(F.col(answer))).alias("at"))
    return rows.groupBy("event_id").agg(F.min("event_day").alias("day"), F.min_by("summary", "at").alias("summary"), F.count(F.lit(1)).alias("articles"))
