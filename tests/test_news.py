"""Quotes aligned to spans, and analyses accepted or refused."""

import json
import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from obsidra.operators import news


def plain_span(text, quote):
    fold = lambda t: [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", t)]
    have, want = fold(text), [w for _, _, w in fold(quote)]
    for i in range(len(have) - len(want) + 1):
        if want and [w for _, _, w in have[i : i + len(want)]] == want:
            return have[i][0], have[i + len(want) - 1][1]
    return None


def test_spans_equal_a_plain_search(spark):
    rng = random.Random(2)
    words = ["Ab", "c1", "été", "ЇЖАК", "日本", "d", "x2"]
    joined = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "—", ", ", "…"]) for _ in range(n))
    rows = []
    for i in range(200):
        text = rng.choice(["", " ", "«"]) + joined(rng.randrange(12))
        at = rng.randrange(len(text) + 1)
        rows.append((i, text, rng.choice([joined(rng.randrange(3)), text[at : at + rng.randrange(20)].upper(), text.swapcase(), "", "…"])))
    df = spark.createDataFrame(rows, "i int, text string, quote string").withColumn("f", news.folded_text(F.col("text")))
    got = {r["i"]: r["s"] for r in df.select("i", news.quote_span(F.col("f"), F.col("quote")).alias("s")).collect()}
    found = 0
    for i, text, quote in rows:
        want = plain_span(text, quote)
        assert (None if got[i] is None else tuple(got[i])) == want, (text, quote)
        found += want is not None
    assert 50 < found < 190


TEXT = "On 5 March, the Bank of X raised rates. Critics said: «too late»."
EVENT = {"canonical": {"action": "Raise", "place": "X", "actor": "Bank", "date": "2024-03-05"}, "summary": "s", "identity_confidence": 0.95, "evidence": [{"quote": "5 march the bank"}]}


@pytest.mark.parametrize("answer, published, problem, reason", [
    ({"event": EVENT}, date(2024, 3, 6), None, None),
    ({"event": EVENT, "evidence": [{"quote": "never said"}]}, date(2024, 3, 6), "no evidence", "refused"),
    ({"entities": [{"name": "b", "attitude": "negative", "evidence": [{"quote": "too late", "attribution": "quoted"}]}]}, date(2024, 3, 6), "unfounded attitude", "refused"),
    ({"entities": [{"name": "b", "attitude": "negative", "evidence": [{"quote": "too late", "attribution": "author"}]}]}, date(2024, 3, 6), None, "no event"),
    ({"event": {**EVENT, "identity_confidence": 0.5}}, date(2024, 3, 6), None, "low confidence"),
    ({"event": {**EVENT, "evidence": [{"quote": "raised rates"}]}}, date(2024, 3, 6), None, "date not quoted"),
    ({"event": EVENT}, date(2024, 3, 4), None, "date out of range"),
    (None, date(2024, 3, 6), "no analysis", "refused"),
])
def test_analyses(spark, answer, published, problem, reason):
    row = spark.createDataFrame([(TEXT, None if answer is None else json.dumps(answer), published)], "text string, a string, published date").withColumn("answer", F.try_parse_json("a"))
    got = news.normalised(row).first()
    assert (got["problem"], got["reason"]) == (problem, reason) and (got["event_id"] is None) == (reason is not None)
    if reason is None:
        quote = got["quotes"][0]
        assert TEXT[quote["start"] : quote["end"]] == "5 March, the Bank"


def test_events_of_several_articles(spark):
    rows = [(TEXT, json.dumps({"event": {**EVENT, "summary": str(d), "canonical": {**EVENT["canonical"], "place": p}}}), date(2024, 3, d)) for d, p in ((9, " x"), (6, "X"), (7, "Y"))]
    found = news.event_rows(news.normalised(spark.createDataFrame(rows, "text string, a string, published date").withColumn("answer", F.try_parse_json("a"))))
    assert sorted((r["summary"], r["articles"]) for r in found.collect()) == [("6", 2), ("7", 1)]
    assert news.event_rows(news.normalised(spark.createDataFrame([], "text string, a string, published date").withColumn("answer", F.try_parse_json("a")))).count() == 0


def test_spans_in_long_texts_and_of_letters_that_change_with_their_place(spark):
    long = "«" + "слово, " * 40_000 + "— the END.'Of it"
    rows = [("εις την ΟΔΟΣ, εδώ", "Η οδος"), ("εις την ΟΔΟΣ, εδώ", "ΤΗΝ - οδοσ"), ("ΟΔΟΣ'Α", "οδος α"), ("İki ǅ 😀x", "i̇ki ǆ"), ("a 😀 b c", "B—c"), (long, "the end of"), ("", "a"), ("a", "…"), ("ab c", "b c")]
    df = spark.createDataFrame([(i, t, json.dumps({"evidence": [{"quote": q}]})) for i, (t, q) in enumerate(rows)], "i int, text string, a string").withColumn("answer", F.try_parse_json("a"))
    got = {r["i"]: (r["q"]["start"], r["q"]["end"]) for r in news.aligned(df).select("i", F.col("quotes")[0].alias("q")).collect()}
    end = len(long)
    assert got == {0: (None, None), 1: (4, 12), 2: (0, 6), 3: (0, 5), 4: (4, 7), 5: (end - 14, end - 3), 6: (None, None), 7: (None, None), 8: (None, None)}
    assert long[end - 14 : end - 3] == "the END.'Of"
