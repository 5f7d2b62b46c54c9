"""Functions and operators on literals."""

import gzip
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from obsidra.functions import documents, elements, keys, pages, semver, text, times, urls
from obsidra.operators import dedup, handlers, joins, packages, paging, predicates, reports, routing, sampling, series, warehouse
from obsidra.sources import discovery


def values(spark, *columns, rows=((1,),)):
    return spark.createDataFrame(list(rows), ", ".join(f"c{i} {'int' if isinstance(v, int) else 'string'}" for i, v in enumerate(rows[0]))).select(*columns).collect()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "rules", "want"),
    [
        ("HTTP://Example.COM:80/a/../b/./c?b=2&a=1#f", {}, "http://example.com/b/c?a=1&b=2"),
        ("https://e.com", {}, "https://e.com/"),
        ("https://e.com/%7euser/%2f?q=a b", {}, "https://e.com/~user/%2F?q=a%20b"),
        ("https://e.com/a/", {"trailing_slash": "remove"}, "https://e.com/a"),
        ("https://e.com/a", {"trailing_slash": "add"}, "https://e.com/a/"),
        ("https://e.com/a.html", {"trailing_slash": "add"}, "https://e.com/a.html"),
        ("https://e.com/?utm_source=x&k=&ref=1", {"strip_params": ("utm_*", "ref")}, "https://e.com/?k="),
        ("https://e.com:8443/x", {}, "https://e.com:8443/x"),
        ("https://пример.рф/", {}, "https://xn--e1afmkfd.xn--p1ai/"),
        ("mailto:a@b", {}, None),
        ("https://e.com:port/", {}, None),
        ("  ", {}, None),
        ("https://e.com/#top", {"drop_fragment": False}, "https://e.com/#top"),
    ],
)
def test_normal_url(url, rules, want):
    assert urls.normal_url(url, urls.UrlRules(**rules)) == want


def test_url_expressions(spark):
    u = F.lit("https://Shop.example.com/product/iphone-15-pro/page=2;a=1/12345/file.HTML?b=2&a=1")
    assert one(spark, urls.url_shape(u)) == "shop.example.com/product/*/*=*/*/file.html?q"
    assert one(spark, urls.link_pattern(u)) == "shop.example.com/product/*/page=*;a=*/*/file.html?a=*&b=*"
    assert one(spark, urls.set_query_param(F.lit("https://e.com/?a=1&b=2#x"), "a", F.lit("7 8"))) == "https://e.com/?a=7%208&b=2#x"
    assert one(spark, urls.set_query_param(F.lit("https://e.com/"), "p", F.lit(2))) == "https://e.com/?p=2"
    assert one(spark, urls.same_url(F.lit("HTTP://E.com:80/a/#x"), F.lit("http://e.com/a")))
    assert not one(spark, urls.same_url(F.lit("http://e.com/a"), F.lit("http://e.com/b")))
    assert one(spark, urls.origin_of(F.lit("https://E.com/a"))) == "https://e.com"
    assert one(spark, urls.content_kind(F.lit("application/xml"), F.lit("https://e.com/Sitemap.xml"))) == "sitemap"
    assert one(spark, urls.expand_template("https://e.com/{q}/x", {"q": F.lit("a b")})) == "https://e.com/a%20b/x"


def test_keys(spark):
    assert one(spark, keys.canonical_key(F.lit("shop"), keys.canonical_json({"sku": F.lit("A"), "b": F.lit("ї")}))) == 'shop|{"b":"ї","sku":"A"}'
    assert one(spark, keys.canonical_key(F.lit("s"), keys.canonical_map_json(F.create_map(F.lit("z"), F.lit("1"), F.lit("a"), F.lit('q"'))))) == 's|{"a":"q\\"","z":"1"}'
    assert one(spark, keys.canonical_scope(F.lit('a|b|{"x":"1"}'))) == "a|b"
    assert one(spark, keys.safe_segment(F.lit("a/b:c"))) == "a_b_c"
    assert one(spark, keys.safe_segment(F.lit("..."))) == "_"
    assert one(spark, keys.safe_segment(F.lit("CON.txt"))) == "_CON.txt"
    assert one(spark, keys.object_delivery_key(F.lit("d"), F.lit(0))) == "d"
    assert one(spark, keys.object_delivery_key(F.lit("d"), F.lit(1))) == "d#raw1"
    assert one(spark, keys.build_key([("a", F.lit("1")), ("b", F.lit(None).cast("string"))])) is None
    rows = spark.createDataFrame([(1, 100, s, i) for i, s in enumerate("AABAA")], "message_id int, edit_second long, sha string, arrival int")
    assert [r["sequence"] for r in keys.revision_sequence(rows).orderBy("arrival").collect()] == [100000, 100000, 100001, 100002, 100002]


def test_conditions_treat_missing_fields_as_stated(spark):
    docs = spark.createDataFrame([('{"a":1,"b":"x","n":null,"t":true}',)], "d string").withColumn("d", F.parse_json("d"))
    fields = predicates.Fields({}, {"material": F.col("d")})
    check = lambda op, field, value=None: docs.select(predicates.predicate({"field": f"material.{field}", "op": op, "value": value}, fields).alias("x")).first()["x"]
    assert check("ne", "zz", 1) and check("not_in", "zz", [1]) and check("not_exists", "zz")
    assert not any(check(op, "zz", 1) for op in ("eq", "in", "gt", "gte", "lt", "lte", "matches_glob", "matches_regex", "exists") if op != "in") and not check("in", "zz", [1])
    assert check("exists", "n") and check("eq", "a", 1) and check("eq", "b", "x") and not check("eq", "a", "1")
    assert check("gt", "a", 0) and not check("gt", "b", 0) and check("gt", "b", "w") and not check("gt", "t", 0) and check("eq", "t", True) and check("eq", "t", 1)
    assert check("matches_glob", "b", "?") and check("matches_regex", "b", r"^\w$") and check("in", "b", ["x", "y"])
    tree = {"all": [{"field": "material.a", "op": "eq", "value": 1}, {"not": {"field": "material.b", "op": "eq", "value": "y"}}]}
    assert docs.where(predicates.condition(tree, fields)).count() == 1
    assert predicates.condition_uses_entity({"any": [{"field": "entity.price", "op": "exists"}]}) and not predicates.condition_uses_entity(tree)


def test_scope_names_the_first_reason(spark):
    rules = {"allowed_domains": ["e.com"], "include_subdomains": True, "path_prefixes": ["/a"], "exclude": [{"type": "glob", "value": "e.com/a/x*"}], "include": [{"type": "regex", "value": "/a/"}]}
    reason = lambda u: one(spark, predicates.scope_reason(F.lit(u), rules))
    assert reason("https://e.com/a/1") is None and reason("https://m.e.com/a/1") is None
    assert reason("ftp://e.com/a/") == "scheme ftp not allowed"
    assert reason("https://evil-e.com/a/") == "host evil-e.com not in allowed_domains"
    assert reason("https://e.com/b") == "path outside path_prefixes"
    assert reason("https://e.com/a/xy") == "matches scope.exclude"
    assert reason("https://e.com/ab") == "does not match scope.include"


def test_robots(spark):
    body = "User-agent: a\nUser-agent: b\nDisallow: /x\n\nUser-agent: *\nDisallow:\nDisallow: /p*q$\nAllow: /p\n"
    assert predicates.robots_rules(body, "bot/1") == predicates.robots_rules(body, "b") == [(False, "/x")]
    rules = F.array(*[F.struct(F.lit(a).alias("allow"), F.lit(p).alias("path")) for a, p in predicates.robots_rules(body, "zz")])
    allowed = lambda t: one(spark, predicates.robots_allowed(F.lit(t), rules))
    assert allowed("/p") and not allowed("/p1q") and allowed("/p1qr") and allowed("/other") and allowed("/robots.txt")
    assert [one(spark, predicates.robots_outcome(F.lit(s))) for s in (200, 404, 503)] == ["parse", "allow_all", "disallow_all"]


def test_routing_and_order():
    stages = [{"stage_id": "b", "inputs": [{"from": "a"}]}, {"stage_id": "a", "inputs": [{"from": "collect"}]}]
    assert routing.stage_order(stages) == ["a", "b"]
    assert routing.stage_order([{"stage_id": "a", "inputs": [{"from": "b"}]}, {"stage_id": "b", "inputs": [{"from": "a"}]}]) is None


def test_documents(spark):
    doc = json.dumps({"a": [{"b": 1}, {"b": 2, "c": {"b": 3}}], "d": None})
    find = lambda p: documents.find_path(json.loads(doc), documents.path_steps(p))
    assert find("$.a[*].b") == [1, 2] and find("$.a[-1].b") == [2] and find("$..b") == [1, 2, 3] and find("$.zz") == []
    assert one(spark, documents.json_path(F.lit(doc), "$.a[0].b")) == ["1"]
    assert one(spark, documents.json_path(F.lit(doc), "$..b")) == ["1", "2", "3"]
    with pytest.raises(ValueError):
        documents.path_steps("$.a[?(@.x)]")
    assert documents.unflatten(documents.flatten({"a": {"b": 1, "c": {"d": 2}}})) == {"a": {"b": 1, "c": {"d": 2}}}
    assert documents.differences({"a": [1, {"x": 1}]}, {"a": [{"x": 1, "y": 2}, 1], "z": 0}, True) == []
    assert documents.differences({"a/b": 1}, {"a/b": True}) == [("/a~1b", 1, True)]
    assert documents.differences([1, 2], [1]) == [("/length", 2, 1)]
    assert documents.merge_lines(["a", "b", "c"], ["a", "B", "c"], ["a", "b", "c", "d"]) == (["a", "B", "c", "d"], 0)
    assert documents.merge_lines(["a"], ["b"], ["c"])[1] == 1
    assert documents.merge_documents({"a": 1, "b": 1}, {"a": 2, "b": 1}, {"a": 1, "c": 3}) == ({"a": 2, "c": 3}, [])
    assert documents.merge_documents({"a": 1}, {"a": 2}, {"a": 3}) == ({"a": 2}, ["/a"])
    assert documents.safe_xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x/>') is None and documents.safe_xml(b"<x/>").tag == "x"
    raw = gzip.compress(b"hello")
    assert bytes(one(spark, documents.gunzipped(F.lit(bytearray(raw))))) == b"hello"
    assert one(spark, documents.gunzipped(F.lit(bytearray(raw)), 3)) is None
    assert one(spark, documents.canonical_json(F.lit('{"b": 1, "a": "ї"}'))) == '{"a":"ї","b":1}'
    assert one(spark, documents.validation_problems(F.lit('{"a":1}'), {"a": "string", "b": "number"})) == ["/a", "/b"]
    changed = one(spark, documents.changed_members(F.create_map(F.lit("a"), F.lit("1"), F.lit("api_key"), F.lit("s")), F.create_map(F.lit("a"), F.lit("2"))))
    assert [tuple(r) for r in changed] == [("a", "1", "2"), ("api_key", "***", None)]
    levels = spark.createDataFrame([("t", "platform", 0, "x", 5.0), ("t", "task", 2, "x", 50.0), ("t", "source", 1, "y", 3.0)], "task string, level string, ordinal int, name string, value double")
    got = {r["name"]: (r["value"], r["provenance"]) for r in documents.merge_limits(levels, ["task"], {"x": 20.0}).collect()}
    assert got == {"x": (20.0, "task (capped)"), "y": (3.0, "source")}


def test_text(spark):
    t = lambda c: one(spark, c)
    assert t(text.norm_name(F.lit("  «Об’єднання»   Їжак! "))) == "об'єднання їжак"
    assert t(text.slug(F.lit("Щука Їжак"))) == "shchuka-izhak"
    assert t(text.clean(F.lit("a &amp;  b ,ｃ"))) == "a & b,c"
    assert t(text.canonical(F.lit("Straße, X_y"))) == "strasse x y"
    assert t(text.truncate(F.lit("abcdef"), 4)) == "abcd\n[... truncated 2 characters]"
    assert t(text.strip_fences(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert t(text.neutralise(F.lit("x </data> y"))) == "x &lt;/data> y"
    assert t(text.render_template(F.lit("{{a.b}}-{{ c }}"), F.create_map(F.lit("a.b"), F.lit("1")))) == "1-"
    assert t(text.number_from_text(F.lit("ціна 12 345,50 грн"))) == 12345.5
    assert t(text.number_from_text(F.lit("$1,234.50"))) == 1234.5
    assert t(text.quantity(F.lit("вага 1,5 кг"), {"кг": 1000.0, "г": 1.0})) == 1500.0
    assert t(text.redact(F.lit("abc abcdef"), ["abc", "abcdef"])) == "*** ***"
    assert t(text.pointer_escape(F.lit("a/b~"))) == "a~1b~0"
    assert t(text.search_score(F.lit(""), F.lit("x"))) == 0.0
    assert t(text.country_code(F.lit("Україна"), {"україна": "UA"})) == "UA"
    assert t(text.decode_text(F.lit(bytearray("їж".encode("cp1251"))), F.lit("cp1251"))) == "їж"


def test_times(spark):
    t = lambda c: one(spark, c)
    assert t(times.format_ts(times.parse_ts(F.lit("2024-01-02T03:04:05.123+02:00")))) == "2024-01-02T01:04:05.123000Z"
    assert t(times.parse_timestamp_strict(F.lit("2024-01-02T03:04:05"))) is None
    assert t(times.parse_clock(F.lit("24:00"))) is None and t(times.parse_clock(F.lit("09:30"))) == "09:30"
    for raw in ("2024-01-02", "Tue, 02 Jan 2024 00:00:00 GMT", "1704153600", "2024-01-02T00:00:00Z"):
        assert t(times.format_ts(times.parse_datetime_lenient(F.lit(raw)))) == "2024-01-02T00:00:00Z", raw
    assert t(series.budget_window("week", F.lit("2024-12-30 10:00:00").cast("timestamp"))) == "week:2025-W01"
    at = datetime(2024, 1, 31, 23, 59, tzinfo=UTC)
    assert times.next_fire("0 9 * * mon-fri", at) == datetime(2024, 2, 1, 9, 0, tzinfo=UTC)
    assert times.next_fire("0 0 13 * fri", at) == datetime(2024, 2, 2, 0, 0, tzinfo=UTC)
    with pytest.raises(ValueError):
        times.cron_fields("61 * * * *")


def test_semver(spark):
    order = ["1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.2.0", "1.10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "version string")
    assert [r["version"] for r in df.orderBy(semver.sort_key(F.col("version"))).collect()] == order


PAGE = """<html><head><title> A  page </title><base href="https://e.com/x/"><link rel="canonical" href="https://e.com/c"><link rel=alternate type="application/rss+xml" href="/feed">
<meta property="article:published_time" content="2024-01-01"><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"P","sku":1,"offers":{"price":5,"priceCurrency":"UAH","availability":"https://schema.org/InStock"}},
{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"B"},{"position":1,"item":{"name":"A"}}]},{"@type":"NewsArticle","url":"https://e.com/n/","headline":"H","author":[{"name":"N"}]}]}</script></head>
<body><!-- <a href="/no">no</a> --><a href="/y?a=1&amp;b=2#z">y</a><a href='mailto:x'>m</a><a rel=next href=/n2>n</a><table><tr><td>Color:</td><td> red </td></tr></table></body></html>"""


def test_pages(spark):
    p = F.lit(PAGE)
    assert one(spark, pages.title(p)) == "A page" and one(spark, pages.base_href(p)) == "https://e.com/x/" and one(spark, pages.declared_canonical(p)) == "https://e.com/c"
    assert one(spark, pages.html_meta(p))["published"] == "2024-01-01"
    df = spark.createDataFrame([("https://e.com/n", PAGE)], "url string, html string")
    assert pages.page_links(df).first()["links"] == ["https://e.com/y?a=1&b=2", "https://e.com/n2"]
    assert pages.page_links(df, hosts=["com"]).first()["links"] and pages.page_links(df, hosts=["other.com"]).first()["links"] == []
    links = lambda *sources: [r["href"] for r in pages.link_rows(df, sources=sources).collect()]
    assert links("pagination_rel") == ["/n2"] and links("canonical") == ["https://e.com/c"] and links("canonical", "a_href") == ["https://e.com/c", "/y?a=1&b=2#z", "mailto:x", "/n2"]
    assert [tuple(r) for r in pages.ld_products(df).collect()] == [("https://e.com/n", "P", "1", "5", "UAH", "InStock")]
    article = pages.page_articles(df).first()
    assert (article["author"], article["title"], article["published"], article["problem"]) == ("N", "H", "2024-01-01", "no article")
    t = df.select("html", elements.page_tree(F.col("html")).alias("t"))
    of = lambda c: t.select(c).first()[0]
    assert of(pages.breadcrumb(F.col("t"))) == ["A", "B"] and of(pages.attributes_table(F.col("t"))) == {"Color": "red"}
    assert len(one(spark, pages.lean_html(p, 300)).encode()) <= 300 and len(of(pages.html_digest(F.col("html"), F.col("t"), 400))) <= 400
    assert one(spark, discovery.feed_autodiscovery(p)) == ["/feed"]
    assert one(spark, pages.charset_of(F.lit("text/html; charset=KOI8-U"), F.lit(bytearray(b"")))) == "koi8-u"


def test_hidden_links_and_empty_pages(spark):
    rows = [("https://e.com/a/", "<base href='b/'><svg><a href=/no></a></svg><a href='x#1'>1</a><a href='x#2'>2</a><a href='ftp://e.com/'>3</a><a href='//sub.E.com/y'>4</a><a href='http://['>5</a>"), (None, None), ("u", "")]
    df = spark.createDataFrame(rows, "url string, html string")
    assert [r["links"] for r in pages.page_links(df).collect()] == [["https://e.com/a/b/x", "https://sub.E.com/y"], None, []]
    assert pages.page_links(df, hosts=["sub.e.com"]).first()["links"] == ["https://sub.E.com/y"]
    assert pages.link_rows(df).count() == 6 and pages.page_articles(df.limit(0)).count() == 0
    assert [r["problem"] for r in pages.page_articles(df).collect()] == ["no article"] * 3


def test_articles_bound_to_their_page(spark):
    def found(*nodes, url="https://e.com/a"):
        html = '<script type="application/ld+json">' + json.dumps([{"@type": "Article", **n} for n in nodes]) + "</script>"
        return pages.page_articles(spark.createDataFrame([(url, html)], "url string, html string")).first()["body"]

    assert found({"@id": "https://e.com/a", "articleBody": "x"}, {"url": "/a/", "articleBody": "longer"}) == "longer"
    assert found({"@id": "https://e.com/a", "articleBody": "one"}, {"url": "/a", "articleBody": "two"}) == "one"
    assert found({"url": "https://other.com/", "articleBody": "no"}) is None
    assert found({"articleBody": "only"}) == "only" and found({"articleBody": "1"}, {"articleBody": "2"}) is None
    assert found({"mainEntityOfPage": {"url": "https://E.com/a?b=1&a=2"}, "articleBody": "q"}, url="https://e.com/a?a=2&b=1") == "q"
    nested = '<script type="application/ld+json">{"@graph":[{"@type":"WebPage","mainEntity":{"@type":["NewsArticle"],"@id":"/a","articleBody":"deep"}}]}</script>'
    assert pages.page_articles(spark.createDataFrame([("https://e.com/a", nested)], "url string, html string")).first()["body"] == "deep"


def test_sources(spark, tmp_path):
    urlset = b'<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://e.com/1</loc><lastmod>2024</lastmod></url><url><loc>https://e.com/2</loc></url></urlset>'
    got = one(spark, discovery.sitemap_entries(F.lit(bytearray(urlset)), 1))
    assert (got["kind"], got["dropped"], got["entries"][0]["url"]) == ("urlset", 1, "https://e.com/1")
    assert one(spark, discovery.sitemap_entries(F.lit(bytearray(b"https://e.com/a\nx\n"))))["kind"] == "text"
    rss = b"<rss><channel><item><guid>https://e.com/g</guid><pubDate>now</pubDate></item><item><link>https://e.com/l</link></item></channel></rss>"
    assert [e["url"] for e in one(spark, discovery.feed_entries(F.lit(bytearray(rss))))] == ["https://e.com/g", "https://e.com/l"]
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><link rel="related" href="https://e.com/r"/><link href="https://e.com/a"/></entry></feed>'
    assert [e["url"] for e in one(spark, discovery.feed_entries(F.lit(bytearray(atom))))] == ["https://e.com/a"]
    items = one(spark, discovery.api_items(F.lit('{"data":{"items":[{"u":"https://e.com/1","m":"2024"},{"u":"https://e.com/2"}]}}'), "$.data.items", "$.u", "$.m"))
    assert [(i["url"], i["lastmod"]) for i in items] == [("https://e.com/1", "2024"), ("https://e.com/2", None)]
    assert one(spark, discovery.robots_sitemaps(F.lit("Sitemap: https://e.com/s\nsitemap: https://e.com/s"))) == ["https://e.com/s"]
    seeds = discovery.seed_list(spark, ["https://e.com/", "https://e.com/#x"])
    links = spark.createDataFrame([("https://e.com/", "https://e.com/a"), ("https://e.com/a", "https://e.com/b"), ("https://e.com/b", "https://e.com/"), ("https://e.com/b", "https://e.com/c")], "url string, target string")
    assert {r["url"]: r["depth"] for r in discovery.crawl(seeds, links, 2).collect()} == {"https://e.com/": 0, "https://e.com/a": 1, "https://e.com/b": 2}
    channel = {"channel": {"channel_id": "c", "username": "u"}, "messages": [{"id": 2, "text": "b"}, {"id": 1, "text": "a"}], "events": [{"pts": 7, "message": {"id": 1, "text": "a2"}}]}
    (tmp_path / "c.json").write_text(json.dumps(channel))
    messages = discovery.recorded_channel(spark, str(tmp_path / "c.json"))
    assert [r["text"] for r in discovery.channel_history(messages, after=1).collect()] == ["b"]
    assert [r["text"] for r in discovery.channel_changes(messages, 6).collect()] == ["a2"]
    assert discovery.template_count({"a": [1, 2], "b": [1, 2, 3]}) == 6
    pages_ = spark.createDataFrame([("l", 1, ["a", "b"], 200), ("l", 2, ["c"], 200), ("l", 3, ["c"], 200), ("l", 4, ["d"], 200)], "listing string, n int, urls array<string>, status int")
    assert [r["n"] for r in discovery.listing_pages(pages_, "listing", "n", "urls", "status").orderBy("n").collect()] == [1, 2]
    from obsidra.sources.paged import PagedJson

    for n in (1, 2):
        (tmp_path / f"p{n}.json").write_text(json.dumps({"items": [{"n": n}]}))
    spark.dataSource.register(PagedJson)
    assert spark.read.format("paged_json").option("template", str(tmp_path / "p{n}.json")).option("pages", 3).load().count() == 2


def test_stores(spark, tmp_path):
    from obsidra.sources import stores

    store = stores.ObjectStore(spark, str(tmp_path / "objects"))
    materials = spark.createDataFrame([("s", "m1", "o1", bytearray(b"one")), ("s", "m2", "o2", bytearray(b"two"))], "source_id string, material_id string, observation_id string, content binary").withColumn("fetched_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    made = stores.raw_objects(materials, F.lit("html"))
    assert store.put(made).count() == 0 and store.put(made).count() == 0 and store.table().count() == 2
    other = made.withColumn("sha256", F.lit("x"))
    assert store.put(other).count() == 2 and store.table().count() == 2
    assert store.list(source_id="s", limit=1).count() == 1 and reports.object_statistics(store.table()).first()["bytes"] == 6
    key = made.first()["object_id"]
    assert bytes(store.read([key]).first()["content"]) in (b"one", b"two")

    from tests_records import rows

    entities = stores.EntityStore(spark, str(tmp_path / "entities"))
    entities.commit(rows(spark, [("e", {"a": "1"}, [], 1, "o1", "d1", 0)]))
    entities.commit(rows(spark, [("e", {"a": "9"}, [], 9, "o9", "d1", 1), ("e", {"b": "2"}, [], 2, "o2", "d2", 2)]))
    assert {r["field"]: r["value"] for r in entities.state().collect()} == {"a": "1", "b": "2"}
    assert entities.entity("e").first()["version"] == 2 and entities.delivery("d2").count() == 1


def test_sampling_series_and_others(spark):
    reserve = spark.createDataFrame([(i, s) for i, s in enumerate("aaabbc")], "i int, shape string")
    seen = spark.createDataFrame([("c", 2)], "shape string, count int")
    assert [r["i"] for r in sampling.pick_diverse(reserve, "shape", "i", 4, seen).collect()] == [0, 3, 1, 4]
    runs = spark.createDataFrame([("h", i, m) for i, m in enumerate([0, 1, 0, 1, 1, 0])], "h string, i int, miss int")
    assert [r["i"] for r in series.running_misses(runs, ["h"], "i", F.col("miss") == 1, 2).orderBy("i").collect()] == [0, 1, 2, 3, 4]
    links = spark.createDataFrame([(f"https://e.com/list/{n}/",) for n in (1, 2, 9)] + [("https://e.com/item/77",)], "url string")
    got = reports.pagination_templates(links, F.col("url")).collect()
    assert [(r["template"], r["pages"]) for r in got] == [("https://e.com/list/{n}/", 3)]
    assert one(spark, reports.problem_signature(F.lit(None).cast("string"), F.lit(None).cast("string"), F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.lit("success"))) == "diagnostics:a,b"
    assert paging.decode_cursor(paging.encode_cursor(["2024", 7])) == ["2024", 7] and paging.clamp_limit(10**9) == 1000
    with pytest.raises(ValueError):
        paging.decode_cursor("!!")
    evidence = dedup.canonical_evidence(spark.createDataFrame([("a", "b", "1"), ("b", None, "1"), ("c", "d", "2")], "url string, canonical string, sha string"))
    assert {r["url"]: r["content"] for r in evidence.collect()} == {"a": "same", "c": "not_sampled"} and dedup.canonical_decision(evidence).first()["use_canonical"]
    table = spark.createDataFrame([("a/b", 1), ("a", 2)], "prefix string, v int")
    assert joins.longest_prefix_join(spark.createDataFrame([("a/b/c",), ("a/x",)], "path string"), "path", table, "prefix").select("path", "match.v").orderBy("path").collect() == [("a/b/c", 1), ("a/x", 2)]
    base, ours, theirs = {"f": "a\nb\nc", "g": "1"}, {"f": "A\nb\nc", "g": "1"}, {"f": "a\nb\nC", "h": "2"}
    assert packages.merge_package(base, ours, theirs) == ({"f": "A\nb\nC", "h": "2"}, [])
    files = {"a.txt": b"1", "tests/b": b"2"}
    assert packages.unpacked(packages.archive(files)) == files and packages.archive_digest(files) == packages.archive_digest(dict(reversed(files.items())))
    forks = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None)], "package_id string, fork_parent string")
    assert {(r["package_id"], r["ancestor"]): r["distance"] for r in packages.lineage(forks).collect()} == {("c", "b"): 1, ("b", "a"): 1, ("c", "a"): 2}
    snapshots = spark.createDataFrame([("k", '{"url":"u","title":5,"tags":["x",1,"y"],"other":"z"}')], "canonical_key string, fields string")
    article = warehouse.article_rows(snapshots).first()
    assert article["url"] == "u" and article["title"] is None and article["extra"]["title"] == "5" and article["extra"]["other"] == "z"
    tags, names = warehouse.article_tags(snapshots)
    assert [r["position"] for r in tags.orderBy("position").collect()] == [0, 2] and names.count() == 2

    def handler(url, content, params):
        if content == "boom":
            raise RuntimeError("no")
        return handlers.success(handlers.Entity("t", {"u": url}, {"n": len(content)})) if content else handlers.unrecognized("blank")

    results = handlers.run_handler(spark.createDataFrame([("m1", "u", "abc"), ("m2", "u", "boom"), ("m3", "u", "")], "material_id string, url string, content string"), handler)
    assert {r["material_id"]: r["status"] for r in results.collect()} == {"m1": "success", "m2": "failed", "m3": "unrecognized"}
    assert handlers.entities_of(results).count() == 1


def test_streams(spark, tmp_path):
    from tests_records import rows

    from obsidra.sources.stores import EntityStore
    from obsidra.streaming import streams

    folder = tmp_path / "in"
    rows(spark, [("e", {"a": "1"}, [], 1, "o1", "d1", 0), ("e", {"a": "2"}, [], 2, "o2", "d2", 1)]).coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema(spark.read.parquet(str(folder)).schema).parquet(str(folder))
    store = EntityStore(spark, str(tmp_path / "store"))
    stream.writeStream.foreachBatch(streams.merge_into(store)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert store.state().first()["value"] == "2"
    budget = spark.readStream.schema(stream.schema).parquet(str(folder)).select(F.lit("s").alias("scope"), F.lit("w").alias("window"), F.lit(3.0).alias("cost"))
    streams.budget_stream(budget, 5.0).writeStream.format("memory").queryName("granted").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["granted"] for r in spark.table("granted").collect()) == [False, True]


def test_materials_and_checks(spark):
    from obsidra.operators import checks
    from obsidra.sources import materials

    page = '<html><head><title>T</title><meta property="article:published_time" content="2024-01-02T03:04:05Z"></head></html>'
    captures = spark.createDataFrame([("https://e.com/a#x", "https://e.com/a", "https://e.com/a", "s", "o1", "text/html", 200, None, page)], "url string, final_url string, canonical_url string, source_id string, observation_id string, media_type string, status int, etag string, body string").withColumn("fetched_at", F.lit("2024-01-03 00:00:00").cast("timestamp"))
    m = materials.web_materials(captures)
    row = m.first()
    assert row["material_id"].startswith("web:") and row["format"]["content_kind"] == "page" and row["metadata"]["title"] == "T" and str(row["published_at"]) == "2024-01-02 03:04:05"
    assert "data" not in materials.without_content(m).first()["content"].asDict()
    index = b"<sitemapindex><sitemap><loc>https://e.com/s1</loc></sitemap><sitemap><loc>https://e.com/s2</loc></sitemap></sitemapindex>"
    one_ = b"<urlset><url><loc>https://e.com/1</loc><lastmod>2024</lastmod></url></urlset>"
    bodies = spark.createDataFrame([("https://e.com/sitemap.xml", bytearray(index)), ("https://e.com/s1", bytearray(one_)), ("https://e.com/s2", bytearray(one_))], "url string, body binary")
    roots = materials.robots_roots(spark.createDataFrame([("https://e.com/robots.txt", "User-agent: *")], "url string, body string"))
    assert [tuple(r) for r in materials.sitemap_walk(bodies, roots).collect()] == [("https://e.com/1", "2024")]
    pages_ = spark.createDataFrame([("a", 1, ["x", "y"], "c1"), ("a", 2, ["y", "z"], "c2"), ("a", 3, ["y"], "c3"), ("a", 4, ["new"], "c4")], "feed string, n int, items array<string>, cur string")
    assert [r["n"] for r in materials.api_pages(pages_, "feed", "n", "items", "cur").orderBy("n").collect()] == [1, 2]
    trace = spark.createDataFrame([("h", f"2024-01-01 00:00:0{i}") for i in range(6)], "host string, start string").withColumn("start", F.to_timestamp("start"))
    assert checks.politeness(trace, 1.0, 0.1).first()["verdict"] == "pass" and checks.politeness(trace, 2.0, 0.1).first()["verdict"] == "fail"
    tries = spark.createDataFrame([("/a", "2024-01-01 00:00:00", 500), ("/a", "2024-01-01 00:00:01", 500), ("/a", "2024-01-01 00:00:03", 200), ("/b", "2024-01-01 00:00:00", 500), ("/b", "2024-01-01 00:00:00.2", 500)], "path string, start string, status int").withColumn("start", F.to_timestamp("start"))
    assert {r["path"]: r["ok"] for r in checks.retry_checks(tries, 3, 1000, 2, 10000).collect()} == {"/a": True, "/b": False}
    assert checks.request_interval(2, 800) == 0.8 and checks.estimated_materials({"strategies": [{"type": "url_template", "values": {"a": [1, 2], "b": [1, 2, 3]}}], "max_materials": 5}) == 5
    assert checks.contract_breaks({"properties": {"a": {"type": "string"}}}, {"properties": {"a": {"type": "integer"}}, "required": ["a"]}) == [("/a", "now required"), ("/a", "type changed")]
    assert checks.example_of({"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 3}}}) == {"n": 3}
    assert checks.sanitized_rules({"strategies": [{"urls": ["https://x.com/", "https://m.e.com/"]}]}, ["e.com"])["strategies"] == [{"urls": ["https://m.e.com/"]}]
    reserve = spark.createDataFrame([(i, "a" if i < 8 else "b") for i in range(10)], "i int, shape string")
    counts = checks.sample_until(reserve, "shape", "i", lambda d: d.select("i", F.upper("shape")), lambda c: len(c) == 2, 2, 6)
    assert counts == {"A": 1, "B": 1}
    catalogue = spark.createDataFrame([("a", "news of kyiv"), ("b", "shop")], "id string, title string")
    assert [r["id"] for r in materials.search_sources(catalogue, "kyiv news", ["title"]).collect()] == ["a"]
    assert checks.verify_projection(spark.createDataFrame([("k", 1), ("l", 1)], "canonical_key string, version int"), spark.createDataFrame([("k", 1)], "canonical_key string, version int")).count() == 1


def test_long_feeds_and_deep_sitemaps_are_whole(spark):
    from obsidra.sources import materials

    feed = b"<rss><channel>" + b"".join(b"<item><link>https://e.com/%d</link></item>" % i for i in range(10_001)) + b"</channel></rss>"
    assert len(one(spark, discovery.feed_entries(F.lit(bytearray(feed))))) == 10_001
    assert len(one(spark, discovery.feed_entries(F.lit(bytearray(feed)), 5))) == 5
    text = "\n".join(f"https://e.com/{i}" for i in range(50_001)).encode()
    got = one(spark, discovery.sitemap_entries(F.lit(bytearray(text))))
    assert len(got["entries"]) == 50_001 and got["dropped"] == 0
    index = "<sitemapindex><sitemap><loc>https://e.com/s{}</loc></sitemap></sitemapindex>"
    rows = [(f"https://e.com/s{i}", bytearray(index.format(i + 1).encode())) for i in range(6)]
    rows.append(("https://e.com/s6", bytearray(b"<urlset><url><loc>https://e.com/deep</loc></url></urlset>")))
    bodies = spark.createDataFrame(rows, "url string, body binary")
    assert [r["url"] for r in materials.sitemap_walk(bodies, spark.createDataFrame([("https://e.com/s0",)], "url string")).collect()] == ["https://e.com/deep"]
