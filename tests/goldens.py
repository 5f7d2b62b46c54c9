"""Functions of single values on cases that take every branch: (arguments as texts or null, and the result as text)."""

from __future__ import annotations

import base64
import gzip
import json

from pyspark.sql import functions as F

from obsidra.functions import documents, keys, pages, text, times, urls
from obsidra.operators import predicates
from obsidra.sources import discovery

CASES, TREES = {}, set()


def cases(name, given, value):
    CASES[name] = (given, value)


def tree_cases(name, given, value):
    """``value`` takes a page's tree."""
    TREES.add(name)
    cases(name, given, value)


_json = F.to_json
ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# ------------------------------------------------------------------ times

cases(
    "strict_timestamps",
    [("2024-01-05T10:00:00Z", "2024-01-05T10:00:00.000000"), ("2024-01-05T10:00:00.123456000+02:00", "2024-01-05T08:00:00.123456"), ("2024-01-05 10:00:00-0330", "2024-01-05T13:30:00.000000"), ("2024-01-05T10:00:00", None), ("2024-01-05T10:00:00.1234567Z", None), ("2024-13-05T10:00:00Z", None), ("today", None), (None, None)],
    lambda t: F.date_format(times.parse_timestamp_strict(t), ISO),
)
cases("strict_dates", [("2024-02-29", "2024-02-29"), ("2023-02-29", None), ("2024-2-9", None), ("2024-02-29T00:00", None), (None, None)], times.parse_date_strict)
cases("strict_clocks", [("09:30", "09:30"), ("23:59:59", "23:59:59"), ("24:00", None), ("9:30", None), ("09:30:61", None), (None, None)], times.parse_clock)
cases(
    "lenient_times",
    [("2024", "2024-01-01T00:00:00.000000"), ("2024-03", "2024-03-01T00:00:00.000000"), ("2024-03-05", "2024-03-05T00:00:00.000000"), ("2024-03-05T10:00:00+02:00", "2024-03-05T08:00:00.000000"), ("Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05T10:00:00.000000"), ("1709632800", "2024-03-05T10:00:00.000000"), ("soon", None), ("", None), (None, None)],
    lambda t: F.date_format(times.parse_datetime_lenient(t), ISO),
)
cases(
    "dates_in_quotes",
    [("2024-03-05", "on 2024-03-05 they met", "true"), ("2024-03-05", "am 05.03.2024", "true"), ("2024-03-05", "5 March saw", "true"), ("2024-03-05", "MARCH 5, late", "true"), ("2024-03-05", "2024-03-06", "false"), ("2024-03-05", None, "false"), (None, "5 March", "false")],
    lambda d, q: times.date_in_quote(d.cast("date"), q),
)
cases(
    "event_date_clamped",
    [("2024-03-05", "2024-03-07", "2024-03-05"), ("2024-03-07", "2024-03-07", "2024-03-07"), ("2024-03-08", "2024-03-07", None), ("2024-02-01", "2024-03-07", None), (None, "2024-03-07", None), ("2024-03-05", None, None)],
    lambda e, p: times.clamp_event_date(e.cast("date"), p.cast("date"), 7),
)

# ------------------------------------------------------------------ text

cases("country_codes", [(" ua ", "UA"), ("Ukraine", "UA"), ("«UKRAINE».", "UA"), ("Atlantis", None), (None, None)], lambda t: text.country_code(t, {"ukraine": "UA", "poland": "PL"}))
cases("actor_slugs", [("European Union", "eu"), ("UKRAINE", "UA"), ("Національний банк України та інші", "natsionalnyi-bank-ukrainy-ta"), ("John O’Neil", "john-oneil"), ("…", None), (None, None)], lambda t: text.actor_slug(t, {"european union": "eu"}, {"ukraine": "UA"}))
cases("valid_ids", [("a", "true"), ("A9._:-x", "true"), ("-a", "false"), ("a b", "false"), ("", "false"), ("x" * 128, "true"), ("x" * 129, "false"), (None, "false")], text.valid_id)
cases("cleaned_texts", [("a&amp;b  c", "a&b c"), (" ﬁne\n\ttext . Now", "fine text. Now"), ("wait !", "wait!"), ("", ""), (None, None)], text.clean)
cases("canonical_texts", [("Straße—ONE_two", "strasse one two"), ("a&nbsp;B!", "a b"), ("...", ""), (None, None)], text.canonical)
cases("truncated_texts", [("abcdef", "abcd\n[... truncated 2 characters]"), ("abcd", "abcd"), ("", ""), (None, None)], lambda t: text.truncate(t, 4))
cases("decoded_texts", [("d0bcd0b8d180", "utf-8", "мир"), ("ece8f0", "windows-1251", "мир"), ("6162ff", "utf-8", "ab�"), ("6162", "no-such", "ab"), ("6162", None, "ab"), (None, "utf-8", None)], lambda h, c: text.decode_text(F.unhex(h), c))
cases("fences_stripped", [("```json\n{\"a\":1}\n```", "{\"a\":1}"), ("  ```\nx\ny\n```  ", "x\ny"), (" plain ", "plain"), ("a ```x``` b", "a ```x``` b"), (None, None)], text.strip_fences)
cases("data_neutralised", [("a </data> b", "a &lt;/data> b"), ("<DATA x>", "&lt;DATA x>"), ("<database>", "<database>"), ("< / data>", "< / data>"), (None, None)], text.neutralise)
cases("templates_rendered", [("Hi {{ name }}, {{a.b}}{{none}}!", "Hi Ann, 7!"), ("no marks", "no marks"), ("{{}}", "{{}}"), (None, None)], lambda t: text.render_template(t, F.create_map(F.lit("name"), F.lit("Ann"), F.lit("a.b"), F.lit("7"))))
cases("numbers_in_texts", [("price 1 234,50 UAH", "1234.5"), ("1,234,567", "1234567.0"), ("1.234.567,8", "1234567.8"), ("-7.5%", "-7.5"), ("12.", "12.0"), ("none", None), (None, None)], text.number_from_text)
cases("quantities", [("2,5 t", "2500.0"), ("300kg", "300.0"), ("4 tons", None), ("12", None), (None, None)], lambda t: text.quantity(t, {"kg": 1.0, "t": 1000.0}))
cases("makes_and_models", [("Land Rover Defender", "land-rover-defender-110", "{\"make\":\"Land\",\"model\":\"Rover Defender\"}"), ("BMW X5", "audi-q7", "{\"make\":\"BMW\",\"model\":\"X5\"}"), ("Tesla", "tesla", "{\"make\":\"Tesla\"}"), (None, None, "{}")], lambda t, s: _json(text.make_model(t, s)))
cases("secrets_redacted", [("key=abc123 abc", "key=*** ***"), ("abcabc123", "******"), ("none", "none"), (None, None)], lambda t: text.redact(t, ["abc", "abc123", ""]))
cases("pointers_escaped", [("a/b~c", "a~1b~0c"), ("~1", "~01"), ("", ""), (None, None)], text.pointer_escape)

# ------------------------------------------------------------------ URLs

cases("same_urls", [("HTTP://E.com:80/a/#x", "http://e.com/a", "true"), ("https://e.com:443/a?x=1", "https://E.com/a?x=1", "true"), ("http://e.com/a", "https://e.com/a", "false"), ("http://e.com/A", "http://e.com/a", "false"), (None, "http://e.com", None)], urls.same_url)
cases("origins", [("https://E.com/a", "https://e.com"), ("http://e.com:8080/?q", "http://e.com:8080"), ("nonsense", None), (None, None)], urls.origin_of)
cases("query_params_set", [("https://e.com/?a=1&b=2#x", "https://e.com/?a=7%208&b=2#x"), ("https://e.com/", "https://e.com/?a=7%208"), ("https://e.com/?aa=1", "https://e.com/?aa=1&a=7%208"), (None, None)], lambda u: urls.set_query_param(u, "a", F.lit("7 8")))
cases("segment_shapes", [("123", "*"), ("deadbeef01", "*"), ("some-long-slug", "*"), ("ab1234", "*"), ("Product", "product"), ("page-2.html", "*.html"), ("Index.HTML", "index.html"), ("", ""), (None, None)], urls.segment_shape)
cases(
    "content_kinds",
    [("text/html", "https://e.com/", "page"), ("application/xhtml+xml", "x", "page"), ("application/atom+xml", "x", "feed"), ("application/xml", "https://e.com/Sitemap.xml", "sitemap"), ("application/gzip", "https://e.com/sitemap.gz", "sitemap"), ("application/xml", "https://e.com/a.xml", "file"), ("application/ld+json", "x", "json"), ("image/png", "x", "file")],
    urls.content_kind,
)
cases(
    "urls_normalised",
    [("HTTP://Example.COM:80/a/../b/./c?b=2&a=1#f", "http://example.com/b/c?a=1&b=2"), ("https://e.com", "https://e.com/"), ("https://e.com/%7euser/%2f?q=a b", "https://e.com/~user/%2F?q=a%20b"), ("https://e.com/a/", "https://e.com/a"), ("https://e.com/?utm_source=x&k=&ref=1", "https://e.com/?k="), ("https://e.com:8443/x", "https://e.com:8443/x"), ("https://пример.рф/", "https://xn--e1afmkfd.xn--p1ai/"), ("mailto:a@b", None), ("https://e.com:port/", None), ("  ", None), (None, None)],
    lambda u: urls.url_normalize(u, urls.UrlRules(strip_params=("utm_*", "ref"), trailing_slash="remove")),
)

# ------------------------------------------------------------------ JSON documents

_DOC = '{"a":[{"b":1},{"b":2,"c":{"b":3}}],"d":null}'
for _name, _path, _want in [("key_and_index", "$.a[0].b", '["1"]'), ("wildcard", "$.a[*].b", '["1","2"]'), ("last_index", "$.a[-1].b", '["2"]'), ("descent", "$..b", '["1","2","3"]'), ("null_member", "$.d", '["null"]'), ("missing", "$.x.y", "[]")]:
    cases(f"json_path_{_name}", [(_DOC, _want), ("{broken", "[]"), (None, "[]")], lambda d, p=_path: _json(documents.json_path(d, p)))
cases("json_canonical", [('{"b": 1.5, "a": ["x", null], "ї": true}', '{"a":["x",null],"b":1.5,"ї":true}'), ("[]", "[]"), ("{", None), (None, None)], documents.canonical_json)
cases("json_flattened", [('{"a": {"b": 1, "c": {"d": "x"}}, "e": [1, 2]}', '{"a.b":"1","a.c.d":"\\"x\\"","e":"[1, 2]"}'), ("{}", "{}"), (None, None)], lambda d: _json(documents.flatten_json(d)))
cases("json_list_positions", [('{"tags": ["a", 7, "b"]}', '[{"pos":0,"value":"a"},{"pos":1,"misfit":"7"},{"pos":2,"value":"b"}]'), ('{"tags": []}', "[]"), ("{}", None), (None, None)], lambda d: _json(documents.positioned(F.try_parse_json(d), "tags")))
cases("json_unknown_members", [('{"a":"1","x":"2","y":"3"}', '{"x":"2","y":"3"}'), ('{"a":"1"}', "{}"), (None, None)], lambda d: _json(documents.unknown_members(F.from_json(d, "map<string,string>"), ["a", "b"])))
_EXACT = [
    ('{"a":1,"b":[1,2]}', '{"b":[1,2],"a":1.0}', "[]"), ('{"a":1}', '{"a":true}', '[{"pointer":"/a","expected":"1","actual":"true"}]'), ('{"a":{"x/y":1}}', '{"a":{}}', '[{"pointer":"/a/x~1y","expected":"1","actual":"null"}]'),
    ("{}", '{"n":2}', '[{"pointer":"/n","expected":"null","actual":"2"}]'), ('{"l":[1,2]}', '{"l":[2]}', '[{"pointer":"/l/length","expected":"2","actual":"1"},{"pointer":"/l/0","expected":"1","actual":"2"}]'),
]
cases("json_compared_exactly", _EXACT, lambda a, b: _json(documents.compare_output(a, b)))
cases("json_compared_as_subset", [('{"l":[{"k":2}]}', '{"l":[{"k":1},{"k":2,"m":0}],"x":1}', "[]"), ('{"l":[1,1]}', '{"l":[1,2]}', '[{"pointer":"/l/1","expected":"1","actual":"2"}]'), ('{"a":1}', "{}", '[{"pointer":"/a","expected":"1","actual":"null"}]')], lambda a, b: _json(documents.compare_output(a, b, "subset")))
cases("json_validated", [('{"n":1,"s":"x","o":{"b":true}}', "[]"), ('{"n":"1","s":2,"o":{}}', '["/n","/s","/o/b"]'), ("[1", '["/"]'), (None, '["/"]')], lambda d: _json(documents.validation_problems(d, {"n": "number", "s": "string", "o.b": "boolean"})))
cases("files_compared", [("a\nb\n", "a\nc\n", "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n"), ("a\n", "a\n", ""), (None, "x", "--- a/f\n+++ b/f\n@@ -0,0 +1 @@\n+x")], lambda a, b: documents.diff_files(a, b, "f"))
cases(
    "lines_merged",
    [("a\nb\nc\nd", "a\nB\nc\nd", "a\nb\nc\nD", '{"text":"a\\nB\\nc\\nD","conflicts":0}'), ("a\nb\nc", "a\nX\nc", "a\nY\nc", '{"text":"a\\n<<<<<<< ours\\nX\\n=======\\nY\\n>>>>>>> theirs\\nc","conflicts":1}'), ("a", "a", "b", '{"text":"b","conflicts":0}'), ("a\nb", "a", "a\nb", '{"text":"a","conflicts":0}')],
    lambda a, b, c: _json(documents.merge3_lines(a, b, c)),
)
cases(
    "json_merged",
    [('{"a":1,"b":1}', '{"a":2,"b":1}', '{"a":1,"b":3}', '{"document":"{\\"a\\":2,\\"b\\":3}","conflicts":[]}'), ('{"a":1}', '{"a":2}', '{"a":3}', '{"document":"{\\"a\\":2}","conflicts":["/a"]}'), ('{"a":1}', "{}", '{"a":1,"n":5}', '{"document":"{\\"n\\":5}","conflicts":[]}')],
    lambda a, b, c: _json(documents.merge3_json(a, b, c)),
)
cases("members_changed", [('{"a":"1","token":"x"}', '{"a":"2","token":"y","n":"0"}', '[{"name":"a","before":"1","after":"2"},{"name":"n","after":"0"},{"name":"token","before":"***","after":"***"}]'), ('{"a":"1"}', '{"a":"1"}', "[]")], lambda a, b: _json(documents.changed_members(F.from_json(a, "map<string,string>"), F.from_json(b, "map<string,string>"))))
_GZ = base64.b64encode(gzip.compress(b"hello", mtime=0)).decode()
cases("bodies_unpacked", [(_GZ, "hello"), (base64.b64encode(b"plain").decode(), "plain"), (base64.b64encode(b"\x1f\x8bbroken").decode(), None), (base64.b64encode(gzip.compress(b"x" * 100, mtime=0)).decode(), None), (None, None)], lambda b: F.decode(documents.gunzipped(F.unbase64(b), 64), "utf-8"))

# ------------------------------------------------------------------ pages

cases("page_base", [('<base href="https://e.com/x/">', "https://e.com/x/"), ("<BASE target=_top href=/y>", "/y"), ("<p>", None), (None, None)], pages.base_href)
cases(
    "page_metadata",
    [('<title> A  b </title><meta property="article:published_time" content="2024-01-01">', '{"title":"A b","published":"2024-01-01"}'), ('<meta content="OG" property="og:title"><title>T</title><meta itemprop="dateModified" content="2024-02-02">', '{"title":"OG","modified":"2024-02-02"}'), ("<p>", "{}")],
    lambda p: _json(pages.html_meta(p)),
)
cases("page_canonical", [('<link rel="canonical" href="https://e.com/a">', "https://e.com/a"), ("<link href='/b' rel=canonical>", "/b"), ('<!-- <link rel="canonical" href="/no"> -->', None), ('<link rel="alternate" href="/c">', None)], pages.declared_canonical)
cases("page_charset", [("text/html; charset=KOI8-R", "61", "koi8-r"), (None, "3c6d65746120636861727365743d22757466" "2d38223e", "utf-8"), (None, "d0bc", "utf-8"), ("text/html", "ece8f0", "windows-1251"), (None, None, "utf-8")], lambda h, b: pages.charset_of(h, F.unhex(b)))
for _source, _want in [("a_href", '[" /a ","/n"]'), ("link_rel", '["/c","/alt"]'), ("canonical", '["/c"]'), ("pagination_rel", '["/n"]')]:
    tree_cases(f"page_links_{_source}", [('<link rel="canonical" href="/c"><link rel=alternate href=/alt><a href=" /a ">x</a><a rel="next nofollow" href="/n">2</a><script><a href="/no"></script>', _want), ("<p>", "[]"), (None, "[]")], lambda t, s=_source: _json(pages.extract_hrefs(t, sources=(s,))))
_LD = '<script type="application/ld+json">%s</script>'
tree_cases("page_breadcrumb", [(_LD % '{"@type":"BreadcrumbList","itemListElement":[{"position":2,"item":{"name":"B"}},{"position":1,"name":"A"}]}', '["A","B"]'), (_LD % "{broken", "[]"), (None, "[]")], lambda t: _json(pages.breadcrumb(t)))
tree_cases("page_attributes", [("<table><tr><th>Color:</th><td> dark  red </td></tr><tr><td>only</td></tr></table><dl><dt>Size</dt><dd>10</dd><dt>Color</dt><dd>no</dd></dl>", '{"Color":"dark red","Size":"10"}'), ("<p>", "{}"), (None, "{}")], lambda t: _json(pages.attributes_table(t)))
tree_cases("page_items", [(_LD % '{"@graph":[{"@type":["ItemList"],"itemListElement":[{"position":3,"url":"/a","name":"A"},{"item":{"@id":"/b","name":"B"}}]}]}', '[{"position":3,"url":"/a","name":"A"},{"position":2,"url":"/b","name":"B"}]'), ("<p>", "[]"), (None, "[]")], lambda t: _json(pages.item_list(t)))
tree_cases("page_cards", [('<div class="card x"><a href="/1">One <b>1</b></a></div><div class="card"><a href="/2">Two</a></div>', '[{"href":"/1","text":"One 1"},{"href":"/2","text":"Two"}]'), ("<p>", "[]"), (None, None)], lambda t: _json(pages.cards(t, ".card")))
cases("message_places", [("ab 12 cd 345", '[{"pos":0,"text":"12"},{"pos":1,"text":"345"}]'), ("none", "[]"), (None, None)], lambda t: _json(pages.message_events(t, r"\d+")))

# ------------------------------------------------------------------ discovery

cases("robots_sitemap_lines", [("User-agent: *\nSitemap: https://e.com/a.xml\nsitemap : https://e.com/b.xml\nSitemap: https://e.com/a.xml", '["https://e.com/a.xml","https://e.com/b.xml"]'), ("Disallow: /", "[]"), (None, None)], lambda t: _json(discovery.robots_sitemaps(t)))
cases(
    "sitemap_parsed",
    [
        ('<urlset xmlns="s"><url><loc> https://e.com/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://e.com/2</loc></url><url><loc>https://e.com/3</loc></url></urlset>', '{"kind":"urlset","entries":[{"url":"https://e.com/1","lastmod":"2024-01-01"},{"url":"https://e.com/2"}],"dropped":1}'),
        ("<sitemapindex><sitemap><loc>https://e.com/s.xml</loc></sitemap></sitemapindex>", '{"kind":"sitemapindex","entries":[{"url":"https://e.com/s.xml"}],"dropped":0}'),
        ("https://e.com/t\nnot a url\n", '{"kind":"text","entries":[{"url":"https://e.com/t"}],"dropped":0}'), ("<!DOCTYPE x [<!ENTITY y 'z'>]><urlset/>", '{"kind":"unknown","entries":[],"dropped":0}'), ("<broken", '{"kind":"unknown","entries":[],"dropped":0}'), (None, '{"kind":"unknown","entries":[],"dropped":0}'),
    ],
    lambda b: _json(discovery.sitemap_entries(b.cast("binary"), 2)),
)
cases(
    "feed_parsed",
    [
        ("<rss><channel><item><link>https://e.com/1</link><pubDate>Tue</pubDate></item><item><guid>https://e.com/g</guid></item><item><guid isPermaLink='false'>https://e.com/no</guid></item></channel></rss>", '[{"url":"https://e.com/1","lastmod":"Tue"},{"url":"https://e.com/g"}]'),
        ('<feed xmlns="a"><entry><link rel="self" href="/s"/><link href="/alt"/><updated>2024</updated></entry></feed>', '[{"url":"/alt","lastmod":"2024"}]'), ("<no", "[]"), (None, "[]"),
    ],
    lambda b: _json(discovery.feed_entries(b.cast("binary"))),
)
cases("feeds_discovered", [('<link rel="alternate" type="application/rss+xml" href="/rss"><link rel="alternate" hreflang="de" href="/de"><link rel=alternate type=application/atom+xml href=/atom>', '["/rss","/atom"]'), ("<p>", "[]"), (None, None)], lambda p: _json(discovery.feed_autodiscovery(p)))
cases("api_items_read", [('{"data":{"items":[{"id":1,"u":"/1","t":"x"},{"id":2}]}}', '[{"url":"/1","lastmod":"x","item":"{\\"id\\":1,\\"t\\":\\"x\\",\\"u\\":\\"/1\\"}"},{"item":"{\\"id\\":2}"}]'), ('{"data":{}}', "[]"), ("{", "[]"), (None, "[]")], lambda b: _json(discovery.api_items(b, "$.data.items", "$.u", "$.t")))
cases("listing_digested", [("b,a", "32"), ("a,b", "32"), ("", "32")], lambda t: F.length(discovery.listing_digest(F.split(t, ","))))
cases(
    "content_decoded",
    [("inline", "base64", "aGk=", None, "hi"), ("inline", "utf-8", "hi", None, "hi"), ("inline", "utf-8", "hi", "8f434346648f6b96df89dda901c5176b10a6d83961dd3c1ac88b59b2dc327aa4", "hi"), ("inline", "utf-8", "hi", "00", None), ("object", "utf-8", "hi", None, None), ("inline", "base64", "%%", None, None)],
    lambda k, e, d, s: F.decode(discovery.content_bytes(k, e, d, s), "utf-8"),
)

# ------------------------------------------------------------------ robots, packages, schedules

_ROBOTS = "User-agent: BotLong\nDisallow: /a%20b\nCrawl-delay: 1.5\nCrawl-delay: x\n\nUser-agent: *\nUser-agent: other\nDisallow:\nDisallow: /p\nCrawl-delay: 3\nCrawl-delay: 2\n"
for _agent, _rules, _delay in [("Bot", '[{"allow":false,"path":"/a b"}]', "1.5"), ("botlonger/2", '[{"allow":false,"path":"/a b"}]', "1.5"), ("zz", '[{"allow":false,"path":"/p"}]', "3.0"), ("other", '[{"allow":false,"path":"/p"}]', "3.0")]:
    cases(f"robots_rules_for_{_agent.partition('/')[0].lower()}", [(_ROBOTS, _rules), ("", "[]"), (None, "[]")], lambda t, a=_agent: _json(predicates.robots_parsed(t, a)))
    cases(f"robots_delay_for_{_agent.partition('/')[0].lower()}", [(_ROBOTS, _delay), ("", None), (None, None)], lambda t, a=_agent: predicates.robots_delay(t, a))
cases("robots_outcomes", [("200", "parse"), ("299", "parse"), ("404", "allow_all"), ("503", "disallow_all"), ("301", "disallow_all"), (None, "disallow_all")], lambda s: predicates.robots_outcome(s.cast("int")))
cases("media_accepted", [("text/html", "true"), ("text/*", "true"), ("*/*", "true"), ("image/png", "false"), ("text/plain", "false")], lambda m: predicates.media_matches(F.array(m), "text/html"))
cases("quotes_checked", [("a  b\nc d", "b c", "true"), ("abc", "x", "false"), ("abc", " ", "false"), ("abc", None, "false"), (None, "a", "false")], predicates.quote_check)
cases(
    "package_filter",
    [("extractor", "news,web", "text/*", "e.com", "true"), ("storage", "news", "text/*", "e.com", "false"), ("extractor", "web", "text/*", "e.com", "false"), ("extractor", "news", "image/png", "e.com", "false"), ("extractor", "news", "*/*", "other.com", "false")],
    lambda k, t, m, d: predicates.package_matches({"kind": k, "tags": F.split(t, ","), "media_types": F.array(m), "domains": F.array(d), "package_id": F.lit("p.news"), "title": F.lit("News"), "description": F.lit("x"), "entity_types": F.array(F.lit("a"))}, kind="extractor", tag="news", media="text/html", domain="m.e.com", text="NEWS"),
)
cases(
    "schedule_next",
    [("2024-01-31T23:50:00", "2024-02-01T00:00:00"), ("2024-01-01T00:00:00", "2024-01-01T00:15:00"), ("2024-12-31T23:59:59", "2025-01-01T00:00:00")],
    lambda t: F.date_format(times.next_fires("*/15 * * * *", t.cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss"),
)
cases(
    "schedule_next_weekday",
    [("2024-01-01T00:00:00", "2024-01-05T07:30:00"), ("2024-01-05T08:00:00", "2024-01-12T07:30:00"), ("2024-07-05T00:00:00", "2024-07-05T06:30:00")],
    lambda t: F.date_format(times.next_fires("30 9 * * fri", t.cast("timestamp"), "Europe/Kyiv"), "yyyy-MM-dd'T'HH:mm:ss"),
)

# ------------------------------------------------------------------ keys

cases("safe_segments", [("a/b:c", "a_b_c"), ("...", "_"), ("CON.txt", "_CON.txt"), ("com1", "_com1"), (".hid", "hid"), ("", "_"), (None, None)], keys.safe_segment)
cases("canonical_scopes", [('a|b|{"x":"1"}', "a|b"), ('shop|{"sku":"A|{"}', 'shop|{"sku":"A'), ("none", ""), (None, None)], keys.canonical_scope)
cases("natural_keys", [("1", "ї", '{"a":"1","b":"ї"}'), ("q\"", "", '{"a":"q\\"","b":""}'), (None, "x", None), ("x", None, None)], lambda a, b: keys.build_key([("b", b), ("a", a)]))
cases("object_deliveries", [("d", "0", "d"), ("d", "1", "d#raw1"), (None, "0", None)], lambda d, i: keys.object_delivery_key(d, i.cast("int")))
cases("entity_deliveries", [("d", "0", "d#0"), ("d", "12", "d#12"), (None, "1", None)], lambda d, i: keys.entity_delivery_key(d, i.cast("int")))
cases("channel_materials_ids", [("chan", "7", "tg:chan:7"), ("-100", "0", "tg:-100:0"), (None, "7", None)], keys.channel_material_id)
