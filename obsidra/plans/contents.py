"""Functions of single values over what the tables hold: texts, pages, addresses, documents, prices, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as docs_
from ..functions import keys, pages, selectors, text, times, urls
from ..functions.elements import page_tree
from ..operators import predicates
from ..session import spread, table
from ..sources import discovery
from .registry import query


def _sha(column):
    return F.sha2(F.coalesce(column, F.lit("")), 256)


# ------------------------------------------------------------------ pages by selectors


@query(r"SELECT page_id, CAST(i // 2 AS BIGINT) AS pos, l[i + 1] AS href FROM (SELECT page_id, l, unnest(range(0, len(l), 2)) AS i FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\"', 1) AS l FROM pages))")
def links_by_css(spark, sf):
    rows = pages.link_rows(spread(table(spark, sf, "pages"), "page_id").select("page_id", "html"), "nav > ul > li:nth-child(odd) > a[href^='/']")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query(r"SELECT page_id, CAST(0 AS BIGINT) AS pos, l[-1] AS href FROM (SELECT page_id, regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<li><a href=\"([^\"]*)\"', 1) AS l FROM pages) WHERE len(l) > 0")
def links_by_xpath(spark, sf):
    rows = pages.link_rows(spread(table(spark, sf, "pages"), "page_id").select("page_id", "html"), "//nav//li[last()]/a/@href", "xpath")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "href")


#: A page's head with links of every kind, made of its own address.
_HEAD = "'<head><base href=\"' || url || '\"><link rel=\"stylesheet\" href=\"/s.css\"><link href=''' || url || ''' rel=\"Canonical nofollow\"><link rel=next href=/next>'"


def _with_head(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id")
    return p.withColumn("html", F.replace("html", F.lit("<head>"), F.expr(_HEAD.replace("''' || url || '''", "\\'' || url || '\\'"))))


@query("SELECT page_id, source, pos, href FROM (SELECT page_id, 'canonical' AS source, CAST(0 AS BIGINT) AS pos, url AS href FROM pages UNION ALL SELECT page_id, 'link_rel', 0, url FROM pages UNION ALL SELECT page_id, 'link_rel', 1, '/next' FROM pages UNION ALL SELECT page_id, 'pagination_rel', 0, '/next' FROM pages UNION ALL SELECT page_id, 'by_rel', 0, '/next' FROM pages)")
def links_by_source(spark, sf):
    """Links of every source in pages whose heads name canonical, next and stylesheet."""
    t = _with_head(spark, sf).select("page_id", page_tree(F.col("html")).alias("tree"))
    found = {s: pages.extract_hrefs(F.col("tree"), sources=(s,)) for s in ("canonical", "link_rel", "pagination_rel")} | {"by_rel": pages.extract_hrefs(F.col("tree"), "NEXT", "rel")}
    rows = t.select("page_id", F.explode(F.array(*[F.struct(F.lit(s).alias("source"), c.alias("hrefs")) for s, c in found.items()])).alias("f"))
    return rows.select("page_id", "f.source", F.posexplode("f.hrefs").alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


@query(r"SELECT target, count(*) AS in_degree FROM (SELECT DISTINCT page_id, regexp_extract(url, '^https?://[^/?#]+') || h AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"(/[^\"]*)\"', 1)) AS h FROM pages)) GROUP BY 1")
def page_link_graph(spark, sf):
    p = pages.page_links(spread(table(spark, sf, "pages"), "page_id").select("url", "html")).select(F.explode("links").alias("target"))
    return p.groupBy("target").agg(F.count(F.lit(1)).alias("in_degree"))


@query("SELECT page_id, url AS base, url AS canonical FROM pages")
def bases_and_canonicals(spark, sf):
    return _with_head(spark, sf).select("page_id", pages.base_href(F.col("html")).alias("base"), pages.declared_canonical(F.col("html")).alias("canonical"))


@query("SELECT page_id, 'utf-8' AS plain, CASE WHEN page_id % 2 = 0 THEN 'koi8-r' ELSE 'utf-8' END AS named FROM pages")
def charsets_of_pages(spark, sf):
    body = F.encode(F.regexp_replace("html", "<meta charset=[^>]*>", ""), "utf-8")
    header = F.when(F.col("page_id") % 2 == 0, F.lit("text/html; Charset=\"KOI8-R\""))
    return table(spark, sf, "pages").select("page_id", pages.charset_of(F.lit("text/html"), body).alias("plain"), pages.charset_of(header, F.encode("html", "utf-8")).alias("named"))


@query("SELECT page_id, octet_length(encode(html)) <= 2000 AS as_it_is, true AS fits, true AS whole FROM pages")
def pages_leaned(spark, sf):
    lean = pages.lean_html(F.col("html"), 2000)
    kept = lean.contains("<nav>") & ~lean.contains("<style>") & ~lean.contains("track(")
    return table(spark, sf, "pages").select("page_id", (lean == F.col("html")).alias("as_it_is"), (F.octet_length(lean) <= 2000).alias("fits"), ((lean == F.col("html")) | kept).alias("whole"))


@query(r"SELECT page_id, '[page] ' || trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))[1:600 - 8] AS first, true AS fits FROM pages")
def page_digests(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id").select("page_id", "html", page_tree(F.col("html")).alias("tree"))
    digest = pages.html_digest(F.col("html"), F.col("tree"), 4000)
    return p.select("page_id", F.substring_index(digest, "\n", 1).alias("first"), ((F.length(digest) <= 4000) & digest.contains("\n[links] /") & digest.contains("\n[text] ")).alias("fits"))


@query("SELECT page_id, CAST(i AS BIGINT) AS pos, hrefs[i + 1] AS href, texts[i + 1] AS text FROM (SELECT page_id, unnest(range(0, len(hrefs))) AS i, hrefs, texts FROM (SELECT page_id, regexp_extract_all(nav, 'href=\"([^\"]*)\"', 1) AS hrefs, regexp_extract_all(nav, '>([^<]*)</a>', 1) AS texts FROM (SELECT page_id, regexp_extract(html, '<nav>(.*?)</nav>', 1) AS nav FROM pages)))")
def tiles_of_pages(spark, sf):
    p = spread(table(spark, sf, "pages"), "page_id").select("page_id", page_tree(F.col("html")).alias("tree"))
    return p.select("page_id", F.posexplode(pages.cards(F.col("tree"), "nav li")).alias("pos", "t")).select("page_id", F.col("pos").cast("long").alias("pos"), "t.href", "t.text")


# ------------------------------------------------------------------ structured data of pages made of parts

def _page_of(*nodes):
    script = [F.concat(F.lit('<script type="application/ld+json">'), F.to_json(n), F.lit("</script>")) for n in nodes]
    return F.concat(F.lit("<html><head>"), *script, F.lit("</head><body><p>x</body>"))


@query("SELECT 'https://e.com/p/' || p_partkey AS url, p_name AS name, CAST(p_partkey AS VARCHAR) AS sku, CAST(p_size AS VARCHAR) AS price, 'EUR' AS currency, p_brand AS availability FROM part")
def products_of_pages(spark, sf):
    """Products in a graph, with one offer each, by key in turn as an object or in a list."""
    url = F.concat(F.lit("https://e.com/p/"), F.col("p_partkey"))
    offer = F.struct(F.col("p_size").cast("string").alias("price"), F.lit("EUR").alias("priceCurrency"), F.concat(F.lit("https://schema.org/"), F.col("p_brand")).alias("availability"))
    node = lambda offers: F.struct(F.struct(F.array(F.lit("Product"), F.lit("Thing")).alias("@type"), F.col("p_name").alias("name"), F.col("p_partkey").alias("sku"), offers.alias("offers")).alias("@graph"))
    html = F.when(F.col("p_partkey") % 2 == 0, _page_of(node(offer))).otherwise(_page_of(node(F.array(offer))))
    return pages.ld_products(spread(table(spark, sf, "part"), "p_partkey").select(url.alias("url"), html.alias("html")))


@query("SELECT p_partkey, p_type || '>' || p_brand || '>' || p_name AS path FROM part")
def breadcrumbs_of_pages(spark, sf):
    step = lambda at, name: F.struct(F.lit(at).alias("position"), F.struct(F.col(name).alias("name")).alias("item"))
    node = F.struct(F.lit("BreadcrumbList").alias("@type"), F.array(step(3, "p_name"), step(1, "p_type"), step(2, "p_brand")).alias("itemListElement"))
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", page_tree(_page_of(node)).alias("tree"))
    return p.select("p_partkey", F.array_join(pages.breadcrumb(F.col("tree")), ">").alias("path"))


@query("SELECT p_partkey, 1 AS position, '/b/' || p_brand AS url, p_brand AS name FROM part UNION ALL SELECT p_partkey, 7, '/n/' || p_partkey, p_name FROM part")
def items_of_pages(spark, sf):
    plain = F.struct(F.lit("ListItem").alias("@type"), F.lit(None).cast("int").alias("position"), F.concat(F.lit("/b/"), "p_brand").alias("url"), F.col("p_brand").alias("name"), F.lit(None).cast("struct<`@id`:string,name:string>").alias("item"))
    inner = F.struct(F.concat(F.lit("/n/"), F.col("p_partkey")).alias("@id"), F.col("p_name").alias("name"))
    other = F.struct(F.lit("ListItem").alias("@type"), F.lit(7).alias("position"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("name"), inner.alias("item"))
    node = F.struct(F.lit("ItemList").alias("@type"), F.array(plain, other).alias("itemListElement"))
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", page_tree(_page_of(F.struct(node.alias("mainEntity")))).alias("tree"))
    return p.select("p_partkey", F.explode(pages.item_list(F.col("tree"))).alias("i")).select("p_partkey", "i.position", "i.url", "i.name")


@query("SELECT p_partkey, p_brand AS brand, p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(3 AS BIGINT) AS members FROM part")
def attributes_of_pages(spark, sf):
    html = F.concat(
        F.lit("<table><tr><th>Brand:</th><td>"), "p_brand", F.lit("</td></tr><tr><td>only</td></tr><tr><td> Name <td><b>"), "p_name", F.lit("</b></table><dl><dt>Size<dd>"),
        F.col("p_size").cast("string"), F.lit("<dt>Brand<dd>other</dl>"),
    )
    p = spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", page_tree(html).alias("t")).select("p_partkey", pages.attributes_table(F.col("t")).alias("a"))
    return p.select("p_partkey", F.col("a")["Brand"].alias("brand"), F.col("a")["Name"].alias("name"), F.col("a")["Size"].alias("size"), F.size("a").cast("long").alias("members"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'body of ' || p_name WHEN 1 THEN 'own ' || p_name || ' inner end' WHEN 2 THEN NULL WHEN 3 THEN 'open ' || p_brand ELSE 'free ' || p_name END AS body,"
       " CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 4 THEN p_brand ELSE p_name END AS title, CASE p_partkey % 5 WHEN 2 THEN 'no article' WHEN 4 THEN 'paywall' END AS problem FROM part")
def articles_bound(spark, sf):
    """Articles by binding to the address, nested and unclosed articles, pages without one, and paid ones."""
    url = F.concat(F.lit("https://e.com/n/"), F.col("p_partkey"), F.lit("?b=2&a=1"))
    named = lambda address, body, headline, free: F.struct(F.lit("NewsArticle").alias("@type"), F.struct(address.alias("@id")).alias("mainEntityOfPage"), body.alias("articleBody"), headline.alias("headline"), free.alias("isAccessibleForFree"))
    mine = F.concat(F.lit("/n/"), F.col("p_partkey"), F.lit("/?a=1&b=2#x"))
    other = named(F.lit("https://e.com/other"), F.lit("a far longer body of another page"), F.lit("no"), F.lit(True))
    kinds = {
        0: _page_of(F.array(other, named(mine, F.concat(F.lit("body of "), "p_name"), F.col("p_brand"), F.lit(True)))),
        1: F.concat(F.lit("<article><h1>"), "p_name", F.lit("</h1><nav>menu</nav>own "), "p_name", F.lit("<article>inner<p hidden>secret</article><aside>ad</aside> end</article><article>next</article>")),
        2: F.concat(F.lit("<title>"), "p_name", F.lit("</title><p>list")),
        3: F.concat(F.lit("<div><h1>"), "p_name", F.lit("</h1><article>open <!-- x --><script>1</script>"), "p_brand", F.lit("</div><footer>f</footer>")),
        4: _page_of(named(F.lit(None).cast("string"), F.concat(F.lit("free "), "p_name"), F.col("p_brand"), F.lit(False))),
    }
    html = F.lit(None).cast("string")
    for k, made in kinds.items():
        html = F.when(F.col("p_partkey") % 5 == k, made).otherwise(html)
    found = pages.page_articles(spread(table(spark, sf, "part"), "p_partkey").select("p_partkey", "p_name", url.alias("url"), html.alias("html")))
    body = F.when(F.col("p_partkey") % 5 == 1, F.regexp_replace("body", F.concat(F.lit("^"), F.col("p_name"), F.lit(" ")), F.lit(""))).otherwise(F.col("body"))
    return found.select("p_partkey", body.alias("body"), "title", "problem")


# ------------------------------------------------------------------ texts


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), ' ([,.;:!?])', '\1', 'g')) AS clean FROM documents")
def texts_cleaned(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean(F.col("text")).alias("clean"))


@query(r"SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS words FROM documents")
def texts_for_comparing(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.canonical(F.col("text")).alias("words"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE text[1:300] || chr(10) || '[... truncated ' || (length(text) - 300) || ' characters]' END AS cut FROM documents")
def texts_truncated(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.truncate(F.col("text"), 300).alias("cut"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def texts_decoded(spark, sf):
    """Bytes in UTF-16, UTF-8 and of an unknown charset, read back."""
    kind = F.col("doc_id") % 3
    raw = F.when(kind == 0, F.encode("text", "UTF-16BE")).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", _sha(text.decode_text(raw, F.when(kind == 0, "utf-16-be").when(kind == 1, "no-such"))).alias("sha"))


@query("SELECT conv_id, turn, trim(text, chr(32)) AS inner FROM conversations")
def fences_removed(spark, sf):
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" ```json\n"), F.trim("text"), F.lit("\n``` "))).otherwise(F.concat(F.lit("  "), "text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", text.strip_fences(fenced).alias("inner"))


@query(r"SELECT page_id, sha256(regexp_replace(html, '(?i)<(/?\s*nav\b)', '&lt;\1', 'g')) AS sha FROM pages")
def marks_neutralised(spark, sf):
    return table(spark, sf, "pages").select("page_id", _sha(text.neutralise(F.col("html"), "nav")).alias("sha"))


@query("SELECT doc_id, source || '/' || lang || ': ' || coalesce(text[1:40], '') || '!' AS said FROM documents")
def templates_filled(spark, sf):
    values = F.create_map(F.lit("source"), "source", F.lit("doc.lang"), "lang", F.lit("start"), F.coalesce(F.substring("text", 1, 40), F.lit("")))
    return table(spark, sf, "documents").select("doc_id", text.render_template(F.lit("{{source}}/{{ doc.lang }}: {{start}}{{none}}!"), values).alias("said"))


@query(r"SELECT doc_id, TRY_CAST(regexp_replace(CASE WHEN regexp_matches(d, '^-?\d{1,3}(,\d{3})+(\.\d+)?$') THEN replace(d, ',', '') WHEN regexp_matches(d, '^-?\d{1,3}(\.\d{3})+(,\d+)?$') THEN replace(replace(d, '.', ''), ',', '.') ELSE replace(d, ',', '.') END, '\.$', '') AS DOUBLE) AS number"
       r" FROM (SELECT doc_id, regexp_replace(regexp_extract(text, '-?\d[\d\s  .,]*'), '[\s  ]', '', 'g') AS d FROM documents)")
def numbers_of_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.number_from_text(F.col("text")).alias("number"))


@query("SELECT p_partkey, round(p_size * CASE WHEN p_partkey % 3 = 0 THEN 1000 WHEN p_partkey % 3 = 1 THEN 1 END, 3) AS kilos FROM part")
def quantities_of_texts(spark, sf):
    said = F.concat("p_name", F.lit(" weighs "), F.col("p_size").cast("string"), F.element_at(F.array(F.lit(" t."), F.lit("kg"), F.lit(" tons")), (F.col("p_partkey") % 3 + 1).cast("int")))
    return table(spark, sf, "part").select("p_partkey", F.round(text.quantity(said, {"kg": 1.0, "t": 1000.0}), 3).alias("kilos"))


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS make, nullif(p_name[length(split_part(p_name, ' ', 1)) + 2:], '') AS model FROM part")
def makes_of_titles(spark, sf):
    slug = F.concat(F.lower(F.substring_index("p_name", " ", 1)), F.lit("-"), F.lower("p_brand"))
    return table(spark, sf, "part").select("p_partkey", text.make_model(F.col("p_name"), slug).alias("m")).select("p_partkey", "m.make", "m.model")


@query("SELECT doc_id, sha256(coalesce(replace(replace(text, 'token = ', '***'), 'the', '***'), '')) AS sha FROM documents")
def secrets_in_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", _sha(text.redact(F.col("text"), ["the", "token = ", ""])).alias("sha"))


@query("SELECT page_id, replace(replace(url, '~', '~0'), '/', '~1') AS token FROM pages")
def pointers_of_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.pointer_escape(F.col("url")).alias("token"))


@query("SELECT c_custkey, regexp_matches(c_name, '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS whole, regexp_matches(replace(c_name, '#', ':'), '^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$') AS mended FROM customer")
def ids_of_customers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", text.valid_id(F.col("c_name")).alias("whole"), text.valid_id(F.replace("c_name", F.lit("#"), F.lit(":"))).alias("mended"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'NO' WHEN 'NATION_2' THEN 'NT' END AS code, CASE n_name WHEN 'NATION_1' THEN 'one' WHEN 'NATION_2' THEN 'NT' ELSE lower(replace(n_name, '_', '-')) END AS slug FROM nation")
def codes_of_nations(spark, sf):
    name = F.concat(F.lit(" «"), F.col("n_name"), F.lit("». "))
    names = {"nation_1": "NO", "nation_2": "NT"}
    return table(spark, sf, "nation").select("n_nationkey", text.country_code(name, names).alias("code"), text.actor_slug(F.col("n_name"), {"nation_1": "one"}, names).alias("slug"))


@query("SELECT doc_id, CAST(i AS BIGINT) AS pos, l[i + 1] AS found FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS l FROM documents))")
def numbers_by_place(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.explode(text_places()).alias("m"))
    return d.select("doc_id", F.col("m.pos").cast("long").alias("pos"), F.col("m.text").alias("found"))


def text_places():
    return pages.message_events(F.col("text"), "[0-9]{3,}")


# ------------------------------------------------------------------ times


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders")
def order_days(spark, sf):
    written = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "yyyy-M-d'T'"))
    return table(spark, sf, "orders").select("o_orderkey", times.parse_date_strict(written).alias("day"))


@query("SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, NULL AS broken FROM events")
def event_clocks(spark, sf):
    return table(spark, sf, "events").select("event_id", times.parse_clock(F.date_format("ts", "HH:mm:ss")).alias("clock"), times.parse_clock(F.date_format("ts", "HH:mm:ss.S")).alias("broken"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 != 2 AND l_quantity <= 30 THEN l_shipdate::DATE - CAST(l_quantity AS INTEGER) END AS day FROM lineitem")
def ship_days_clamped(spark, sf):
    day, late = F.col("l_shipdate").cast("date"), F.col("l_quantity").cast("int")
    event = F.when(F.col("l_linenumber") % 3 != 2, F.date_sub(day, late)).otherwise(F.date_add(day, late))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", times.clamp_event_date(event, day, 30).alias("day"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber % 4 != 3 AND l_quantity <= 25 AS said FROM lineitem")
def days_in_quotes(spark, sf):
    kinds = F.array(F.date_format("l_shipdate", "yyyy-MM-dd"), F.date_format("l_shipdate", "dd.MM.yyyy"), F.date_format("l_shipdate", "d MMMM"), F.lit("some day"))
    quote = F.concat(F.lit("It left on "), F.get(kinds, F.col("l_linenumber").cast("int") % 4), F.lit(", they say"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", times.date_in_quote(F.when(F.col("l_quantity") <= 25, F.col("l_shipdate").cast("date")).otherwise(F.date_add(F.col("l_shipdate").cast("date"), 400)), quote).alias("said"))


@query("SELECT event_id, CASE WHEN ts < date_trunc('day', ts) + INTERVAL '6 hours 30 minutes' THEN date_trunc('day', ts) ELSE date_trunc('day', ts) + INTERVAL 1 DAY END + INTERVAL '6 hours 30 minutes' AS fires FROM events")
def schedules_of_events(spark, sf):
    return table(spark, sf, "events").select("event_id", times.next_fires("30 6 * * *", F.col("ts")).cast("timestamp_ntz").alias("fires"))


# ------------------------------------------------------------------ documents


@query("SELECT event_id, '[\"' || (props->>'$.k') || '\"]' AS plain, '[\"' || (props->>'$.k') || '\"]' AS deep, '{\"k\":' || (props->>'$.k') || ',\"n\":{\"k\":' || user_id || '}}' AS canonical, '{\"k\":\"' || (props->>'$.k') || '\",\"n.k\":\"' || user_id || '\"}' AS flat FROM events")
def documents_of_events(spark, sf):
    nested = F.concat(F.lit('{"n" : {"k": '), F.col("user_id").cast("string"), F.lit("}, "), F.expr("substring(props, 2)"))
    e = table(spark, sf, "events").withColumn("nested", nested)
    return e.select(
        "event_id", F.to_json(docs_.json_path(F.col("props"), "$.k")).alias("plain"), F.to_json(docs_.json_path(F.col("props"), "$..k")).alias("deep"),
        docs_.canonical_json(F.col("nested")).alias("canonical"), F.to_json(F.map_from_entries(F.array_sort(F.map_entries(docs_.flatten_json(F.col("nested")))))).alias("flat"),
    )


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{}' ELSE '{\"u\":\"' || user_id || '\"}' END AS extra FROM events")
def members_not_in_schema(spark, sf):
    members = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.get_json_object("props", "$.k"))).otherwise(F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("u"), F.col("user_id").cast("string")))
    return table(spark, sf, "events").select("event_id", F.to_json(docs_.unknown_members(members, ["k"])).alias("extra"))


@query("WITH e AS (SELECT event_id, props->>'$.k' AS k, lead(props->>'$.k') OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)"
       " SELECT event_id, CASE WHEN n IS NULL OR n = k THEN '[]' ELSE '[{\"pointer\":\"/k\",\"expected\":\"' || k || '\",\"actual\":\"' || n || '\"}]' END AS exact, CASE WHEN n IS NULL OR n = k THEN '[]' ELSE '[{\"name\":\"k\",\"before\":\"' || k || '\",\"after\":\"' || n || '\"}]' END AS changed FROM e")
def documents_compared(spark, sf):
    """Each event's document against the next one of its user."""
    from pyspark.sql import Window

    following = F.coalesce(F.lead("props").over(Window.partitionBy("user_id").orderBy("event_id")), F.col("props"))
    e = table(spark, sf, "events").select("event_id", "props", following.alias("next"))
    members = lambda c: F.from_json(c, "map<string,string>")
    return e.select("event_id", F.to_json(docs_.compare_output(F.col("props"), F.col("next"))).alias("exact"), F.to_json(docs_.changed_members(members("props"), members("next"))).alias("changed"))


@query("SELECT event_id, '{\"document\":\"{\\\"a\\\":' || user_id || ',\\\"k\\\":' || (CAST(props->>'$.k' AS INT) + 1) || '}\",\"conflicts\":[]}' AS merged FROM events")
def documents_merged(spark, sf):
    k, u = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    ours = F.to_json(F.struct(k.alias("k"), u.alias("a")))
    theirs = F.to_json(F.struct((k + 1).alias("k")))
    return table(spark, sf, "events").select("event_id", F.to_json(docs_.merge3_json(F.col("props"), ours, theirs)).alias("merged"))


@query("SELECT conv_id, turn, sha256('start' || chr(10) || text || chr(10) || 'end') AS sha, 0 AS conflicts FROM conversations")
def lines_of_turns_merged(spark, sf):
    c = table(spark, sf, "conversations")
    merged = docs_.merge3_lines(F.col("text"), F.concat("text", F.lit("\nend")), F.concat(F.lit("start\n"), "text"))
    return c.select("conv_id", "turn", merged.alias("m")).select("conv_id", "turn", _sha(F.col("m.text")).alias("sha"), "m.conflicts")


@query("SELECT conv_id, turn, CAST(1 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed FROM conversations")
def lines_added_to_turns(spark, sf):
    diff = docs_.diff_files(F.concat("text", F.lit("\n")), F.concat("text", F.lit("\nlast\n")), "turn")
    lines = F.split(diff, "\n")
    count = lambda sign: F.size(F.filter(lines, lambda x: x.startswith(sign) & ~x.startswith(sign * 3))).cast("long")
    return table(spark, sf, "conversations").select("conv_id", "turn", count("+").alias("added"), count("-").alias("removed"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha, sha256(coalesce(text, '')) AS plain FROM documents")
def bodies_unpacked_again(spark, sf):
    body = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    d = table(spark, sf, "documents").select("doc_id", body.alias("body"))
    return d.select("doc_id", F.sha2(docs_.gunzipped(docs_.gzipped(F.col("body"))), 256).alias("sha"), F.sha2(docs_.gunzipped(F.col("body")), 256).alias("plain"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 != 2 THEN sha256(coalesce(text, '')) END AS sha FROM documents")
def inline_contents(spark, sf):
    plain = F.coalesce("text", F.lit(""))
    kind = F.col("doc_id") % 3
    data = F.when(kind == 0, F.base64(F.encode(plain, "utf-8"))).otherwise(plain)
    stated = F.when(kind == 2, F.sha2(F.lit("other"), 256)).when(kind == 1, F.sha2(F.encode(plain, "utf-8"), 256))
    return table(spark, sf, "documents").select("doc_id", F.sha2(discovery.content_bytes(F.lit("inline"), F.when(kind == 0, "base64"), data, stated), 256).alias("sha"))


# ------------------------------------------------------------------ addresses, keys, filters


@query("SELECT page_id, true AS same, lower(regexp_extract(url, '^https?://[^/?#]+')) AS origin, 'https://e.com/' || regexp_extract(url, '^https?://([^/?#]+)', 1) || '/' || page_id AS filled FROM pages")
def addresses_compared(spark, sf):
    u = F.col("url")
    other = F.concat(F.upper(F.regexp_extract(u, "^https?://[^/?#]+", 0)), F.regexp_replace(u, "^https?://[^/?#]+", ""), F.lit("#frag"))
    filled = urls.expand_template("https://e.com/{host}/{id}", {"host": urls.host_of(u), "id": F.col("page_id").cast("string")})
    return table(spark, sf, "pages").select("page_id", urls.same_url(u, F.regexp_replace(other, "#.*#", "#")).alias("same"), urls.origin_of(u).alias("origin"), filled.alias("filled"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'o' || l_orderkey ELSE 'o' || l_orderkey || '#raw' || (l_linenumber - 1) END AS object, 'o' || l_orderkey || '#' || l_linenumber AS entity, 'o' || l_orderkey || '#' || l_returnflag || '#' || l_linenumber AS item, '{\"line\":\"' || l_linenumber || '\",\"order\":\"' || l_orderkey || '\"}' AS natural FROM lineitem")
def keys_of_lines(spark, sf):
    order, line = F.concat(F.lit("o"), F.col("l_orderkey")), F.col("l_linenumber")
    natural = keys.build_key([("order", F.col("l_orderkey").cast("string")), ("line", line.cast("string"))])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", keys.object_delivery_key(order, line - 1).alias("object"), keys.entity_delivery_key(order, line).alias("entity"),
        keys.item_key(order, F.col("l_returnflag"), line).alias("item"), natural.alias("natural"),
    )


@query("SELECT o_custkey, 'https://e.com/o/' || o_orderkey AS url, strftime(o_orderdate, '%Y-%m-%d') AS lastmod FROM orders")
def items_of_answers(spark, sf):
    """Orders of each customer as one answer of an API, read back as items."""
    item = F.struct(F.concat(F.lit("https://e.com/o/"), F.col("o_orderkey")).alias("link"), F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")).alias("meta"))
    answers = table(spark, sf, "orders").groupBy("o_custkey").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("items")).alias("data"))).alias("body"))
    rows = answers.select("o_custkey", F.explode(discovery.api_items(F.col("body"), "$.data.items[*]", "$.link", "$.meta.at")).alias("i"))
    return rows.select("o_custkey", "i.url", "i.lastmod")


@query("SELECT o_orderkey, CASE WHEN s BETWEEN 200 AND 299 THEN 'parse' WHEN s BETWEEN 400 AND 499 THEN 'allow_all' ELSE 'disallow_all' END AS outcome FROM (SELECT o_orderkey, 200 + CAST(floor(o_totalprice) AS BIGINT) % 400 AS s FROM orders)")
def outcomes_of_robots(spark, sf):
    status = F.lit(200) + F.floor("o_totalprice") % 400
    return table(spark, sf, "orders").select("o_orderkey", predicates.robots_outcome(status).alias("outcome"))


@query("SELECT p_partkey, p_brand = 'Brand#13' OR p_size > 40 AS accepts, (p_brand = 'Brand#13' OR p_size > 40) AND contains(lower(p_name), 'blue') AND p_type = 'ECONOMY' AS listed FROM part")
def packages_listed(spark, sf):
    media = F.array(F.when(F.col("p_brand") == "Brand#13", "text/*").otherwise("image/png"), F.when(F.col("p_size") > 40, "text/html").otherwise("audio/*"))
    p = table(spark, sf, "part").select("p_partkey", media.alias("media_types"), F.array("p_type").alias("tags"), F.col("p_name").alias("title"), F.lit("p").alias("package_id"), F.lit("").alias("description"))
    listed = predicates.package_matches(_Row(), media="text/html", tag="ECONOMY", text="BLUE")
    return p.select("p_partkey", predicates.media_matches(F.col("media_types"), "text/html").alias("accepts"), listed.alias("listed"))


class _Row:
    """Columns by name."""

    def __getitem__(self, name: str):
        return F.col(name)


@query(r"SELECT page_id, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(html, '<div class=\"ad\">(.*?)</div>', 1) AS ad FROM (SELECT page_id, regexp_replace(html, '\n', ' ', 'g') AS html FROM pages)")
def elements_counted(spark, sf):
    """Paragraphs of articles by tree, whatever stands open around them, and the text of an element by class."""
    p = spread(table(spark, sf, "pages"), "page_id").select("page_id", page_tree(F.regexp_replace("html", "\n", " ")).alias("tree"))
    ad = F.get(selectors.values(F.col("tree"), selectors.xpath("//div[@class='ad']/text()")), F.lit(0))
    return p.select("page_id", F.size(selectors.places(F.col("tree"), selectors.css("article p"))).cast("long").alias("paragraphs"), F.coalesce(ad, F.lit("")).alias("ad"))


# ------------------------------------------------------------------ schemas and analyses

#: What an event's document must be; the identifier is a definition.
EVENT_SCHEMA = {
    "type": "object",
    "required": ["k", "kind", "at"],
    "properties": {
        "k": {"type": "integer", "minimum": 5, "not": {"multipleOf": 7}},
        "kind": {"enum": ["click", "view", "purchase"]},
        "at": {"type": "object", "properties": {"user": {"$ref": "#/$defs/user"}}, "additionalProperties": False},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^[a-z]+$"}},
    },
    "additionalProperties": False,
    "$defs": {"user": {"oneOf": [{"type": "integer", "exclusiveMaximum": 40}, {"type": "null"}]}},
}


@query("WITH e AS (SELECT event_id, user_id, event_type, value, CAST(props->>'$.k' AS INT) AS k FROM events)"
       " SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 11 = 0 THEN ':additionalProperties' END, CASE WHEN user_id % 9 = 0 THEN ':required' END, CASE WHEN k < 5 THEN '/k:minimum' END, CASE WHEN k % 7 = 0 THEN '/k:not' END,"
       " CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN '/kind:enum' END, CASE WHEN user_id % 9 != 0 AND user_id >= 40 THEN '/at/user:oneOf' END, CASE WHEN value > 20 THEN '/tags:maxItems' END, CASE WHEN value > 20 THEN '/tags/2:pattern' END], lambda x: x IS NOT NULL)), ' ') AS problems FROM e")
def documents_by_schema(spark, sf):
    """Events' documents with a nested member, a list and now and then a member too many, checked by a schema."""
    from ..functions.schemas import schema_problems

    tags = F.when(F.col("value") > 20, F.array(F.lit("a"), F.lit("b"), F.lit("C3"))).otherwise(F.array(F.lit("a")))
    at = F.when(F.col("user_id") % 9 != 0, F.struct(F.col("user_id").alias("user")))
    extra = F.when(F.col("event_id") % 11 == 0, F.lit("x"))
    made = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.col("event_type").alias("kind"), at.alias("at"), tags.alias("tags"), extra.alias("extra")))
    e = table(spark, sf, "events").select("event_id", F.try_parse_json(made).alias("d"))
    problems = F.transform(schema_problems(F.col("d"), EVENT_SCHEMA), lambda p: F.concat(p["pointer"], F.lit(":"), p["keyword"]))
    return e.select("event_id", F.array_join(F.array_sort(problems), " ").alias("problems"))


@query(r"WITH p AS (SELECT doc_id, text, regexp_extract(text, '^[^\p{L}\p{M}\p{N}]*') AS lead, regexp_extract(text, '^[^\p{L}\p{M}\p{N}]*((?:[\p{L}\p{M}\p{N}]+[^\p{L}\p{M}\p{N}]+){7}[\p{L}\p{M}\p{N}]+)', 1) AS quote FROM documents)"
       " SELECT doc_id, CASE WHEN quote != '' THEN length(lead) END AS start, CASE WHEN quote != '' THEN length(lead) + length(quote) END AS stop, CAST(NULL AS INTEGER) AS absent FROM p")
def quotes_aligned(spark, sf):
    """The first eight words of each text, quoted in small letters with other spaces and signs, found again in it."""
    from ..operators.news import aligned

    quote = F.regexp_extract("text", r"^[^\p{L}\p{M}\p{N}]*((?:[\p{L}\p{M}\p{N}]+[^\p{L}\p{M}\p{N}]+){7}[\p{L}\p{M}\p{N}]+)", 1)
    said = F.concat(F.lit(" «"), F.regexp_replace(F.lower(quote), r"[^\p{L}\p{M}\p{N}]+", " - "), F.lit("»"))
    answer = F.struct(F.array(F.struct(said.alias("quote")), F.struct(F.concat(quote, F.lit(" zq9zq")).alias("quote"))).alias("evidence"))
    d = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "text", F.try_parse_json(F.to_json(answer)).alias("answer"))
    return aligned(d).select("doc_id", F.get("quotes", F.lit(0))["start"].cast("long").alias("start"), F.get("quotes", F.lit(0))["end"].cast("long").alias("stop"), F.get("quotes", F.lit(1))["start"].alias("absent"))


@query("SELECT event_id, day, articles FROM (SELECT sha256('{\"action\":\"sold\",\"place\":\"' || lower(p_brand) || '\",\"actor\":\"' || lower(p_type) || '\",\"date\":\"2024-03-05\"}') AS h, count(*) AS articles FROM part WHERE p_size % 5 != 0 AND p_size % 7 != 0 GROUP BY 1) t, (SELECT DATE '2024-03-05' AS day), LATERAL (SELECT 'ev_' || h[1:32] AS event_id)")
def events_of_articles(spark, sf):
    """Articles on parts whose analysis names an event; some quote nothing that stands there, some aren't sure."""
    from ..operators.news import event_rows, normalised

    text = F.concat(F.lit("On 5 March the "), "p_name", F.lit(" was sold in "), "p_brand", F.lit("."))
    quote = F.when(F.col("p_size") % 5 == 0, F.lit("on 5 march nothing was sold")).otherwise(F.concat(F.lit("on 5 March — the "), F.upper("p_name")))
    canonical = F.struct(F.lit("Sold").alias("action"), F.col("p_brand").alias("place"), F.col("p_type").alias("actor"), F.lit("2024-03-05").alias("date"))
    event = F.struct(canonical.alias("canonical"), F.col("p_name").alias("summary"), F.when(F.col("p_size") % 7 == 0, 0.5).otherwise(0.95).alias("identity_confidence"), F.array(F.struct(quote.alias("quote"))).alias("evidence"))
    a = spread(table(spark, sf, "part"), "p_partkey").select(text.alias("text"), F.try_parse_json(F.to_json(F.struct(event.alias("event")))).alias("answer"), F.lit("2024-03-07").cast("date").alias("published"))
    return event_rows(normalised(a)).select("event_id", "day", "articles")
