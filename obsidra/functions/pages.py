"""Structured extraction from captured pages.

What a pattern can tell is read from the page's text. All else is an expression over the page's tree
(:func:`.elements.page_tree`, one parse per page) and its JSON-LD, which is a variant column: selectors for links, tables and
tiles, intervals of places for an article's text, and array functions for structured data.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selectors
from .elements import page_tree, single_spaced, subtree_text
from .urls import host_of
from .vectors import by_parts

#: Blocks that hold no content for a reader.
HIDDEN = r"(?is)<!--.*?-->|<(script|style|svg|noscript|template)\b[^>]*>.*?</\1\s*>"
#: Relations of resources, parts of a page around an article, and types of articles.
RESOURCE_RELATIONS = "stylesheet icon shortcut apple-touch-icon preload prefetch preconnect dns-prefetch manifest modulepreload".split()
AROUND = "script style nav footer header aside noscript svg form template".split()
ARTICLE_TYPES = ["NewsArticle", "Article", "ReportageNewsArticle", "BlogPosting"]
#: Where further nodes stand inside a JSON-LD node, and how many levels of them are read.
NESTED, LEVELS = ["@graph", "mainEntity", "itemListElement"], 3


def _within(tags: list[str]) -> str:
    """Selector of elements of ``tags`` and everything inside them."""
    return f":is({', '.join(tags)}), :is({', '.join(tags)}) *"


#: Links by source. A page's own links stand outside of drawings and of what shows without scripts.
LINK_SOURCES = {
    "a_href": selectors.css("a[href], area[href]"),
    "link_rel": selectors.css("link[href]:not(" + ", ".join(f'[rel~="{r}" i]' for r in RESOURCE_RELATIONS) + ")"),
    "canonical": selectors.css('link[rel~="canonical" i]'),
    "pagination_rel": selectors.css(", ".join(f'{tag}[rel~="{r}" i]' for tag in ("a", "link") for r in ("next", "prev", "previous"))),
}
_ASIDE = selectors.css(_within(["svg", "noscript", "template"]))


def outside_blocks(page: Column) -> Column:
    """The page without scripts, styles, drawings and comments."""
    return F.regexp_replace(page, HIDDEN, " ")


def visible_text(page: Column) -> Column:
    """Text of a page: blocks and tags dropped, common entities resolved, single spaces."""
    text = F.regexp_replace(outside_blocks(page), r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _let(value: Column, use) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def extract_hrefs(tree: Column, selector: str | None = None, kind: str = "css", attribute: str = "href", sources: tuple[str, ...] = ("a_href",)) -> Column:
    """Raw link values in document order: of a selector's elements, or of ``sources`` one after another; none of no page."""
    if selector is not None:
        found = selectors.values(tree, selectors.compiled(selector, kind), attribute)
    else:
        found = F.concat(*[selectors.values(tree, LINK_SOURCES[s]) for s in sources])
    return F.coalesce(found, F.array().cast("array<string>"))


def link_rows(pages: DataFrame, selector: str | None = None, kind: str = "css", attribute: str = "href", sources: tuple[str, ...] = ("a_href",), page: str = "html") -> DataFrame:
    """One row (pos, href) per link of each page, beside the page's other columns; a page without any gives none."""
    rows = pages.withColumn("__tree", page_tree(F.col(page)))
    found = extract_hrefs(F.col("__tree"), selector, kind, attribute, sources)
    return rows.select(*[F.col(f"`{c}`") for c in pages.columns if c != page], F.posexplode(found).alias("pos", "href"))


def title(page: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(page, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def base_href(page: Column) -> Column:
    return F.nullif(F.regexp_extract(page, r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def meta(page: Column, name: str) -> Column:
    """Content of a meta element by name or property, in either order of its attributes."""
    key = re.escape(name)
    first = F.regexp_extract(page, rf"(?is)<meta\b[^>]*?\b(?:name|property|itemprop)\s*=\s*[\"']{key}[\"'][^>]*?\bcontent\s*=\s*[\"']([^\"']*)", 1)
    second = F.regexp_extract(page, rf"(?is)<meta\b[^>]*?\bcontent\s*=\s*[\"']([^\"']*)[\"'][^>]*?\b(?:name|property|itemprop)\s*=\s*[\"']{key}[\"']", 1)
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def html_meta(page: Column) -> Column:
    """struct<title, published, modified> of a page."""
    return F.struct(
        F.coalesce(meta(page, "og:title"), F.nullif(title(page), F.lit(""))).alias("title"),
        F.coalesce(meta(page, "article:published_time"), meta(page, "datePublished")).alias("published"),
        F.coalesce(meta(page, "article:modified_time"), meta(page, "dateModified")).alias("modified"),
    )


def declared_canonical(page: Column) -> Column:
    """Target of the first link of relation canonical, as written."""
    tag = F.regexp_extract(outside_blocks(page), r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical[\"']?[^>]*>", 0)
    return F.nullif(F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1), F.lit(""))


def apart(column: Column) -> Column:
    """``column``, kept out of the expressions that use it: the optimizer merges no projection that numbers its rows.

    What a Python function takes must stand in a column of its own where it holds lambdas; merged into the call, they are
    not recognised as the same call again and the plan can't run.
    """
    return F.when(F.monotonically_increasing_id() >= 0, column)


def resolved(references: Column, base: Column) -> Column:
    """array<string>: ``references`` made absolute at ``base``, without fragments; null for what is no http(s) URL.

    Both must be plain columns, made by :func:`apart` if they hold lambdas.
    """

    def one(base_url: str, reference: str | None) -> str | None:
        try:
            whole = urljoin(base_url, reference.strip())
            parts = urlsplit(whole)
            return parts._replace(fragment="").geturl() if parts.scheme.lower() in ("http", "https") and parts.hostname else None
        except (ValueError, AttributeError):
            return None

    @by_parts("array<string>")
    def run(lists: pa.Array, bases: pa.Array) -> pa.Array:
        return pa.array([None if refs is None else [one(b or "", r) for r in refs] for refs, b in zip(lists.to_pylist(), bases.to_pylist())], pa.list_(pa.string()))

    return run.asNondeterministic()(references, base)  # stays a column of its own: no later lambda may take it in


def page_links(pages: DataFrame, url: str = "url", page: str = "html", hosts: list[str] | None = None) -> DataFrame:
    """``pages`` without their text, with ``links``: their different http(s) links in order of their first place, on ``hosts`` and below if given."""
    t = F.col("__t")
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (page, "links")], page_tree(F.col(page)).alias("__t"))
    shown = F.zip_with(selectors.marks(t, LINK_SOURCES["a_href"]), selectors.marks(t, _ASIDE), lambda link, aside: link & ~aside)
    hrefs = F.filter(F.zip_with(t["elements"], shown, lambda e, on: F.when(on, F.trim(e["attributes"]["href"]))), lambda h: (h != "") & ~h.startswith("#"))
    rows = rows.withColumns({"__hrefs": apart(hrefs), "__base": apart(selectors.values(t, selectors.css("base")))}).drop("__t")
    rows = rows.withColumn("__base", F.coalesce(F.get(resolved(F.col("__base"), F.col(url)), F.lit(0)), F.col(url)))
    rows = rows.withColumn("links", resolved(F.col("__hrefs"), F.col("__base"))).drop("__hrefs", "__base")
    fits = lambda u: u.isNotNull()
    if hosts is not None:
        on_host = lambda h, host: (h == host.lower()) | h.endswith("." + host.lower())
        fits = lambda u: u.isNotNull() & reduce(lambda x, y: x | y, [on_host(host_of(u), host) for host in hosts], F.lit(False))
    return rows.withColumn("links", F.array_distinct(F.filter("links", fits)))


def charset_of(header: Column, body: Column) -> Column:
    """Charset of a page's bytes: header, then a meta element in the first 4096 bytes, then UTF-8 if they are, else windows-1251."""
    named = r"(?i)charset\s*=\s*[\"']?\s*([\w.:-]+)"
    start = F.decode(F.substring(F.coalesce(body, F.lit(b"")), 1, 4096), "ISO-8859-1")
    said = lambda text, pattern: F.nullif(F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 1)), F.lit(""))
    sound = F.is_valid_utf8(F.coalesce(body, F.lit(b"")).cast("string"))
    return F.coalesce(said(header, named), said(start, r"(?i)<meta[^>]+" + named[4:]), F.when(sound, "utf-8").otherwise("windows-1251"))


def _listed(value: Column, path: str) -> Column:
    """array<variant> at a path: an array's elements, or the one value that stands there."""
    one = F.try_variant_get(value, path, "variant")
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<variant>"))


def _string(value: Column, path: str) -> Column:
    return F.nullif(F.try_variant_get(value, path, "string"), F.lit(""))


def ld_nodes(tree: Column) -> Column:
    """array<variant>: JSON-LD nodes of a page, outer ones before those inside them (:data:`NESTED`); broken blocks give none."""
    blocks = selectors.values(tree, selectors.xpath("//script[contains(@type,'application/ld+json')]/text()"))
    first = F.flatten(F.transform(blocks, lambda b: _listed(F.try_parse_json(b), "$")))

    def below(level: Column, left: int) -> Column:
        inner = F.flatten(F.transform(level, lambda node: F.concat(*[_listed(node, f"$['{key}']") for key in NESTED])))
        return F.concat(level, _let(inner, lambda nodes: below(nodes, left - 1))) if left else level

    return _let(first, lambda nodes: below(nodes, LEVELS))


def is_a(node: Column, *kinds: str) -> Column:
    """Whether a node has one of the types."""
    return F.arrays_overlap(F.transform(_listed(node, "$['@type']"), lambda t: F.try_variant_get(t, "$", "string")), F.array(*[F.lit(k) for k in kinds]))


def ld_products(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """One row per JSON-LD product and offer: url, name, sku, price, currency, availability; an offer's own url, name and sku go first."""
    nodes = pages.select(F.col(url), page_tree(F.col(page)).alias("t")).select(url, F.explode(F.filter(ld_nodes(F.col("t")), lambda n: is_a(n, "Product"))).alias("n"))
    offers = nodes.select(url, "n", F.explode_outer(_listed(F.col("n"), "$.offers")).alias("o"))
    n, o = F.col("n"), F.col("o")
    return offers.select(
        F.coalesce(_string(o, "$.url"), _string(n, "$.url"), F.col(url)).alias(url),
        F.coalesce(_string(o, "$.name"), _string(n, "$.name")).alias("name"),
        F.coalesce(_string(o, "$.sku"), _string(n, "$.sku")).alias("sku"),
        F.coalesce(_string(o, "$.price"), _string(o, "$.lowPrice")).alias("price"),
        _string(o, "$.priceCurrency").alias("currency"),
        F.nullif(F.regexp_replace(_string(o, "$.availability"), "^.*/", ""), F.lit("")).alias("availability"),
    )


def page_identity(url: Column) -> Column:
    """struct<host, path, query> that spellings of one page's URL share: no final slash, parameters sorted; null for no URL."""
    path = F.coalesce(F.nullif(F.rtrim(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/")), F.lit("")), F.lit("/"))
    query = F.array_join(F.array_sort(F.split(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), "&")), "&")
    host = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    return F.when(host.isNotNull(), F.struct(host.alias("host"), path.alias("path"), query.alias("query")))


def with_bound_article(rows: DataFrame, nodes: str, addresses: str, into: str) -> DataFrame:
    """``rows`` with the article node of each page: of those that name one of the page's ``addresses`` the one with the longest
    body (the first of equals); else the only article of the page, if it names no page at all; else null.

    Names are laid end to end with their article's number beside, resolved in one call a page, and compared by identity.
    """
    at = lambda n, path: _string(n, path)
    names = lambda n: F.filter(
        F.flatten(F.array(*[F.array(at(n, f"$['{key}']"), at(n, f"$['{key}']['@id']"), at(n, f"$['{key}'].url")) for key in ("url", "@id", "mainEntityOfPage")])),
        lambda v: v.isNotNull() & ~v.rlike(r"^[\[{]"),
    )
    rows = rows.withColumn("__articles", F.filter(nodes, lambda n: is_a(n, *ARTICLE_TYPES)))
    flat = F.flatten(F.transform("__articles", lambda n, i: F.transform(names(n), lambda v: F.struct(i.alias("of"), v.alias("name")))))
    rows = rows.withColumn("__names", apart(flat)).withColumns({"__refs": apart(F.transform("__names", lambda x: x["name"])), "__first": apart(F.get(addresses, F.lit(0)))})
    rows = rows.withColumn("__urls", resolved(F.col("__refs"), F.col("__first")))
    named = F.filter(F.zip_with("__names", "__urls", lambda x, u: F.struct(x["of"].alias("of"), page_identity(u).alias("page"))), lambda x: x["page"].isNotNull())
    rows = rows.withColumns({"__named": named, "__own": F.transform(addresses, page_identity)})
    bound = F.array_distinct(F.transform(F.filter("__named", lambda x: F.array_contains("__own", x["page"])), lambda x: x["of"]))
    length = lambda i: F.coalesce(F.length(_string(F.get("__articles", i), "$.articleBody")), F.lit(0))
    best = F.array_max(F.transform(bound, lambda i: F.struct(length(i).alias("length"), (-i).alias("back"))))
    alone = F.when((F.size("__articles") == 1) & (F.size("__named") == 0), F.lit(0))
    chosen = F.get("__articles", F.coalesce(-best["back"], alone))
    return rows.withColumn(into, chosen).drop("__articles", "__names", "__refs", "__first", "__urls", "__named", "__own")


def page_articles(pages: DataFrame, url: str = "url", page: str = "html", least: int = 0, tree: Column | None = None) -> DataFrame:
    """``pages`` with their article: structured data first, then what the page itself shows. ``tree``: the page's tree, if it isn't
    that of its text as it stands.

    Added: title (JSON-LD, og:title, first h1 outside of other articles, title element), published, author, body (JSON-LD; the text of the first
    outermost article element or of its like by itemprop, with articles nested in it; of main), paywalled and problem
    (``paywall``; ``no article`` for a body under ``least`` characters or none). Menus, forms, footers and hidden
    elements are no part of a body; what an unclosed article holds goes to the end of its parent.
    """
    names = ("title", "published", "author", "body", "paywalled", "problem")
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in names], (page_tree(F.col(page)) if tree is None else tree).alias("__t"))
    t, html = F.col("__t"), F.col(page)
    rows = rows.withColumn("__canonical", apart(selectors.values(t, LINK_SOURCES["canonical"])))
    rows = rows.withColumn("__canonical", resolved(F.col("__canonical"), F.col(url))).withColumn("__canonical", F.get("__canonical", F.lit(0)))
    same_host = host_of(F.col("__canonical")) == host_of(F.col(url))
    addresses = F.filter(F.array(F.col(url), F.when(same_host, F.col("__canonical"))), lambda a: a.isNotNull())
    rows = with_bound_article(rows.withColumns({"__nodes": ld_nodes(t), "__addresses": addresses}), "__nodes", "__addresses", "__a")
    rows = rows.withColumns(
        {
            "__hidden": selectors.marks(t, selectors.css(_within([*AROUND, "[hidden]", "[aria-hidden=true]", "[style*='display:none' i]"]))),
            "__at": F.get(selectors.places(t, selectors.css("article, [itemprop~=articleBody]")), F.lit(0)),
            "__main": F.get(selectors.places(t, selectors.css("main")), F.lit(0)),
            "__h1": selectors.places(t, selectors.css("h1")),
        }
    )
    a, at = F.col("__a"), F.col("__at")
    end = F.get(t["elements"], at)["last"]
    heading = F.get(F.filter("__h1", lambda i: at.isNull() | (i < at) | (i <= end)), F.lit(0))
    shown = lambda place: F.when(place.isNotNull(), F.nullif(subtree_text(t, place, F.col("__hidden")), F.lit("")))
    body = F.coalesce(_string(a, "$.articleBody"), shown(at), shown(F.col("__main")))
    author = F.coalesce(_string(a, "$.author.name"), _string(a, "$.author[0].name"), F.when(~_string(a, "$.author").rlike(r"^[\[{]"), _string(a, "$.author")))
    rows = rows.withColumns(
        {
            "title": F.coalesce(_string(a, "$.headline"), meta(html, "og:title"), shown(heading), F.nullif(title(html), F.lit(""))),
            "published": F.coalesce(_string(a, "$.datePublished"), html_meta(html)["published"]),
            "author": F.coalesce(author, meta(html, "author")),
            "body": body,
            "paywalled": F.coalesce(F.lower(_string(a, "$.isAccessibleForFree")) == "false", F.lit(False)),
        }
    )
    missing = F.col("body").isNull() | (F.length("body") < least)
    problem = F.when(F.col("paywalled"), "paywall").when(missing, "no article")
    return rows.withColumn("problem", problem).drop("__t", "__a", "__hidden", "__at", "__main", "__h1", "__canonical", "__nodes", "__addresses")


def breadcrumb(tree: Column) -> Column:
    """array<string>: names of the page's first breadcrumb list, by position."""
    lists = F.filter(ld_nodes(tree), lambda n: is_a(n, "BreadcrumbList"))
    items = F.transform(
        _listed(F.get(lists, F.lit(0)), "$.itemListElement"),
        lambda v, i: F.struct(F.coalesce(F.try_variant_get(v, "$.position", "int"), F.lit(0)).alias("position"), i.alias("at"), F.coalesce(_string(v, "$.name"), _string(v, "$.item.name")).alias("name")),
    )
    return F.transform(F.filter(F.array_sort(items), lambda x: x["name"].isNotNull()), lambda x: x["name"])


def item_list(tree: Column) -> Column:
    """array<struct<position, url, name>> of the items that a category page lists."""
    lists = F.filter(ld_nodes(tree), lambda n: is_a(n, "ItemList"))
    of = lambda v, key: F.coalesce(_string(v, f"$.item['{key}']"), _string(v, f"$['{key}']"))
    items = F.flatten(
        F.transform(
            lists,
            lambda n: F.transform(
                _listed(n, "$.itemListElement"),
                lambda v, i: F.struct(
                    F.coalesce(F.try_variant_get(v, "$.position", "int"), i + 1).alias("position"), F.coalesce(of(v, "url"), of(v, "@id")).alias("url"), of(v, "name").alias("name")
                ),
            ),
        )
    )
    return F.coalesce(items, F.array().cast("array<struct<position:int,url:string,name:string>>"))


def attributes_table(tree: Column) -> Column:
    """map<name, value> of rows with two cells and of definition lists, in page order; the first of a name stays."""
    elements = tree["elements"]
    nothing = F.array().cast("array<boolean>")
    text = lambda i: subtree_text(tree, i, nothing)
    name = lambda i: F.rtrim(F.regexp_replace(text(i), ":+$", ""))
    values = selectors.places(tree, selectors.css("th:nth-child(1):nth-last-child(2) + *, td:nth-child(1):nth-last-child(2) + *, dt + dd"))
    pairs = F.transform(values, lambda i: F.struct(name(F.get(elements, i)["before"]).alias("name"), text(i).alias("value")))
    found = _let(
        F.filter(pairs, lambda p: p["name"] != ""),
        lambda pairs: F.map_from_entries(F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["name"]), p["name"]) == i + 1)),
    )
    return F.coalesce(found, F.create_map().cast("map<string,string>"))


def cards(tree: Column, selector: str) -> Column:
    """array<struct<href, text>> of listing tiles: elements of a selector, with the first link in them and all their text."""
    elements = tree["elements"]
    return _let(
        selectors.places(tree, LINK_SOURCES["a_href"]),
        lambda links: F.transform(
            selectors.places(tree, selectors.css(selector)),
            lambda i: F.struct(
                F.get(elements, F.get(F.filter(links, lambda k: (k >= i) & (k <= F.get(elements, i)["last"])), F.lit(0)))["attributes"]["href"].alias("href"),
                subtree_text(tree, i, F.array().cast("array<boolean>")).alias("text"),
            ),
        ),
    )


def _cut(text: Column, most: int) -> Column:
    """The longest start of ``text`` of at most ``most`` bytes that ends with a whole character."""
    data = F.substring(text.cast("binary"), 1, most)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\uFFFD+$", ""))


def lean_html(page: Column, most: int) -> Column:
    """A page within ``most`` bytes: the mildest of these that fits - as it is; without comments, styles, drawings and scripts but
    structured data; without spaces between tags; with the attributes of links, names and structure only; its start.
    """
    bare = F.regexp_replace(page, r"(?is)<!--.*?-->|<(style|svg|noscript|template)\b[^>]*>.*?</\1\s*>|<script\b(?![^>]*ld\+json)[^>]*>.*?</script\s*>", " ")
    tight = F.regexp_replace(bare, r"\s+", " ")
    plain = F.regexp_replace(tight, r"(?i)\s(?!(?:href|rel|id|class|name|property|content|itemprop|type)\s*=)[a-z_:@][\w:.-]*\s*=\s*(?:\"[^\"]*\"|'[^']*')(?=[^<>]*>)", "")
    fits = lambda text: F.octet_length(text) <= most
    return F.when(fits(page), page).when(fits(bare), bare).when(fits(tight), tight).otherwise(_cut(plain, most))


def html_digest(page: Column, tree: Column, most: int) -> Column:
    """A reading of a page in at most ``most`` characters: title and times, headings, structured data, links, text.

    Each part has a share of what is left; a part that needs less leaves the rest to those behind it.
    """
    facts = html_meta(page)
    hidden = selectors.marks(tree, selectors.css(_within(["script", "style", "svg", "noscript", "template", "title"])))
    nothing = F.array().cast("array<boolean>")
    parts = [
        ("page", F.concat_ws(" | ", facts["title"], facts["published"], facts["modified"], declared_canonical(page)), 0.15),
        ("headings", F.array_join(F.transform(selectors.places(tree, selectors.css("h1, h2, h3")), lambda i: subtree_text(tree, i, nothing)), " | "), 0.2),
        ("data", F.array_join(F.transform(ld_nodes(tree), lambda n: F.to_json(n)), "\n"), 0.35),
        ("links", F.array_join(F.array_distinct(selectors.values(tree, LINK_SOURCES["a_href"])), " "), 0.3),
        ("text", _let(hidden, lambda off: single_spaced(F.array_join(F.transform(F.filter(tree["texts"], lambda t: ~F.coalesce(F.get(off, t["owner"]), F.lit(False))), lambda t: t["text"]), " "))), 1.0),
    ]
    listed = F.array(*[F.struct(F.lit(f"[{name}] ").alias("head"), F.coalesce(content, F.lit("")).alias("content"), F.lit(share).alias("share")) for name, content, share in parts])

    def added(out: Column, part: Column) -> Column:
        room = F.floor((F.lit(most) - F.length(out)) * part["share"]).cast("int") - F.length(part["head"]) - 1
        return F.when((part["content"] != "") & (room > 0), F.concat(out, part["head"], F.left(part["content"], room), F.lit("\n"))).otherwise(out)

    return F.when(page.isNotNull(), F.aggregate(listed, F.lit(""), added))


def message_events(text: Column, pattern: str) -> Column:
    """array<struct<pos, text>> of all places of a pattern in a message."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda m, i: F.struct(i.alias("pos"), m.alias("text")))
