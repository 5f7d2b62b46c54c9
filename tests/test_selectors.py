"""Selectors against an independent evaluation: ElementTree on well-formed pages, and plain walks over its trees."""

import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from obsidra.functions import elements, selectors


def made(rng, depth=0):
    tag = rng.choice(["div", "ul", "li", "a", "span", "section"])
    out = ET.Element(tag)
    if rng.random() < 0.5:
        out.set("class", " ".join(rng.sample(["x", "y", "z-1"], rng.randint(1, 2))))
    if tag == "a" or rng.random() < 0.2:
        out.set("href", rng.choice(["/p/1", "/q/2", "http://e.com/p/3", ""]))
    if rng.random() < 0.2:
        out.set("id", rng.choice("mn"))
    out.text = rng.choice(["one", "two", None, " "])
    for _ in range(rng.randint(0, 3) if depth < 4 else 0):
        out.append(made(rng, depth + 1))
    return out


def roots():
    rng = random.Random(7)
    out = []
    for _ in range(25):
        root = ET.Element("html")
        root.append(made(rng))
        root.append(made(rng))
        for e in root.iter():  # nesting that HTML itself would end
            for child in list(e):
                if e.tag == "li" and child.tag == "li" or e.tag == "a" and child.tag == "a":
                    child.tag = "span"
        for a in list(root.iter("a")):
            for inner in a.iter():
                if inner is not a and inner.tag == "a":
                    inner.tag = "span"
        for li in list(root.iter("li")):
            for inner in li.iter():
                if inner is not li and inner.tag == "li":
                    inner.tag = "span"
        out.append(root)
    return out


ROOTS = roots()


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(i, ET.tostring(r, "unicode", short_empty_elements=False)) for i, r in enumerate(ROOTS)]
    out = spark.createDataFrame(rows, "i int, html string").select("i", elements.page_tree(F.col("html")).alias("t")).persist()
    yield out
    out.unpersist()


def chosen(trees, selector, kind):
    got = trees.select("i", selectors.places(F.col("t"), selectors.compiled(selector, kind)).alias("p")).collect()
    return {r["i"]: r["p"] for r in got}


def numbered(root):
    return {e: i for i, e in enumerate(root.iter())}


@pytest.mark.parametrize("ours, theirs", [
    ("//a", ".//a"), ("//div/a", ".//div/a"), ("//div//a", ".//div//a"), ("//a[@href]", ".//a[@href]"), ("//*[@class='x']", ".//*[@class='x']"),
    ("//li[2]", ".//li[2]"), ("//ul/li[last()]", ".//ul/li[last()]"), ("/html/div", "./div"), ("/html/*/span[1]", "./*/span[1]"), ("//a/..", ".//a/.."),
    ("//div[@id='m'][@class]", ".//div[@id='m'][@class]"), ("//section//ul//span", ".//section//ul//span"),
])
def test_xpath_equals_element_tree(trees, ours, theirs):
    got = chosen(trees, ours, "xpath")
    for i, root in enumerate(ROOTS):
        at = numbered(root)
        assert got[i] == sorted({at[e] for e in root.findall(theirs)}), (ours, ET.tostring(root))


def kin(root):
    up = {c: p for p in root.iter() for c in p}
    above = lambda e: [] if e not in up else [up[e], *above(up[e])]
    return up, above


def classes(e):
    return (e.get("class") or "").split()


CSS = {
    "div > a": lambda e, up, above: e.tag == "a" and e in up and up[e].tag == "div",
    ".x .y": lambda e, up, above: "y" in classes(e) and any("x" in classes(p) for p in above(e)),
    "li + li": lambda e, up, above: e.tag == "li" and e in up and (k := list(up[e]).index(e)) > 0 and up[e][k - 1].tag == "li",
    "a ~ span": lambda e, up, above: e.tag == "span" and e in up and any(s.tag == "a" for s in list(up[e])[: list(up[e]).index(e)]),
    "li:nth-child(2n+1)": lambda e, up, above: e.tag == "li" and (e not in up or list(up[e]).index(e) % 2 == 0),
    "span:first-of-type": lambda e, up, above: e.tag == "span" and e in up and [s for s in up[e] if s.tag == "span"][0] is e,
    "*:last-child:not(a, .x)": lambda e, up, above: (e not in up or up[e][-1] is e) and e.tag != "a" and "x" not in classes(e),
    "[href^='/p'], #m": lambda e, up, above: (e.get("href") or "").startswith("/p") or e.get("id") == "m",
    "[href$='3'], a[href*=q]": lambda e, up, above: (e.get("href") or "").endswith("3") or e.tag == "a" and "q" in (e.get("href") or ""),
    "[class|=z], [class~='Z-1' i]": lambda e, up, above: "z-1" in classes(e) or (e.get("class") or "").startswith("z-"),
    ":root > div:is(.x, #n) span": lambda e, up, above: e.tag == "span" and any(p.tag == "div" and up.get(p) is not None and up[p] not in up and ("x" in classes(p) or p.get("id") == "n") for p in above(e)),
    "ul:only-child": lambda e, up, above: e.tag == "ul" and (e not in up or len(up[e]) == 1),
    "li:nth-last-child(-n+2)": lambda e, up, above: e.tag == "li" and (e not in up or len(up[e]) - list(up[e]).index(e) <= 2),
}


@pytest.mark.parametrize("selector", CSS)
def test_css_equals_a_walk(trees, selector):
    got = chosen(trees, selector, "css")
    for i, root in enumerate(ROOTS):
        up, above = kin(root)
        assert got[i] == [k for k, e in enumerate(root.iter()) if CSS[selector](e, up, above)], ET.tostring(root)


XPATH = {
    "//a[contains(@href,'/p/') and not(@id)]": lambda e, up, above: e.tag == "a" and "/p/" in (e.get("href") or "") and e.get("id") is None,
    "//*[starts-with(@href,'http') or text()='two']": lambda e, up, above: (e.get("href") or "").startswith("http") or (e.text or "").strip() and e.text == "two",
    "//li/following-sibling::span": lambda e, up, above: e.tag == "span" and e in up and any(s.tag == "li" for s in list(up[e])[: list(up[e]).index(e)]),
    "//span/preceding-sibling::*": lambda e, up, above: e in up and any(s.tag == "span" for s in list(up[e])[list(up[e]).index(e) + 1 :]),
    "//a/ancestor::div": lambda e, up, above: e.tag == "div" and any(x.tag == "a" for x in e.iter()),
    "//ul | //section": lambda e, up, above: e.tag in ("ul", "section"),
    "//div[contains(., 'one')]": lambda e, up, above: e.tag == "div" and any((x.text or "") == "one" for x in e.iter()),
}


@pytest.mark.parametrize("expression", XPATH)
def test_xpath_equals_a_walk(trees, expression):
    got = chosen(trees, expression, "xpath")
    for i, root in enumerate(ROOTS):
        up, above = kin(root)
        assert got[i] == [k for k, e in enumerate(root.iter()) if XPATH[expression](e, up, above)], ET.tostring(root)


def read(spark, html, selector, kind, attribute="href"):
    t = spark.createDataFrame([(html,)], "h string").select(elements.page_tree(F.col("h")).alias("t"))
    return t.select(selectors.values(F.col("t"), selectors.compiled(selector, kind), attribute)).first()[0]


def test_values(spark):
    page = "<p>a<a href='/1' REL='Next nofollow'>x</a><a href=''>y</a><img src=i.png><link rel=next href=/2><div title=t>in<b>ner</b></div>"
    assert read(spark, page, "next", "rel") == ["/1", "/2"]
    assert read(spark, page, "a", "css") == ["/1"]
    assert read(spark, page, "//a/@href", "xpath") == ["/1", ""]
    assert read(spark, page, "img", "css", "src") == ["i.png"]
    assert read(spark, page, "//div/text()", "xpath") == ["in"]
    assert read(spark, page, "//div/@*", "xpath") == ["t"]
    assert read(spark, None, "a", "css") is None and read(spark, "", "a", "css") == []


def shape(html):
    t = elements.tree(html)["elements"]
    return [(e["tag"], e["parent"]) for e in t]


def test_tags_that_html_ends_itself():
    assert shape("<p>a<p>b<div>c") == [("p", -1), ("p", -1), ("div", -1)]
    assert shape("<ul><li>a<ul><li>b</ul><li>c</ul><i>") == [("ul", -1), ("li", 0), ("ul", 1), ("li", 2), ("li", 0), ("i", -1)]
    assert shape("<table><tr><td><b>1<td>2</b><tr><td>3</table>") == [("table", -1), ("tr", 0), ("td", 1), ("b", 2), ("td", 1), ("tr", 0), ("td", 5)]
    assert shape("<table><thead><tr><th>h<tbody><tr><td>x</table>") == [("table", -1), ("thead", 0), ("tr", 1), ("th", 2), ("tbody", 0), ("tr", 4), ("td", 5)]
    assert shape("<br/><div/><i>") == [("br", -1), ("div", -1), ("i", -1)]
    assert shape("</b><!-- <a> --><script>'<a>'</script>") == [("script", -1)]
    deep = elements.tree("<i>" * 3000)["elements"]
    assert len(deep) == 3000 and max(len(e["above"]) for e in deep) == elements.DEEPEST


@pytest.mark.parametrize("selector, kind", [("a:hover", "css"), ("a,", "css"), (">a", "css"), ("a[", "css"), ("//a[@x][2]", "xpath"), ("//a[count(b)=1]", "xpath"), ("//following::a", "xpath"), ("//a/@href | //b", "xpath"), ("a", "jquery")])
def test_what_is_not_supported_is_an_error(selector, kind):
    with pytest.raises(selectors.SelectorError):
        selectors.compiled(selector, kind)
