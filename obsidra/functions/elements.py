"""A page as arrays of elements and texts, made once per page; everything else about a page is an expression over them.

An element's place is its index in the array, which is document order. It knows its parent (-1: none), the place of the
last element inside it (itself, if there is none), the element before it under the same parent (-1: none), its
numbers among all siblings and those of its tag, from both ends, and the places of all elements above it. A text knows
its element. Comments and declarations are no elements; text inside scripts and styles belongs to them.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import by_parts

ELEMENT = pa.struct(
    [
        ("parent", pa.int32()),
        ("last", pa.int32()),
        ("before", pa.int32()),
        ("nth", pa.int32()),
        ("nth_of_tag", pa.int32()),
        ("nth_last", pa.int32()),
        ("nth_last_of_tag", pa.int32()),
        ("tag", pa.string()),
        ("attributes", pa.map_(pa.string(), pa.string())),
        ("above", pa.list_(pa.int32())),
    ]
)
TEXT = pa.struct([("owner", pa.int32()), ("text", pa.string())])
PAGE = pa.struct([("elements", pa.list_(ELEMENT)), ("texts", pa.list_(TEXT))])
SCHEMA = (
    "struct<elements:array<struct<parent:int,last:int,before:int,nth:int,nth_of_tag:int,nth_last:int,nth_last_of_tag:int,tag:string,"
    "attributes:map<string,string>,above:array<int>>>,texts:array<struct<owner:int,text:string>>>"
)

#: Fixed values of HTML: elements without content, those that end an open paragraph, and the deepest nesting browsers keep.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
DEEPEST = 512
#: What a start tag closes, and the elements beyond which it doesn't look.
_CLOSES = {
    **{tag: (frozenset(["p"]), frozenset("td th caption button object table html".split())) for tag in ENDS_PARAGRAPH},
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "a": (frozenset(["a"]), frozenset("td th caption button object table html".split())),
    "body": (frozenset(["head"]), frozenset()),
    **{tag: (frozenset("thead tbody tfoot tr caption colgroup".split()), frozenset(["table"])) for tag in ("thead", "tbody", "tfoot")},
}
#: An end tag does not reach out of a cell or a table, unless it is one of these.
_CELLS = frozenset("td th table".split())
_TABLE_PARTS = frozenset("td th tr thead tbody tfoot table caption html body".split())


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent: list[int] = []
        self.tag: list[str] = []
        self.attributes: list[list[tuple[str, str]]] = []
        self.texts: list[tuple[int, str]] = []
        self.open: list[int] = []
        self.apart = True  # whether a tag stood since the last text

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closes, barrier = _CLOSES.get(tag, (frozenset(), frozenset()))
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[depth]]
            if name in closes:
                del self.open[depth:]
                if tag not in ("thead", "tbody", "tfoot"):
                    break
            elif name in barrier or not closes:
                break
        self.apart = True
        place = len(self.tag)
        self.parent.append(self.open[-1] if self.open else -1)
        self.tag.append(tag)
        first: dict[str, str] = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        self.attributes.append(list(first.items()))
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(place)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and self.open[-1] == len(self.tag) - 1 and tag not in ("script", "style"):
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        self.apart = True
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.tag[self.open[depth]]
            if name == tag:
                del self.open[depth:]
                return
            if name in _CELLS and tag not in _TABLE_PARTS:
                return

    def handle_data(self, data: str) -> None:
        owner = self.open[-1] if self.open else -1
        if self.texts and not self.apart:
            self.texts[-1] = (owner, self.texts[-1][1] + data)
        elif not data.isspace():
            self.texts.append((owner, data))
            self.apart = False


def _read(page: str) -> tuple[list, ...]:
    """Columns of a page's elements in the order of :data:`ELEMENT`, then its texts with their owners."""
    reader = _Tree()
    reader.feed(page)
    reader.close()
    parent, tags = reader.parent, reader.tag
    n = len(tags)
    last, before = list(range(n)), [-1] * n
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0 and last[parent[i]] < last[i]:
            last[parent[i]] = last[i]

    def counted(order: range) -> tuple[list[int], list[int]]:
        nth, of_tag, seen = [0] * n, [0] * n, {}
        for i in order:
            for out, key in ((nth, parent[i]), (of_tag, (parent[i], tags[i]))):
                out[i] = seen[key] = seen.get(key, 0) + 1
        return nth, of_tag

    youngest: dict[int, int] = {}
    for i in range(n):
        before[i] = youngest.get(parent[i], -1)
        youngest[parent[i]] = i
    above: list[list[int]] = []
    for i in range(n):
        above.append([*above[parent[i]], parent[i]] if parent[i] >= 0 else [])
    (nth, of_tag), (nth_last, last_of_tag) = counted(range(n)), counted(range(n - 1, -1, -1))
    return parent, last, before, nth, of_tag, nth_last, last_of_tag, tags, reader.attributes, above, reader.texts


def tree(page: str | None) -> dict | None:
    """Elements and texts of a page, as :data:`PAGE`; None for None."""
    if page is None:
        return None
    *columns, texts = _read(page)
    names = [f.name for f in ELEMENT]
    return {"elements": [dict(zip(names, row)) for row in zip(*columns)], "texts": [{"owner": o, "text": t} for o, t in texts]}


def trees(pages: pa.Array) -> pa.Array:
    """:func:`tree` of each page, made by columns."""
    plain: list[list] = [[] for _ in range(8)]
    names, values, names_end, above, above_end, owners, texts, elements_end, texts_end = [], [], [0], [], [0], [], [], [0], [0]
    for page in pages.to_pylist():
        if page is not None:
            *columns, attributes, over, said = _read(page)
            for all_, own in zip(plain, columns):
                all_ += own
            for pairs in attributes:
                for name, value in pairs:
                    names.append(name)
                    values.append(value)
                names_end.append(len(names))
            for places in over:
                above += places
                above_end.append(len(above))
            for owner, text in said:
                owners.append(owner)
                texts.append(text)
        elements_end.append(len(plain[0]))
        texts_end.append(len(texts))
    ends = lambda at: pa.array(at, pa.int32())
    columns = [pa.array(c, f.type) for c, f in zip(plain, ELEMENT)]
    columns += [pa.MapArray.from_arrays(ends(names_end), pa.array(names, pa.string()), pa.array(values, pa.string())), pa.ListArray.from_arrays(ends(above_end), pa.array(above, pa.int32()))]
    said = pa.StructArray.from_arrays([pa.array(owners, pa.int32()), pa.array(texts, pa.string())], fields=list(TEXT))
    lists = [pa.ListArray.from_arrays(ends(elements_end), pa.StructArray.from_arrays(columns, fields=list(ELEMENT))), pa.ListArray.from_arrays(ends(texts_end), said)]
    return pa.StructArray.from_arrays(lists, fields=list(PAGE), mask=pages.is_null())


def page_tree(page: Column) -> Column:
    """struct<elements, texts> of a page; null for null. Select it as a column first: expressions over it hold lambdas, in
    which no Python function may stand."""
    return by_parts(SCHEMA)(trees).asNondeterministic()(page)  # so that no plan parses a page twice, or inside a lambda


def subtree_text(tree_: Column, place: Column, hidden: Column) -> Column:
    """Text of the element at ``place`` and all inside it, single spaces; ``hidden``: flags of elements whose own texts don't count."""
    end = F.get(tree_["elements"], place)["last"]
    texts = F.filter(tree_["texts"], lambda t: (t["owner"] >= place) & (t["owner"] <= end) & ~F.coalesce(F.get(hidden, t["owner"]), F.lit(False)))
    return single_spaced(F.array_join(F.transform(texts, lambda t: t["text"]), " "))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))
