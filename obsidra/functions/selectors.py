"""Selectors over page trees, compiled to column expressions.

A CSS selector, an XPath expression or a link relation becomes a list of paths, a path a list of steps. A step marks
elements: those that pass its test and stand in its relation (axis) to an element that the step before it marked. Marks are
an array of booleans beside the array of elements, made once per step, so a step costs one pass over the elements (times
their depth for ancestors), in the JVM.

CSS: types, ``*``, ``#id``, ``.class``, ``[a]``, ``= ~= |= ^= $= *=`` (with ``i``), ``:first-child``, ``:last-child``, ``:only-child``,
``:nth-child()``, ``:nth-last-child()``, the same of type, ``:root``, ``:not()``, ``:is()``, all four combinators and lists.
XPath: absolute and relative location paths, ``/ // . .. * @a @* text()``, the axes child, descendant, parent, ancestor,
self, following-sibling and preceding-sibling, positions directly behind a name, ``last()``, ``and or not()``, ``= !=``, ``contains()``,
``starts-with()``, ``normalize-space()``, ``|``. Anything else is an error when the selector is compiled, not an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .elements import single_spaced

#: (element, its place, the page's texts) -> whether it passes
Test = Callable[[Column, Column, Column], Column]


@dataclass
class Step:
    """``axis``: child, descendant, next, later, parent, ancestor, earlier, self."""

    axis: str
    test: Test


@dataclass
class Selection:
    """Paths whose marks are united, and what is read of marked elements: an attribute, ``text()`` or, by default, the caller's."""

    paths: list[list[Step]] = field(default_factory=list)
    value: str | None = None


class SelectorError(ValueError):
    """A selector that is malformed or not supported."""


def _all(tests: list[Test]) -> Test:
    return lambda e, i, texts: reduce(lambda x, y: x & y, [t(e, i, texts) for t in tests], F.lit(True))


def _any(tests: list[Test]) -> Test:
    return lambda e, i, texts: reduce(lambda x, y: x | y, [t(e, i, texts) for t in tests], F.lit(False))


def _not(test: Test) -> Test:
    return lambda e, i, texts: ~test(e, i, texts)


def _tag(name: str) -> Test:
    name = name.lower()
    return lambda e, i, texts: e["tag"] == name


def _attribute(e: Column, name: str) -> Column:
    return e["attributes"][F.lit(name.lower())]


def _compared(name: str, sign: str, value: str, fold: bool) -> Test:
    value = value.lower() if fold else value

    def test(e: Column, i: Column, texts: Column) -> Column:
        have = F.lower(_attribute(e, name)) if fold else _attribute(e, name)
        if sign in ("^=", "$=", "*=", "~=") and not value or sign == "~=" and re.search(r"\s", value):
            return F.lit(False)
        found = {
            "=": lambda: have == value,
            "~=": lambda: F.array_contains(F.split(have, r"\s+"), value),
            "|=": lambda: (have == value) | have.startswith(value + "-"),
            "^=": lambda: have.startswith(value),
            "$=": lambda: have.endswith(value),
            "*=": lambda: have.contains(value),
        }[sign]()
        return F.coalesce(found, F.lit(False))

    return test


def _counted(which: str, formula: str) -> Test:
    """Elements whose number ``which`` is in an+b."""
    formula = {"odd": "2n+1", "even": "2n"}.get(formula.strip().lower(), formula.replace(" ", "").lower())
    got = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", formula)
    if not got or not formula:
        raise SelectorError(f"no position: {formula!r}")
    a = 0 if got[1] is None else int(got[1] + "1") if got[1] in ("", "+", "-") else int(got[1])
    b = int(got[2] or 0)
    if not a:
        return lambda e, i, texts: e[which] == b
    return lambda e, i, texts: ((e[which] - b) % abs(a) == 0) & ((e[which] - b) * (1 if a > 0 else -1) >= 0)


class _Scanner:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def take(self, pattern: str) -> re.Match[str] | None:
        found = re.compile(pattern).match(self.text, self.at)
        if found:
            self.at = found.end()
        return found

    def need(self, pattern: str) -> re.Match[str]:
        found = self.take(pattern)
        if not found:
            raise SelectorError(f"{self.text!r} at {self.at}: expected {pattern}")
        return found

    @property
    def done(self) -> bool:
        return self.at >= len(self.text)


_NAME = r"-?(?:[A-Za-z_]|[^\x00-\x7F]|\\.)(?:[\w-]|[^\x00-\x7F]|\\.)*"
_PLACES = {"child": ("nth", "nth_last"), "of-type": ("nth_of_tag", "nth_last_of_tag")}


def _plain(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _compound(s: _Scanner) -> Test:
    tests: list[Test] = []
    if found := s.take(_NAME):
        tests.append(_tag(_plain(found[0])))
    elif s.take(r"\*"):
        tests.append(lambda e, i, texts: F.lit(True))
    while True:
        if found := s.take(rf"#({_NAME})"):
            tests.append(_compared("id", "=", _plain(found[1]), False))
        elif found := s.take(rf"\.({_NAME})"):
            tests.append(_compared("class", "~=", _plain(found[1]), False))
        elif s.take(r"\[\s*"):
            name = _plain(s.need(_NAME)[0])
            if sign := s.take(r"\s*([~|^$*]?=)\s*"):
                value = s.need(rf"\"([^\"]*)\"|'([^']*)'|({_NAME}|\d+)")
                fold = bool(s.take(r"\s*[iI](?=\s*\])"))
                tests.append(_compared(name, sign[1], value[1] if value[1] is not None else value[2] if value[2] is not None else _plain(value[3]), fold))
            else:
                tests.append(lambda e, i, texts, name=name: _attribute(e, name).isNotNull())
            s.need(r"\s*\]")
        elif found := s.take(r":(first|last|only)-(child|of-type)"):
            first, last = _PLACES[found[2]]
            tests += [_counted(k, "1") for k in {"first": [first], "last": [last], "only": [first, last]}[found[1]]]
        elif found := s.take(r":nth-(last-)?(child|of-type)\(\s*([^)]*?)\s*\)"):
            tests.append(_counted(_PLACES[found[2]][bool(found[1])], found[3]))
        elif s.take(r":root"):
            tests.append(lambda e, i, texts: e["parent"] < 0)
        elif found := s.take(r":(not|is|where)\(\s*"):
            inner = [_compound(s)]
            while s.take(r"\s*,\s*"):
                inner.append(_compound(s))
            s.need(r"\s*\)")
            tests.append(_not(_any(inner)) if found[1] == "not" else _any(inner))
        else:
            break
    if not tests:
        raise SelectorError(f"{s.text!r} at {s.at}: no selector")
    return _all(tests)


def css(selector: str) -> Selection:
    """Paths of a CSS selector list."""
    s, out = _Scanner(selector.strip()), Selection()
    while True:
        path = [Step("descendant", _compound(s))]
        while not s.done and not s.take(r"\s*,\s*"):
            sign = s.need(r"\s*([>+~])\s*|\s+")[1]
            path.append(Step({">": "child", "+": "next", "~": "later", None: "descendant"}[sign], _compound(s)))
        else:
            out.paths.append(path)
            if s.done and not re.search(r",\s*$", s.text):
                return out
            if s.done:
                raise SelectorError(f"{selector!r} ends in a comma")


def rel(relation: str) -> Selection:
    """Links of a relation."""
    fits = _compared("rel", "~=", relation.strip(), True)
    return Selection([[Step("descendant", _all([_any([_tag("a"), _tag("link"), _tag("area")]), fits]))]])


_AXES = {
    "child": "child", "descendant": "descendant", "parent": "parent", "ancestor": "ancestor", "self": "self",
    "following-sibling": "later", "preceding-sibling": "earlier",
}


def _literal(s: _Scanner) -> str:
    got = s.need(r"\"([^\"]*)\"|'([^']*)'")
    return got[1] if got[1] is not None else got[2]


def _operand(s: _Scanner) -> Callable[[Column, Column, Column], Column]:
    """A string of an element: an attribute, its own text, or all text in it; null where it has none."""
    if found := s.take(r"@([\w:-]+)"):
        return lambda e, i, texts: _attribute(e, found[1])
    if s.take(r"text\(\)"):
        return lambda e, i, texts: F.array_join(F.transform(F.filter(texts, lambda t: t["owner"] == i), lambda t: t["text"]), "")
    if s.take(r"normalize-space\(\s*"):
        inner = _operand(s) if not s.take(r"(?=\))") else _whole
        s.need(r"\s*\)")
        return lambda e, i, texts: single_spaced(inner(e, i, texts))
    s.need(r"\.(?!\.)")
    return _whole


def _whole(e: Column, i: Column, texts: Column) -> Column:
    return F.array_join(F.transform(F.filter(texts, lambda t: (t["owner"] >= i) & (t["owner"] <= e["last"])), lambda t: t["text"]), "")


def _term(s: _Scanner) -> Test:
    if s.take(r"not\(\s*"):
        inner = _either(s)
        s.need(r"\s*\)")
        return _not(inner)
    if s.take(r"\(\s*"):
        inner = _either(s)
        s.need(r"\s*\)")
        return inner
    if found := s.take(r"(contains|starts-with)\(\s*"):
        text = _operand(s)
        s.need(r"\s*,\s*")
        part = _literal(s)
        s.need(r"\s*\)")
        holds = (lambda v: v.contains(part)) if found[1] == "contains" else (lambda v: v.startswith(part))
        return lambda e, i, texts: holds(F.coalesce(text(e, i, texts), F.lit("")))
    text = _operand(s)
    if sign := s.take(r"\s*(!?=)\s*"):
        value = _literal(s)
        equal = (lambda v: v == value) if sign[1] == "=" else (lambda v: v != value)
        return lambda e, i, texts: F.coalesce(equal(text(e, i, texts)), F.lit(False))
    return lambda e, i, texts: F.coalesce(text(e, i, texts), F.lit("")) != "" if text is _whole else text(e, i, texts).isNotNull()


def _both(s: _Scanner) -> Test:
    tests = [_term(s)]
    while s.take(r"\s+and\s+"):
        tests.append(_term(s))
    return _all(tests)


def _either(s: _Scanner) -> Test:
    tests = [_both(s)]
    while s.take(r"\s+or\s+"):
        tests.append(_both(s))
    return _any(tests)


def _location(s: _Scanner) -> tuple[list[Step], str | None]:
    path: list[Step] = []
    axis = "descendant" if s.take(r"\.?//") else "child" if s.take(r"\.?/") else "child"
    while True:
        if found := s.take(r"@([\w:*-]+)"):
            if axis == "descendant" and path:
                path.append(Step("descendant-or-self", lambda e, i, texts: F.lit(True)))
            elif not path:
                path.append(Step("descendant", lambda e, i, texts: F.lit(True)))
            return path, "@" + found[1].lower()
        if s.take(r"text\(\)"):
            return path, "text()"
        if s.take(r"\.\."):
            path.append(Step("parent", lambda e, i, texts: F.lit(True)))
        elif s.take(r"\."):
            path.append(Step("self", lambda e, i, texts: F.lit(True)))
        else:
            if found := s.take(r"([a-z-]+)::"):
                if found[1] not in _AXES:
                    raise SelectorError(f"axis {found[1]} is not supported")
                axis = _AXES[found[1]]
            name = s.need(r"\*|[\w-]+")[0]
            tests: list[Test] = [_tag(name)] if name != "*" else []
            numbers = ("nth_of_tag", "nth_last_of_tag") if name != "*" else ("nth", "nth_last")
            first = True
            while s.take(r"\[\s*"):
                if found := s.take(r"(?:position\(\)\s*=\s*)?(?:(\d+)|last\(\))(?=\s*\])"):
                    if not first or axis not in ("child", "descendant"):
                        raise SelectorError("a position must stand directly behind a name, on the child axis or behind //")
                    tests.append(_counted(numbers[0], found[1]) if found[1] else _counted(numbers[1], "1"))
                else:
                    tests.append(_either(s))
                s.need(r"\s*\]")
                first = False
            path.append(Step(axis, _all(tests)))
        if s.take(r"//"):
            axis = "descendant"
        elif s.take(r"/"):
            axis = "child"
        else:
            return path, None


def xpath(expression: str) -> Selection:
    """Paths of an XPath expression; an expression that ends in an attribute or ``text()`` says what is read."""
    s, out, values = _Scanner(expression.strip()), Selection(), set()
    while True:
        path, value = _location(s)
        out.paths.append(path)
        values.add(value)
        if s.done:
            break
        s.need(r"\s*\|\s*")
    if len(values) > 1:
        raise SelectorError("paths of one expression must give one kind of value")
    out.value = values.pop()
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _step(elements: Column, texts: Column, step: Step, marks: Column | None) -> Column:
    """Marks after ``step``; ``marks`` is null at the document."""

    def related(e: Column, i: Column) -> Column:
        if marks is None:
            return {"descendant": F.lit(True), "child": e["parent"] < 0}.get(step.axis, F.lit(False))
        if step.axis == "child":
            return F.get(marks, e["parent"])
        if step.axis == "descendant":
            return F.exists(e["above"], lambda p: F.get(marks, p))
        if step.axis == "descendant-or-self":
            return F.get(marks, i) | F.exists(e["above"], lambda p: F.get(marks, p))
        if step.axis == "next":
            return F.get(marks, e["before"])
        if step.axis == "self":
            return F.get(marks, i)
        raise SelectorError(step.axis)

    if marks is not None and step.axis in ("later", "earlier", "parent", "ancestor"):
        # families (or elements) that hold a mark, as a map from place to the first or last mark
        marked = F.filter(F.transform(elements, lambda e, i: F.struct(i.alias("place"), e["parent"].alias("parent"), e["above"].alias("above"))), lambda m: F.get(marks, m["place"]))
        if step.axis == "parent":
            return _let(F.transform(marked, lambda m: m["parent"]), lambda held: F.transform(elements, lambda e, i: F.array_contains(held, i) & step.test(e, i, texts)))
        if step.axis == "ancestor":
            held = F.array_distinct(F.flatten(F.transform(marked, lambda m: m["above"])))
            return _let(held, lambda held: F.transform(elements, lambda e, i: F.array_contains(held, i) & step.test(e, i, texts)))
        beyond = (lambda m, i: m["place"] < i) if step.axis == "later" else (lambda m, i: m["place"] > i)
        return _let(marked, lambda marked: F.transform(elements, lambda e, i: step.test(e, i, texts) & F.exists(marked, lambda m: (m["parent"] == e["parent"]) & beyond(m, i))))
    return F.transform(elements, lambda e, i: F.coalesce(related(e, i), F.lit(False)) & step.test(e, i, texts))


def marks(tree: Column, selection: Selection) -> Column:
    """array<boolean>: which elements of ``tree`` are selected."""
    elements, texts = tree["elements"], tree["texts"]

    def along(path: list[Step], before: Column | None) -> Column:
        if not path:
            return before
        now = _step(elements, texts, path[0], before)
        return now if len(path) == 1 else _let(now, lambda m: along(path[1:], m))

    found = [along(path, None) for path in selection.paths]
    if len(found) == 1:
        return found[0]
    return reduce(lambda x, y: F.zip_with(x, y, lambda a, b: a | b), found)


def places(tree: Column, selection: Selection) -> Column:
    """array<int>: places of selected elements in document order."""
    which = F.transform(marks(tree, selection), lambda m, i: F.when(m, i))
    return F.filter(which, lambda i: i.isNotNull())


def values(tree: Column, selection: Selection, attribute: str = "href") -> Column:
    """array<string> in document order: the attribute of selected elements that have it, or what the expression names."""
    read = selection.value
    if read == "text()":
        chosen = places(tree, selection)
        return _let(chosen, lambda at: F.transform(F.filter(tree["texts"], lambda t: F.array_contains(at, t["owner"])), lambda t: t["text"]))
    if read == "@*":
        return _let(marks(tree, selection), lambda on: F.flatten(F.transform(F.filter(F.transform(tree["elements"], lambda e, i: F.struct(F.map_values(e["attributes"]).alias("v"), F.get(on, i).alias("on"))), lambda p: p["on"]), lambda p: p["v"])))
    name = read[1:] if read else attribute
    found = _let(marks(tree, selection), lambda on: F.transform(tree["elements"], lambda e, i: F.when(F.get(on, i), _attribute(e, name))))
    return F.filter(found, lambda v: v.isNotNull() if read else v.isNotNull() & (v != ""))


def compiled(selector: str, kind: str = "css") -> Selection:
    """``kind``: css, xpath or rel."""
    kinds = {"css": css, "xpath": xpath, "rel": rel}
    if kind not in kinds:
        raise SelectorError(f"no kind of selector: {kind!r}")
    return kinds[kind](selector)
