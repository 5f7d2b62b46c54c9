"""JSON Schema compiled to a column expression over a variant: problems with pointers, no Python per row.

Keywords: type (also lists), enum, const, minimum, maximum, exclusiveMinimum, exclusiveMaximum, multipleOf, minLength,
maxLength, pattern, minItems, maxItems, uniqueItems, prefixItems, items, contains (with minContains and maxContains), properties,
required, additionalProperties, patternProperties, propertyNames, minProperties, maxProperties, dependentRequired,
allOf, anyOf, oneOf, not, if/then/else, $ref to definitions of the same document or of other given ones. Annotations
(title, description, format, default, ...) say nothing about validity. A keyword that is neither is an error when the
schema is compiled. Patterns are searched as Java's.

A problem is (pointer of the value, schema path, keyword). Hints for a writer who may see no data are the schema paths and
keywords alone (:func:`hints`). A value nested deeper in a recursive definition than ``deepest`` times is a problem of
the keyword ``$ref``: it is not checked, and not passed silently. Of two members of one name the parser refuses the
document.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip_fences

PROBLEM = "array<struct<pointer:string,path:string,keyword:string>>"
#: Keywords that don't decide.
ANNOTATIONS = frozenset(
    "$schema $id $defs definitions $comment $anchor title description default examples format deprecated readOnly writeOnly contentMediaType contentEncoding".split()
)
#: Keywords read by another one.
_READ_ALONG = frozenset("then else minContains maxContains".split())
_KINDS = {
    "string": ["STRING"], "boolean": ["BOOLEAN"], "null": ["VOID"], "object": ["OBJECT"], "array": ["ARRAY"], "number": ["BIGINT", "DECIMAL", "DOUBLE"],
}


class SchemaError(ValueError):
    """A schema that is malformed or uses what is not supported."""


def _none() -> Column:
    return F.array().cast(PROBLEM)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _joined(parts: list[Column]) -> Column:
    return _none() if not parts else parts[0] if len(parts) == 1 else F.concat(*parts)


def _escaped(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def _quoted(name: str) -> str:
    if "'" in name and '"' in name:
        raise SchemaError(f"a member named {name!r} can't be addressed")
    return f"['{name}']" if "'" not in name else f'["{name}"]'


def _canonical(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


class _Value:
    """A variant under check: bound to a lambda's variable with its kind, so that both are computed once."""

    def __init__(self, bound: Column, at: Column) -> None:
        self.value, self.kind, self.at = bound["value"], bound["kind"], at

    def number(self) -> Column:
        return F.try_variant_get(self.value, "$", "double")

    def string(self) -> Column:
        return F.try_variant_get(self.value, "$", "string")

    def items(self) -> Column:
        return F.try_variant_get(self.value, "$", "array<variant>")

    def members(self) -> Column:
        return F.try_variant_get(self.value, "$", "map<string,variant>")

    def is_a(self, kind: str) -> Column:
        if kind == "integer":
            return self.kind.isin(_KINDS["number"]) & (self.number() == F.floor(self.number()))
        if kind not in _KINDS:
            raise SchemaError(f"no type {kind!r}")
        return self.kind.isin(_KINDS[kind])

    def equals(self, other: Any) -> Column:
        if other is None or isinstance(other, bool):
            return self.is_a("null") if other is None else self.is_a("boolean") & (F.try_variant_get(self.value, "$", "boolean") == other)
        if isinstance(other, (int, float)):
            return self.is_a("number") & (self.number() == float(other))
        if isinstance(other, str):
            return self.is_a("string") & (self.string() == other)
        return self.is_a("object" if isinstance(other, dict) else "array") & (F.to_json(self.value) == _canonical(other))


class _Compiler:
    def __init__(self, root: Mapping[str, Any], others: Mapping[str, Mapping[str, Any]], deepest: int) -> None:
        self.documents = {"": root, **others}
        self.deepest = deepest

    def found(self, reference: str, home: str) -> tuple[Any, str]:
        document, _, pointer = reference.partition("#")
        document = document or home
        if document not in self.documents:
            raise SchemaError(f"unknown document in $ref {reference!r}")
        at: Any = self.documents[document]
        for token in pointer.split("/")[1:]:
            token = token.replace("~1", "/").replace("~0", "~")
            try:
                at = at[int(token)] if isinstance(at, list) else at[token]
            except (KeyError, IndexError, ValueError, TypeError) as e:
                raise SchemaError(f"nothing at $ref {reference!r}") from e
        return at, document

    def check(self, schema: Any, value: Column, at: Column, path: str, home: str, inside: tuple[str, ...] = ()) -> Column:
        """Problems of a variant expression; none where it is absent (SQL null)."""
        if schema is True or schema == {}:
            return _none()
        bound = F.struct(value.alias("value"), F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0).alias("kind"))
        return _let(bound, lambda b: F.when(b["value"].isNotNull(), self.problems(schema, _Value(b, at), path, home, inside)).otherwise(_none()))

    def problems(self, schema: Any, v: _Value, path: str, home: str, inside: tuple[str, ...]) -> Column:
        if schema is False:
            return self.unless(F.lit(False), v.at, path, "false")
        if schema is True:
            return _none()
        if not isinstance(schema, Mapping):
            raise SchemaError(f"{path}: a schema is an object or a truth value")
        out = []
        for keyword, wanted in schema.items():
            if keyword in ANNOTATIONS or keyword in _READ_ALONG:
                continue
            rule = getattr(self, "k_" + keyword.replace("$", ""), None)
            if rule is None:
                raise SchemaError(f"{path}: keyword {keyword!r} is not supported")
            out.append(rule(wanted, schema, v, path, home, inside))
        return _joined(out)

    @staticmethod
    def unless(holds: Column, at: Column, path: str, keyword: str) -> Column:
        problem = F.array(F.struct(at.alias("pointer"), F.lit(path).alias("path"), F.lit(keyword).alias("keyword")))
        return F.when(F.coalesce(holds, F.lit(False)), _none()).otherwise(problem)

    def of_kind(self, kind: str, holds: Callable[[], Column], v: _Value, path: str, keyword: str) -> Column:
        """A keyword that says nothing about values of other kinds."""
        return self.unless(~v.is_a(kind) | holds(), v.at, path, keyword)

    # any value

    def k_type(self, wanted, schema, v, path, home, inside):
        kinds = [wanted] if isinstance(wanted, str) else list(wanted)
        return self.unless(reduce(lambda x, y: x | y, [v.is_a(k) for k in kinds]), v.at, path, "type")

    def k_enum(self, wanted, schema, v, path, home, inside):
        return self.unless(reduce(lambda x, y: x | y, [F.coalesce(v.equals(w), F.lit(False)) for w in wanted], F.lit(False)), v.at, path, "enum")

    def k_const(self, wanted, schema, v, path, home, inside):
        return self.unless(v.equals(wanted), v.at, path, "const")

    # numbers and strings

    def k_minimum(self, wanted, schema, v, path, home, inside):
        return self.of_kind("number", lambda: v.number() >= float(wanted), v, path, "minimum")

    def k_maximum(self, wanted, schema, v, path, home, inside):
        return self.of_kind("number", lambda: v.number() <= float(wanted), v, path, "maximum")

    def k_exclusiveMinimum(self, wanted, schema, v, path, home, inside):
        return self.of_kind("number", lambda: v.number() > float(wanted), v, path, "exclusiveMinimum")

    def k_exclusiveMaximum(self, wanted, schema, v, path, home, inside):
        return self.of_kind("number", lambda: v.number() < float(wanted), v, path, "exclusiveMaximum")

    def k_multipleOf(self, wanted, schema, v, path, home, inside):
        times = v.number() / float(wanted)
        return self.of_kind("number", lambda: F.abs(times - F.rint(times)) < 1e-9, v, path, "multipleOf")

    def k_minLength(self, wanted, schema, v, path, home, inside):
        return self.of_kind("string", lambda: F.length(v.string()) >= wanted, v, path, "minLength")

    def k_maxLength(self, wanted, schema, v, path, home, inside):
        return self.of_kind("string", lambda: F.length(v.string()) <= wanted, v, path, "maxLength")

    def k_pattern(self, wanted, schema, v, path, home, inside):
        return self.of_kind("string", lambda: v.string().rlike(wanted), v, path, "pattern")

    # arrays

    def k_minItems(self, wanted, schema, v, path, home, inside):
        return self.of_kind("array", lambda: F.size(v.items()) >= wanted, v, path, "minItems")

    def k_maxItems(self, wanted, schema, v, path, home, inside):
        return self.of_kind("array", lambda: F.size(v.items()) <= wanted, v, path, "maxItems")

    def k_uniqueItems(self, wanted, schema, v, path, home, inside):
        texts = F.transform(v.items(), lambda e: F.coalesce(F.to_json(e), F.lit("null")))
        return self.of_kind("array", lambda: F.size(F.array_distinct(texts)) == F.size(texts), v, path, "uniqueItems") if wanted else _none()

    def k_prefixItems(self, wanted, schema, v, path, home, inside):
        each = [self.check(s, F.get(v.items(), F.lit(i)), F.concat(v.at, F.lit(f"/{i}")), f"{path}/prefixItems/{i}", home, inside) for i, s in enumerate(wanted)]
        return F.when(v.is_a("array"), _joined(each)).otherwise(_none())

    def k_items(self, wanted, schema, v, path, home, inside):
        skip = len(schema.get("prefixItems", []))
        one = lambda e, i: F.when(i >= skip, self.check(wanted, e, F.concat(v.at, F.lit("/"), i.cast("string")), f"{path}/items", home, inside)).otherwise(_none())
        return F.when(v.is_a("array"), F.flatten(F.transform(v.items(), one))).otherwise(_none())

    def k_contains(self, wanted, schema, v, path, home, inside):
        fits = F.size(F.filter(v.items(), lambda e: F.size(self.check(wanted, e, v.at, path, home, inside)) == 0))
        enough = fits >= schema.get("minContains", 1)
        if "maxContains" in schema:
            enough = enough & (fits <= schema["maxContains"])
        return self.of_kind("array", lambda: enough, v, path, "contains")

    # objects

    def _member(self, v: _Value, name: str) -> Column:
        return F.try_variant_get(v.value, "$" + _quoted(name), "variant")

    def k_properties(self, wanted, schema, v, path, home, inside):
        each = [self.check(s, self._member(v, name), F.concat(v.at, F.lit("/" + _escaped(name))), f"{path}/properties/{_escaped(name)}", home, inside) for name, s in wanted.items()]
        return F.when(v.is_a("object"), _joined(each)).otherwise(_none())

    def k_required(self, wanted, schema, v, path, home, inside):
        each = [self.unless(self._member(v, name).isNotNull(), v.at, path, "required") for name in wanted]
        return F.when(v.is_a("object"), _joined(each)).otherwise(_none())

    def k_dependentRequired(self, wanted, schema, v, path, home, inside):
        each = [self.unless(self._member(v, name).isNull() | self._member(v, need).isNotNull(), v.at, path, "dependentRequired") for name, needs in wanted.items() for need in needs]
        return F.when(v.is_a("object"), _joined(each)).otherwise(_none())

    def _extra(self, schema, v: _Value) -> Column:
        """Members that neither ``properties`` names nor ``patternProperties`` fits."""
        named, patterns = list(schema.get("properties", {})), list(schema.get("patternProperties", {}))
        known = lambda k: reduce(lambda x, y: x | y, [k.rlike(p) for p in patterns], k.isin(named) if named else F.lit(False))
        return F.map_filter(v.members(), lambda k, _: ~known(k))

    def _each(self, members: Column, wanted, v: _Value, path, home, inside) -> Column:
        pointer = lambda k: F.concat(v.at, F.lit("/"), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))
        return F.flatten(F.transform(F.map_entries(members), lambda m: self.check(wanted, m["value"], pointer(m["key"]), path, home, inside)))

    def k_additionalProperties(self, wanted, schema, v, path, home, inside):
        if wanted is False:
            return self.of_kind("object", lambda: F.size(self._extra(schema, v)) == 0, v, path, "additionalProperties")
        return F.when(v.is_a("object"), self._each(self._extra(schema, v), wanted, v, f"{path}/additionalProperties", home, inside)).otherwise(_none())

    def k_patternProperties(self, wanted, schema, v, path, home, inside):
        fitting = lambda pattern: F.map_filter(v.members(), lambda k, _: k.rlike(pattern))
        each = [self._each(fitting(pattern), s, v, f"{path}/patternProperties/{_escaped(pattern)}", home, inside) for pattern, s in wanted.items()]
        return F.when(v.is_a("object"), _joined(each)).otherwise(_none())

    def k_propertyNames(self, wanted, schema, v, path, home, inside):
        as_text = lambda k: F.try_variant_get(F.to_variant_object(F.array(k)), "$[0]", "variant")
        each = F.transform(F.map_keys(v.members()), lambda k: self.check(wanted, as_text(k), v.at, f"{path}/propertyNames", home, inside))
        return F.when(v.is_a("object"), F.flatten(each)).otherwise(_none())

    def k_minProperties(self, wanted, schema, v, path, home, inside):
        return self.of_kind("object", lambda: F.size(v.members()) >= wanted, v, path, "minProperties")

    def k_maxProperties(self, wanted, schema, v, path, home, inside):
        return self.of_kind("object", lambda: F.size(v.members()) <= wanted, v, path, "maxProperties")

    # schemas in schemas

    def _fits(self, schema, v: _Value, path, home, inside) -> Column:
        return F.size(self.problems(schema, v, path, home, inside)) == 0

    def k_allOf(self, wanted, schema, v, path, home, inside):
        return _joined([self.problems(s, v, f"{path}/allOf/{i}", home, inside) for i, s in enumerate(wanted)])

    def k_anyOf(self, wanted, schema, v, path, home, inside):
        return self.unless(reduce(lambda x, y: x | y, [self._fits(s, v, path, home, inside) for s in wanted]), v.at, path, "anyOf")

    def k_oneOf(self, wanted, schema, v, path, home, inside):
        return self.unless(reduce(lambda x, y: x + y, [self._fits(s, v, path, home, inside).cast("int") for s in wanted]) == 1, v.at, path, "oneOf")

    def k_not(self, wanted, schema, v, path, home, inside):
        return self.unless(~self._fits(wanted, v, path, home, inside), v.at, path, "not")

    def k_if(self, wanted, schema, v, path, home, inside):
        then, other = (self.problems(schema.get(k, True), v, f"{path}/{k}", home, inside) for k in ("then", "else"))
        return F.when(self._fits(wanted, v, path, home, inside), then).otherwise(other)

    def k_ref(self, wanted, schema, v, path, home, inside):
        target, document = self.found(wanted, home)
        name = f"{document}|{wanted.partition('#')[2]}"
        if inside.count(name) >= self.deepest:
            return self.unless(F.lit(False), v.at, path, "$ref")
        return self.problems(target, v, f"{path}/$ref", document, (*inside, name))


def schema_problems(document: Column, schema: Mapping[str, Any], others: Mapping[str, Mapping[str, Any]] | None = None, deepest: int = 4) -> Column:
    """array<struct<pointer, path, keyword>>: where a VARIANT breaks ``schema``; null for null.

    ``others``: documents that $ref may name. ``deepest``: how often a definition may stand inside itself.
    """
    return F.when(document.isNotNull(), _Compiler(schema, others or {}, deepest).check(schema, document, F.lit(""), "#", ""))


def checked_output(text: Column, schema: Mapping[str, Any], others: Mapping[str, Mapping[str, Any]] | None = None, deepest: int = 4) -> tuple[Column, Column]:
    """(document, problems) of a model's answer, whose fences are taken off; no JSON is a problem of the whole."""
    document = F.try_parse_json(strip_fences(text))
    broken = F.array(F.struct(F.lit("").alias("pointer"), F.lit("").alias("path"), F.lit("json").alias("keyword")))
    return document, F.coalesce(schema_problems(document, schema, others, deepest), broken.cast(PROBLEM))


def hints(problems: Column) -> Column:
    """array<struct<path, keyword>>: what to mend, in terms of the schema alone."""
    return F.array_distinct(F.transform(problems, lambda p: F.struct(p["path"].alias("path"), p["keyword"].alias("keyword"))))
