"""Compiled schemas against a plain recursive validator on generated documents, and the problems' pointers."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from obsidra.functions import schemas

KINDS = {
    "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None, "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list),
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool), "integer": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v),
}


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return type(a) is type(b) and a == b if isinstance(a, (str, list, dict)) or isinstance(b, (str, list, dict)) else a == b


def plain(schema, v, root, at="", path="#"):
    """{(pointer, path, keyword)} by the specification."""
    if schema is True:
        return set()
    if schema is False:
        return {(at, path, "false")}
    out = set()
    bad = lambda k, where=at: out.add((where, path, k))
    sub = lambda s, x=v, a=at, p=path: plain(s, x, root, a, p)
    num, text = KINDS["number"](v), isinstance(v, str)
    for k, w in schema.items():
        if k == "type" and not any(KINDS[t](v) for t in ([w] if isinstance(w, str) else w)):
            bad(k)
        if k == "enum" and not any(same(v, x) for x in w) or k == "const" and not same(v, w):
            bad(k)
        if num and (k == "minimum" and v < w or k == "maximum" and v > w or k == "exclusiveMinimum" and v <= w or k == "exclusiveMaximum" and v >= w or k == "multipleOf" and abs(v / w - round(v / w)) > 1e-9):
            bad(k)
        if text and (k == "minLength" and len(v) < w or k == "maxLength" and len(v) > w or k == "pattern" and not re.search(w, v)):
            bad(k)
        if isinstance(v, list):
            if k == "minItems" and len(v) < w or k == "maxItems" and len(v) > w or k == "uniqueItems" and len({json.dumps(x, sort_keys=True) for x in v}) < len(v):
                bad(k)
            if k == "prefixItems":
                for i, s in enumerate(w[: len(v)]):
                    out |= sub(s, v[i], f"{at}/{i}", f"{path}/prefixItems/{i}")
            if k == "items":
                for i in range(len(schema.get("prefixItems", [])), len(v)):
                    out |= sub(w, v[i], f"{at}/{i}", f"{path}/items")
            if k == "contains" and not schema.get("minContains", 1) <= sum(not sub(w, x) for x in v) <= schema.get("maxContains", 99):
                bad(k)
        if isinstance(v, dict):
            known = lambda m: m in schema.get("properties", {}) or any(re.search(p, m) for p in schema.get("patternProperties", {}))
            if k == "properties":
                for m in w.keys() & v.keys():
                    out |= sub(w[m], v[m], f"{at}/{m}", f"{path}/properties/{m}")
            if k == "required" and any(m not in v for m in w) or k == "minProperties" and len(v) < w or k == "maxProperties" and len(v) > w:
                bad(k)
            if k == "dependentRequired" and any(m in v and n not in v for m in w for n in w[m]):
                bad(k)
            if k == "additionalProperties":
                extra = [m for m in v if not known(m)]
                if w is False:
                    if extra:
                        bad(k)
                else:
                    for m in extra:
                        out |= sub(w, v[m], f"{at}/{m}", f"{path}/additionalProperties")
            if k == "patternProperties":
                for p, s in w.items():
                    for m in v:
                        if re.search(p, m):
                            out |= sub(s, v[m], f"{at}/{m}", f"{path}/patternProperties/{p}")
            if k == "propertyNames":
                for m in v:
                    out |= sub(w, m, at, f"{path}/propertyNames")
        if k == "allOf":
            for i, s in enumerate(w):
                out |= sub(s, p=f"{path}/allOf/{i}")
        if k == "anyOf" and all(sub(s) for s in w) or k == "oneOf" and sum(not sub(s) for s in w) != 1 or k == "not" and not sub(w):
            bad(k)
        if k == "if":
            branch = "else" if sub(w) else "then"
            out |= sub(schema.get(branch, True), p=f"{path}/{branch}")
        if k == "$ref":
            out |= sub(root["$defs"][w.split("/")[-1]], p=f"{path}/$ref")
    return out


SCHEMAS = [
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "null"], "minimum": 1, "exclusiveMaximum": 5}, "b": {"enum": ["x", 2, None, True, [1], {"k": 1}]}}, "additionalProperties": False},
    {"properties": {"c": {"type": "array", "minItems": 1, "maxItems": 3, "uniqueItems": True, "items": {"type": "number", "multipleOf": 0.5}}, "a": {"const": 1.0}}, "patternProperties": {"^b": {"type": "string"}}, "additionalProperties": {"type": "boolean"}},
    {"oneOf": [{"required": ["a"]}, {"required": ["b"]}], "anyOf": [{"properties": {"c": {"type": "array"}}, "required": ["c"]}, {"maxProperties": 2}], "not": {"required": ["d"], "properties": {"d": {"const": "x"}}}},
    {"if": {"properties": {"a": {"type": "string"}}, "required": ["a"]}, "then": {"required": ["b"]}, "else": {"minProperties": 2}, "dependentRequired": {"c": ["d"]}, "propertyNames": {"pattern": "^[a-d]$", "maxLength": 1}},
    {"allOf": [{"$ref": "#/$defs/named"}, {"type": "object"}], "$defs": {"named": {"properties": {"d": {"$ref": "#/$defs/text"}, "c": {"items": {"$ref": "#/$defs/text"}, "prefixItems": [{"type": "integer"}, True]}}}, "text": {"type": "string", "minLength": 1, "maxLength": 2, "pattern": "[a-y]"}}},
    {"properties": {"c": {"contains": {"type": "string"}, "minContains": 1, "maxContains": 2, "maxItems": 4}, "d": False, "a": {"minimum": 0, "exclusiveMinimum": -1, "maximum": 3}}},
]


def documents(seed=11, n=120):
    rng = random.Random(seed)

    def value(depth=0):
        kinds = [1, 2, 2.5, 7, -1, 0.5, "", "x", "zz", "xyz", None, True, False, [1], {"k": 1}]
        if depth < 2 and rng.random() < 0.4:
            return [value(depth + 1) for _ in range(rng.randrange(5))]
        return rng.choice(kinds)

    out = [{m: value() for m in rng.sample(["a", "b", "c", "d", "b2"], rng.randrange(5))} for _ in range(n)]
    return [*out, {"a": 2, "b": "x"}, {"a": None, "b": {"k": 1}}, {"a": 1, "c": [0.5, 2]}, {"b": "", "c": ["x"]}, {"d": "xy", "c": [1, 2, "a"]}, [], 3, "x", None, True]


@pytest.mark.parametrize("schema", SCHEMAS)
def test_problems_equal_the_plain_validator(spark, schema):
    docs = documents()
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, t string").select("i", F.try_parse_json("t").alias("d"))
    got = {r["i"]: r["p"] for r in rows.select("i", schemas.schema_problems(F.col("d"), schema).alias("p")).collect()}
    wrong = 0
    for i, d in enumerate(docs):
        want = plain(schema, d, schema)
        assert {tuple(p) for p in got[i]} == want, (d, got[i], want)
        wrong += bool(want)
    assert 5 < wrong < len(docs)


def test_answers_recursion_and_other_documents(spark):
    tree = {"$ref": "#/$defs/node", "$defs": {"node": {"type": "object", "properties": {"kids": {"type": "array", "items": {"$ref": "#/$defs/node"}}, "id": {"$ref": "ids.json#/$defs/Id"}}, "required": ["id"]}}}
    others = {"ids.json": {"$defs": {"Id": {"$ref": "#/$defs/Text"}, "Text": {"type": "string"}}}}
    nest = lambda n: {"id": "x", "kids": [nest(n - 1)]} if n else {"id": 1}
    given = ['```json\n{"id":"a","kids":[{"id":"b"}]}\n```', "{broken", json.dumps(nest(1)), json.dumps(nest(6)), None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    document, problems = schemas.checked_output(F.col("t"), tree, others)
    got = {r["i"]: [tuple(p) for p in r["p"]] for r in rows.select("i", problems.alias("p")).collect()}
    assert got[0] == [] and got[1] == got[4] == [("", "", "json")]
    assert got[2] == [("/kids/0/id", "#/$ref/properties/kids/items/$ref/properties/id/$ref/$ref", "type")]
    assert got[3] == [("/kids/0" * 4, "#/$ref" + "/properties/kids/items/$ref" * 3 + "/properties/kids/items", "$ref")]  # deeper than is checked
    hint = rows.where("i = 2").select(schemas.hints(problems).alias("h")).first()["h"]
    assert [tuple(h) for h in hint] == [(got[2][0][1], "type")]


@pytest.mark.parametrize("schema", [{"type": "text"}, {"unevaluatedProperties": False}, {"$ref": "#/$defs/none"}, {"$ref": "other.json#/x"}, {"items": 3}])
def test_schemas_that_cannot_be_compiled(schema):
    with pytest.raises(schemas.SchemaError):
        schemas.schema_problems(F.lit(None).cast("string"), schema)
