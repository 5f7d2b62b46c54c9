"""JSON documents: paths, typed reading, comparison, three-way merging, layered limits."""

from __future__ import annotations

import difflib
import gzip
import json
import re
import zlib
from collections.abc import Mapping, Sequence
from typing import Any
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import by_batch, by_values

DIFFERENCE = "array<struct<pointer:string,expected:string,actual:string>>"


def canonical_dumps(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def canonical_json(document: Column) -> Column:
    """Sorted names, no spaces, non-ASCII kept; null for what is no JSON."""

    @by_batch("string")
    def run(text):
        try:
            return None if text is None else canonical_dumps(json.loads(text))
        except ValueError:
            return None

    return run(document)


def get_path(document: Column, path: str, kind: str = "string") -> tuple[Column, Column]:
    """(found, value) of a dotted path in a VARIANT; a JSON null is found."""
    place = "$" + "".join(f"['{p}']" for p in path.split("."))
    return F.try_variant_get(document, place, "variant").isNotNull(), F.try_variant_get(document, place, kind)


def path_steps(path: str) -> list[tuple[str, Any]]:
    """Steps of a JSONPath of keys, indexes, wildcards and recursive descent; nothing else is allowed."""
    if not path.startswith("$"):
        raise ValueError("a path starts with $")
    steps: list[tuple[str, Any]] = []
    token = re.compile(r"(\.\.)?(?:\.?([A-Za-z_][\w-]*)|\.?(\*)|\[(-?\d+)\]|\[\*\]|\['([^']*)'\]|\[\"([^\"]*)\"\])")
    at = 1
    while at < len(path):
        m = token.match(path, at)
        if not m or m.end() == at:
            raise ValueError(f"unsupported path {path!r}")
        if m[1]:
            steps.append(("deep", None))
        name = m[2] or m[5] or m[6]
        steps.append(("key", name) if name is not None else ("index", int(m[4])) if m[4] else ("any", None))
        at = m.end()
    return steps


def find_path(value: Any, steps: Sequence[tuple[str, Any]]) -> list[Any]:
    nodes = [value]
    for kind, what in steps:
        found: list[Any] = []
        for node in nodes:
            inner = list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else []
            if kind == "key":
                found += [node[what]] if isinstance(node, dict) and what in node else []
            elif kind == "index":
                found += [node[what]] if isinstance(node, list) and -len(node) <= what < len(node) else []
            elif kind == "any":
                found += inner
            else:  # the node and all below it, in document order
                stack = [node]
                while stack:
                    top = stack.pop()
                    found.append(top)
                    stack += reversed(list(top.values()) if isinstance(top, dict) else top if isinstance(top, list) else [])
        nodes = found
    return nodes


def json_path(document: Column, path: str) -> Column:
    """All values at ``path`` as JSON texts. Plain keys and indexes run natively."""
    steps = path_steps(path)
    if all(k == "key" or k == "index" and v >= 0 for k, v in steps):
        place = "$" + "".join(f"['{v}']" if k == "key" else f"[{v}]" for k, v in steps)
        got = F.try_variant_get(F.try_parse_json(document), place, "variant")
        return F.when(got.isNotNull(), F.array(F.to_json(got))).otherwise(F.array().cast("array<string>"))

    @by_batch("array<string>")
    def run(text):
        try:
            return [json.dumps(v, separators=(",", ":"), ensure_ascii=False) for v in find_path(json.loads(text), steps)] if text is not None else []
        except ValueError:
            return []

    return run(document)


def flatten(value: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested members by dotted paths."""
    out: dict[str, Any] = {}
    for key, inner in value.items():
        name = f"{prefix}{key}"
        out |= flatten(inner, name + ".") if isinstance(inner, Mapping) else {name: inner}
    return out


def unflatten(value: Mapping[str, Any]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for name, inner in value.items():
        *above, last = name.split(".")
        node = out
        for part in above:
            node = node.setdefault(part, {})
        node[last] = inner
    return out


def flatten_json(document: Column) -> Column:
    """map<path, JSON text>."""

    @by_batch("map<string,string>")
    def run(text):
        return None if text is None else {k: json.dumps(v, ensure_ascii=False) for k, v in flatten(json.loads(text)).items()}

    return run(document)


def merge_limits(levels: DataFrame, by: list[str], caps: Mapping[str, float]) -> DataFrame:
    """Layered limits (by, level ordinal, name, value): the deepest level wins, hard caps hold; with provenance."""
    cap = F.create_map(*[F.lit(x) for kv in caps.items() for x in (kv[0], float(kv[1]))]) if caps else F.expr("map('', 0D)")
    top = levels.where("value is not null").groupBy(*by, "name").agg(F.max_by("value", "ordinal").alias("asked"), F.max_by("level", "ordinal").alias("level"))
    most = F.try_element_at(cap, F.col("name"))
    return top.withColumn("value", F.least("asked", most)).withColumn("provenance", F.when(F.col("asked") > most, F.concat("level", F.lit(" (capped)"))).otherwise(F.col("level"))).drop("asked", "level")


def typed(document: Column, path: str, kind: str) -> tuple[Column, Column]:
    """(value, misfit) of a member that should be ``kind``: what doesn't fit is kept as JSON text."""
    place = "$" + "".join(f"['{p}']" for p in path.split("."))
    raw = F.try_variant_get(document, place, "variant")
    shape = F.schema_of_variant(raw)
    whole = shape.rlike("^(BIGINT|DECIMAL\\(\\d+,0\\))$")
    fits = {"string": shape == "STRING", "bigint": whole, "double": shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), "boolean": shape == "BOOLEAN"}.get(kind, shape == "STRING")
    value = F.when(fits, F.try_variant_get(document, place, kind))
    return value, F.when(raw.isNotNull() & ~F.is_variant_null(raw) & value.isNull(), F.to_json(raw))


def unknown_members(members: Column, known: Sequence[str]) -> Column:
    """Members of a map that the schema doesn't name."""
    return F.map_filter(members, lambda k, _: ~k.isin(list(known)))


def positioned(document: Column, path: str) -> Column:
    """(pos, value, misfit) of a list member; positions keep gaps where an item is no text."""
    items = F.try_variant_get(document, f"$['{path}']", "array<variant>")
    return F.transform(items, lambda v, i: F.struct(i.alias("pos"), F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).alias("value"), F.when(F.schema_of_variant(v) != "STRING", F.to_json(v)).alias("misfit")))


def _escaped(token: Any) -> str:
    return str(token).replace("~", "~0").replace("/", "~1")


def _equal(a: Any, b: Any) -> bool:
    if isinstance(a, bool) is not isinstance(b, bool):
        return False
    number = (int, float)
    return a == b if isinstance(a, number) and isinstance(b, number) else type(a) is type(b) and a == b


def differences(expected: Any, actual: Any, subset: bool = False, at: str = "") -> list[tuple[str, Any, Any]]:
    """(pointer, expected, actual) where two documents differ.

    ``subset``: the actual one may hold more members, and a list's items may come in any order among others.
    """
    if isinstance(expected, Mapping) and isinstance(actual, Mapping):
        out = []
        for key, value in expected.items():
            place = f"{at}/{_escaped(key)}"
            out += differences(value, actual[key], subset, place) if key in actual else [(place, value, None)]
        return out + ([] if subset else [(f"{at}/{_escaped(k)}", None, v) for k, v in actual.items() if k not in expected])
    if isinstance(expected, list) and isinstance(actual, list):
        if not subset:
            out = [(f"{at}/length", len(expected), len(actual))] if len(expected) != len(actual) else []
            return out + [d for i, (e, a) in enumerate(zip(expected, actual)) for d in differences(e, a, False, f"{at}/{i}")]
        free, out = dict(enumerate(actual)), []
        for i, item in enumerate(expected):
            hit = next((j for j, other in free.items() if not differences(item, other, True)), None)
            if hit is not None:
                del free[hit]
            elif free.get(i) is None:
                out.append((f"{at}/{i}", item, None))
            else:
                out += differences(item, free[i], True, f"{at}/{i}")
        return out
    same = not isinstance(expected, (Mapping, list)) and _equal(expected, actual)
    return [] if same else [(at or "/", expected, actual)]


def compare_output(expected: Column, actual: Column, mode: str = "exact") -> Column:
    """Differences of two JSON texts; see :func:`differences`."""

    @by_batch(DIFFERENCE)
    def run(a, b):
        found = differences(json.loads(a or "{}"), json.loads(b or "{}"), mode == "subset")
        return [(p, canonical_dumps(e), canonical_dumps(x)) for p, e, x in found]

    return run(expected, actual)


def changed_members(before: Column, after: Column, secret: str = "(?i)(password|secret|token|api_?key)") -> Column:
    """Top-level members of two maps that differ: before and after, secrets masked."""
    names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    masked = lambda k, v: F.when(v.isNotNull() & k.rlike(secret), F.lit("***")).otherwise(v)
    rows = F.transform(names, lambda k: F.struct(k.alias("name"), masked(k, F.try_element_at(before, k)).alias("before"), masked(k, F.try_element_at(after, k)).alias("after"), (~F.try_element_at(before, k).eqNullSafe(F.try_element_at(after, k))).alias("changed")))
    return F.transform(F.filter(rows, lambda r: r["changed"]), lambda r: r.dropFields("changed"))


def merge_lines(base: Sequence[str], ours: Sequence[str], theirs: Sequence[str]) -> tuple[list[str], int]:
    """Three-way merge of lines and the number of conflicts, which are marked in the result."""
    def kept(other: Sequence[str]) -> dict[int, int]:
        blocks = difflib.SequenceMatcher(None, base, other, autojunk=False).get_matching_blocks()
        return {a + k: b + k for a, b, n in blocks for k in range(n)}

    left, right = kept(ours), kept(theirs)
    out: list[str] = []
    conflicts = b = o = t = 0
    anchors = [i for i in range(len(base)) if i in left and i in right] + [len(base)]
    for i in anchors:
        o_end, t_end = (left[i], right[i]) if i < len(base) else (len(ours), len(theirs))
        if o_end < o or t_end < t:
            continue
        was, mine, yours = list(base[b:i]), list(ours[o:o_end]), list(theirs[t:t_end])
        if mine == yours or yours == was:
            out += mine
        elif mine == was:
            out += yours
        else:
            conflicts += 1
            out += ["<<<<<<< ours", *mine, "=======", *yours, ">>>>>>> theirs"]
        if i < len(base):
            out.append(base[i])
            b, o, t = i + 1, o_end + 1, t_end + 1
    return out, conflicts


def merge3_lines(base: Column, ours: Column, theirs: Column) -> Column:
    """struct<text, conflicts> of three texts."""

    @by_batch("struct<text:string,conflicts:int>")
    def run(a, b, c):
        lines, n = merge_lines((a or "").split("\n"), (b or "").split("\n"), (c or "").split("\n"))
        return ("\n".join(lines), n)

    return run(base, ours, theirs)


_GONE = object()


def merge_documents(base: Any, ours: Any, theirs: Any, at: str = "") -> tuple[Any, list[str]]:
    """Three-way merge of documents and the pointers in conflict, where ours stays."""
    if ours is theirs or type(ours) is type(theirs) and ours == theirs or theirs is base or type(theirs) is type(base) and theirs == base:
        return ours, []
    if ours is base or type(ours) is type(base) and ours == base:
        return theirs, []
    if isinstance(ours, dict) and isinstance(theirs, dict):
        was = base if isinstance(base, dict) else {}
        out, conflicts = {}, []
        for key in [*ours, *(k for k in theirs if k not in ours)]:
            value, found = merge_documents(was.get(key, _GONE), ours.get(key, _GONE), theirs.get(key, _GONE), f"{at}/{_escaped(key)}")
            conflicts += found
            if value is not _GONE:
                out[key] = value
        return out, conflicts
    return ours, [at or "/"]


def merge3_json(base: Column, ours: Column, theirs: Column) -> Column:
    @by_batch("struct<document:string,conflicts:array<string>>")
    def run(a, b, c):
        value, found = merge_documents(json.loads(a), json.loads(b), json.loads(c))
        return (canonical_dumps(value), found)

    return run(base, ours, theirs)


def diff_files(before: Column, after: Column, name: str = "file") -> Column:
    """Unified diff of two texts."""

    @by_batch("string")
    def run(a, b):
        return "".join(difflib.unified_diff((a or "").splitlines(True), (b or "").splitlines(True), f"a/{name}", f"b/{name}"))

    return run(before, after)


def gunzipped(body: Column, most: int = 64 << 20) -> Column:
    """Unpacked bytes of a gzip body, other bodies as they are; null beyond ``most`` bytes or if broken."""

    @by_values("binary")
    def run(raw: bytes | None) -> bytes | None:
        if raw is None or raw[:2] != b"\x1f\x8b":
            return raw
        try:
            out = zlib.decompressobj(wbits=31).decompress(raw, most + 1)
        except zlib.error:
            return None
        return None if len(out) > most else out

    return run(body)


def safe_xml(body: bytes) -> ElementTree.Element | None:
    """Root element; None for broken XML and for any document that declares entities."""
    if re.search(rb"<!(ENTITY|DOCTYPE[^>]*\[)", body, re.I):
        return None
    try:
        return ElementTree.fromstring(body)
    except ElementTree.ParseError:
        return None


def packed(text: str) -> bytes:
    """Gzip without a time, so equal texts give equal bytes."""
    return gzip.compress(text.encode(), mtime=0)


def gzipped(body: Column) -> Column:
    """``body`` packed by :func:`packed`'s rule."""
    return by_values("binary")(lambda b: None if b is None else gzip.compress(b, mtime=0))(body)


def validation_problems(document: Column, required: Mapping[str, str]) -> Column:
    """Pointers of required members that are missing or of another kind (string, number, boolean, object, array)."""
    doc = F.try_parse_json(document)
    kinds = {"string": "^STRING$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "object": "^OBJECT", "array": "^ARRAY"}
    tests = []
    for path, kind in required.items():
        member = F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.split(".")), "variant")
        tests.append(F.when(~F.coalesce(F.schema_of_variant(member).rlike(kinds[kind]), F.lit(False)), F.lit("/" + path.replace(".", "/"))))
    return F.when(doc.isNull(), F.array(F.lit("/"))).otherwise(F.filter(F.array(*tests), lambda x: x.isNotNull()))


def fingerprint(*parts: Column) -> Column:
    """Identity hash of a request."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
