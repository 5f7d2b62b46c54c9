"""Text expressions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import by_batch, by_values

#: Latin letters for Cyrillic ones (Ukrainian and Russian).
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "h", "ґ": "g", "д": "d", "е": "e", "є": "ie", "ё": "e", "ж": "zh", "з": "z", "и": "y", "і": "i", "ї": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia", "'": "", "’": "",
}


def norm_name(name: Column) -> Column:
    """Lower case, one kind of apostrophe, no quotes, single spaces, no punctuation at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[«»“”„\"]", ""), "[’ʼ`´‘]", "'")
    return F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+", " "), r"(?U)^[\s.,;:!?()\-–—]+|[\s.,;:!?()\-–—]+$", "")


def slug(text: Column, words: int | None = None) -> Column:
    """ASCII slug of Latin and Cyrillic text, of at most ``words`` words."""
    latin = F.lower(text)
    for letter in [k for k, v in LATIN.items() if len(v) > 1]:
        latin = F.replace(latin, F.lit(letter), F.lit(LATIN[letter]))
    ones = {k: v for k, v in LATIN.items() if len(v) == 1}
    latin = F.translate(latin, "".join(ones) + "".join(k for k, v in LATIN.items() if not v), "".join(ones.values()))
    parts = F.filter(F.split(latin, "[^a-z0-9]+"), lambda p: p != "")
    return F.array_join(F.slice(parts, 1, words) if words else parts, "-")


def actor_slug(name: Column, aliases: dict[str, str], countries: dict[str, str]) -> Column:
    """Id of an actor: a known alias, a country's code, else a slug of four words."""
    plain = norm_name(name)
    known = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[plain] if table else F.lit(None).cast("string")
    return F.coalesce(known(aliases), known(countries), F.nullif(slug(plain, 4), F.lit("")))


def country_code(text: Column, names: dict[str, str]) -> Column:
    """Two-letter code, or the code of a known name."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.when(F.trim(text).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(text))).otherwise(table[norm_name(text)])


def valid_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))


def clean(text: Column) -> Column:
    """Entities resolved, compatibility forms unified, single spaces, none before punctuation."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else re.sub(r" ([,.;:!?])", r"\1", re.sub(r"\s+", " ", unicodedata.normalize("NFKC", html.unescape(t)))).strip())

    return run(text)


def canonical(text: Column) -> Column:
    """Caseless words joined by one space, for comparing."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else re.sub(r"[\W_]+", " ", unicodedata.normalize("NFKC", html.unescape(t)).casefold()).strip())

    return run(text)


def truncate(text: Column, most: int) -> Column:
    rest = (F.length(text) - most).cast("string")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), F.lit("\n[... truncated "), rest, F.lit(" characters]")))


def decode_text(raw: Column, charset: Column) -> Column:
    """Bytes in their charset; unknown charsets and broken bytes fall back to UTF-8 with replacement."""

    @by_values("string")
    def run(body: bytes | None, name: str | None) -> str | None:
        if body is None:
            return None
        try:
            return body.decode(name or "utf-8")
        except (UnicodeDecodeError, LookupError):
            return body.decode("utf-8", "replace")

    return run(raw, charset)


def strip_fences(text: Column) -> Column:
    """The content of a fenced block that makes up the text, else the text."""
    inner = F.regexp_extract(text, r"(?s)^\s*```[A-Za-z]*\s*\n(.*?)\n?\s*```\s*$", 1)
    return F.when(text.rlike(r"(?s)^\s*```[A-Za-z]*\s*\n.*```\s*$"), inner).otherwise(F.trim(text))


def neutralise(text: Column, tag: str = "data") -> Column:
    """Marks of a data block inside the data lose their brackets."""
    return F.regexp_replace(text, rf"(?i)<(/?\s*{re.escape(tag)}\b)", "&lt;$1")


def render_template(template: Column, values: Column) -> Column:
    """``{{path}}`` filled from a map of strings; what is unknown stays empty."""

    @by_batch("string")
    def run(text, given):
        return None if text is None else re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: (given or {}).get(m[1], ""), text)

    return run(template, values)


def number_from_text(text: Column) -> Column:
    """The first number of a text: spaces group digits, a comma may be the decimal sign."""
    digits = F.regexp_replace(F.regexp_extract(text, "-?\\d[\\d\\s  .,]*", 0), "[\\s  ]", "")
    plain = F.when(digits.rlike(r"^-?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(digits, F.lit(","), F.lit(""))).when(digits.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
    return F.regexp_replace(plain.otherwise(F.replace(digits, F.lit(","), F.lit("."))), r"\.$", "").try_cast("double")


def quantity(text: Column, units: dict[str, float]) -> Column:
    """Number with a unit, in the unit of factor 1; null without a known unit."""
    pattern = r"(?iU)(\d+(?:[.,]\d+)?)\s*(" + "|".join(re.escape(u) for u in sorted(units, key=len, reverse=True)) + r")\b"
    factor = F.create_map(*[F.lit(x) for kv in units.items() for x in kv])[F.lower(F.regexp_extract(text, pattern, 2))]
    return F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double") * factor


def make_model(title: Column, slug_: Column) -> Column:
    """(make, model) of a title whose make is the start of the URL slug."""

    @by_batch("struct<make:string,model:string>")
    def run(text, name):
        words, parts = (text or "").split(), (name or "").lower().split("-")
        n = 0
        while n < len(words) and n < len(parts) and words[n].lower() == parts[n] and n < 1 + parts[:-1].count(""):
            n += 1
        n = max(n, 1)
        return (" ".join(words[:n]) or None, " ".join(words[n:]) or None)

    return run(title, slug_)


def redact(text: Column, secrets: Sequence[str]) -> Column:
    """Secrets replaced, the longest first."""
    out = text
    for secret in sorted({s for s in secrets if s}, key=lambda s: (-len(s), s)):
        out = F.replace(out, F.lit(secret), F.lit("***"))
    return out


def pointer_escape(token: Column) -> Column:
    return F.replace(F.replace(token, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def search_score(query: Column, text: Column) -> Column:
    """Share of the query's words that the text holds; 0 for an empty query."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\W+"), lambda w: w != ""))
    wanted = words(query)
    return F.when(F.size(wanted) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(wanted, words(text))) / F.size(wanted))
