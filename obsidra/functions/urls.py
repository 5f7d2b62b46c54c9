"""URL expressions: native where the engine has the parts, one vectorised function for the full normal form."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote, unquote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default ports, and what paths and queries may hold unescaped.
PORTS = {"http": 80, "https": 443}
PATH_SAFE = "/:@!$&'()*+,;=-._~%"
QUERY_SAFE = "/:@!$'()*+,;-._~"
_ESCAPE = re.compile("%([0-9A-Fa-f]{2})")
_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


@dataclass(frozen=True)
class UrlRules:
    """What a normal form keeps. ``trailing_slash``: keep, add or remove."""

    drop_fragment: bool = True
    lower_host: bool = True
    sort_query: bool = True
    strip_params: tuple[str, ...] = ()
    trailing_slash: str = "keep"


def _folded(path: str) -> str:
    kept: list[str] = []
    parts = path.split("/")
    for part in parts:
        if part == "..":
            kept = kept[:-1] if len(kept) > 1 else kept
        elif part != ".":
            kept.append(part)
    out = "/".join(kept) + ("/" if parts[-1] in (".", "..") else "")
    return out if out[:1] == "/" else "/" + out


def normal_url(url: str | None, rules: UrlRules = UrlRules(), base: str | None = None) -> str | None:
    """The canonical absolute form; None for what is no well-formed http(s) URL."""
    if not url or not url.strip():
        return None
    try:
        parts = urlsplit(urljoin(base, url.strip()) if base else url.strip())
        host, port = parts.hostname, parts.port
        scheme = parts.scheme.lower()
        if scheme not in PORTS or not host:
            return None
        if not rules.lower_host and "[" not in parts.netloc:
            host = parts.netloc.rpartition("@")[2].partition(":")[0]
        if not host.isascii():
            host = host.encode("idna").decode()
    except (ValueError, UnicodeError):
        return None
    place = f"[{host}]" if ":" in host else host
    if port not in (None, PORTS[scheme]):
        place += f":{port}"

    def unescaped(match: re.Match[str]) -> str:
        char = chr(int(match[1], 16))
        return char if char in _PLAIN else match[0].upper()

    path = _folded(quote(_ESCAPE.sub(unescaped, parts.path or "/"), safe=PATH_SAFE))
    tail = path.rpartition("/")[2]
    if rules.trailing_slash == "add" and tail and "." not in tail:
        path += "/"
    if rules.trailing_slash == "remove":
        path = path.rstrip("/") or "/"
    pairs = [p for p in parse_qsl(parts.query, keep_blank_values=True) if not any(fnmatch.fnmatchcase(p[0], g) for g in rules.strip_params)]
    if rules.sort_query:
        pairs.sort()
    query = "&".join(f"{quote(k, safe=QUERY_SAFE)}={quote(v, safe=QUERY_SAFE)}" for k, v in pairs)
    return urlunsplit((scheme, place, path, query, "" if rules.drop_fragment else parts.fragment))


def url_normalize(url: Column, rules: UrlRules = UrlRules(), base: Column | None = None) -> Column:
    @F.pandas_udf("string")
    def run(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([normal_url(u, rules, b) for u, b in zip(urls, bases)])

    return run(url, base if base is not None else F.lit(None).cast("string"))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PATH"))


def query_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"))


def query_param(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def set_query_param(url: Column, name: str, value: Column) -> Column:
    """``url`` with one value of ``name``, in its old place or at the end."""
    bare, tail = F.substring_index(url, "#", 1), F.regexp_extract(url, "(#.*)$", 1)
    encoded = F.concat(F.lit(f"{name}="), F.replace(F.url_encode(value.cast("string")), F.lit("+"), F.lit("%20")))
    pattern = rf"(?<=[?&]){re.escape(name)}=[^&#]*"
    put = F.when(bare.rlike(pattern), F.regexp_replace(bare, F.lit(pattern), F.replace(encoded, F.lit("$"), F.lit("\\$")))).when(F.contains(bare, F.lit("?")), F.concat(bare, F.lit("&"), encoded)).otherwise(F.concat(bare, F.lit("?"), encoded))
    return F.concat(put, tail)


def origin_of(url: Column) -> Column:
    return F.concat(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))))


#: What a variable path segment looks like, and an extension.
NUMBER_SEGMENT = r"^\d+$"
HASH_SEGMENT = r"(?i)^[0-9a-f]{8,}$"
SLUG_SEGMENT = r"(?i)^[a-z0-9]+(?:[-_][a-z0-9]+)+$"
ID_SEGMENT = r"(?i)^[a-z]{1,4}\d{3,}$"
EXTENSION = r"(?i)^(.+)\.([a-z0-9]{1,5})$"


def segment_shape(segment: Column) -> Column:
    """``*`` for a number, hash, slug or prefixed id, else the segment in lower case; an extension stays."""
    has = segment.rlike(EXTENSION)
    stem = F.when(has, F.regexp_extract(segment, EXTENSION, 1)).otherwise(segment)
    extension = F.when(has, F.concat(F.lit("."), F.lower(F.regexp_extract(segment, EXTENSION, 2)))).otherwise(F.lit(""))
    variable = stem.rlike(NUMBER_SEGMENT) | stem.rlike(HASH_SEGMENT) | stem.rlike(SLUG_SEGMENT) | stem.rlike(ID_SEGMENT)
    return F.concat(F.when(variable, F.lit("*")).otherwise(F.lower(stem)), extension)


def _segments(url: Column) -> Column:
    return F.filter(F.split(F.coalesce(path_of(url), F.lit("")), "/"), lambda s: s != "")


def url_shape(url: Column) -> Column:
    """Structure of a URL: host, shapes of its segments (``*=*`` for ``key=value``), ``?q`` for any query."""
    shapes = F.transform(_segments(url), lambda s: F.when(F.contains(s, F.lit("=")), F.lit("*=*")).otherwise(segment_shape(s)))
    return F.concat(F.coalesce(host_of(url), F.lit("")), F.lit("/"), F.array_join(shapes, "/"), F.when(query_of(url).isNotNull() & (query_of(url) != ""), F.lit("?q")).otherwise(F.lit("")))


def channel_shape(text: Column) -> Column:
    """Messages are told apart by length."""
    return F.concat(F.lit("telegram/"), F.least(F.floor(F.length(F.coalesce(text, F.lit(""))) / 500), F.lit(4)).cast("string"))


def link_pattern(url: Column) -> Column:
    """As :func:`url_shape`, but the keys of ``key=value`` segments and of the query stay."""
    keyed = lambda s: F.array_join(F.transform(F.filter(F.split(s, ";"), lambda p: p != ""), lambda p: F.concat(F.substring_index(p, "=", 1), F.lit("=*"))), ";")
    shapes = F.transform(_segments(url), lambda s: F.when(F.contains(s, F.lit("=")), keyed(s)).otherwise(segment_shape(s)))
    keys = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query_of(url), "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))))
    query = F.when(F.coalesce(query_of(url), F.lit("")) != "", F.concat(F.lit("?"), F.array_join(F.transform(keys, lambda k: F.concat(k, F.lit("=*"))), "&"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(host_of(url), F.lit("")), F.lit("/"), F.array_join(shapes, "/"), query)


def same_url(a: Column, b: Column) -> Column:
    """Equal but for host case, fragment, default port and a final slash."""

    def plain(u: Column) -> Column:
        bare = F.substring_index(u, "#", 1)
        host = F.lower(F.regexp_extract(bare, r"(?i)^(https?://[^/?]*)", 1))
        rest = F.regexp_replace(F.regexp_replace(bare, r"(?i)^https?://[^/?]*", ""), r"/(?=$|\?)", "")
        return F.concat(F.regexp_replace(F.regexp_replace(host, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1"), rest)

    return plain(a) == plain(b)


def expand_template(template: str, values: dict[str, Column]) -> Column:
    """Level-1 URI template; a space becomes %20."""
    pieces = re.split(r"\{([A-Za-z_][A-Za-z0-9_]*)\}", template)
    parts = [F.replace(F.url_encode(values[p].cast("string")), F.lit("+"), F.lit("%20")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)]
    return F.concat(*parts)


def content_kind(media_type: Column, url: Column) -> Column:
    xml = F.endswith(media_type, F.lit("xml")) | media_type.isin("application/gzip", "application/x-gzip")
    return (
        F.when(media_type.isin("text/html", "application/xhtml+xml"), "page")
        .when(media_type.isin("application/rss+xml", "application/atom+xml"), "feed")
        .when(F.contains(F.lower(url), F.lit("sitemap")) & xml, "sitemap")
        .when((media_type == "application/json") | F.endswith(media_type, F.lit("+json")), "json")
        .otherwise("file")
    )


def decoded_path(url: str) -> str:
    """Path and query as robots rules see them."""
    parts = urlsplit(url)
    return unquote(parts.path or "/") + (f"?{parts.query}" if parts.query else "")
