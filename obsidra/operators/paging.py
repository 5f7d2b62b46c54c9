"""Keyset pages: opaque cursors, clamped limits, stable orders."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def encode_cursor(values: Sequence[Any]) -> str:
    return base64.urlsafe_b64encode(json.dumps(list(values), separators=(",", ":"), default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> list[Any]:
    try:
        out = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError as error:
        raise ValueError("malformed cursor") from error
    if not isinstance(out, list):
        raise ValueError("malformed cursor")
    return out


def clamp_limit(limit: int | None, default: int = 100, most: int = 1000) -> int:
    return max(1, min(limit if limit is not None else default, most))


def after(order: Sequence[tuple[str, bool]], values: Sequence[Any]) -> Column:
    """Rows beyond a position; ``order``: (column, descending). The leading comparison alone can be pushed down."""
    out = F.lit(False)
    equal = F.lit(True)
    for (name, descending), value in zip(order, values):
        at = F.lit(value)
        out = out | equal & ((F.col(name) < at) if descending else (F.col(name) > at))
        equal = equal & (F.col(name) == at)
    name, descending = order[0]
    return ((F.col(name) <= F.lit(values[0])) if descending else (F.col(name) >= F.lit(values[0]))) & out


def page(rows: DataFrame, order: Sequence[tuple[str, bool]], limit: int, cursor: str | None = None) -> DataFrame:
    """One page of ``rows``: a top-k, no full sort. Ask for limit + 1 to know whether more follow."""
    if cursor:
        rows = rows.where(after(order, decode_cursor(cursor)))
    return rows.orderBy(*[F.desc(n) if d else F.asc(n) for n, d in order]).limit(limit)


def search_entities(entities: DataFrame, text: str) -> DataFrame:
    """Case-insensitive substring of key and fields."""
    return entities.where(F.contains(F.lower(F.concat_ws(" ", "canonical_key", F.to_json("key"), F.to_json("fields"))), F.lit(text.lower())))
