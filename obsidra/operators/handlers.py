"""Handlers over materials: a callable per row with captured errors, statuses and schema checks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.documents import validation_problems


@dataclass
class Entity:
    entity_type: str
    key: dict[str, Any]
    fields: dict[str, Any]
    completeness: str = "full"


@dataclass
class Result:
    """What a handler returns: success with entities, empty, or unrecognized with a signature."""

    status: str = "success"
    entities: list[Entity] = field(default_factory=list)
    signature: str | None = None
    diagnostics: list[str] = field(default_factory=list)


def success(*entities: Entity, diagnostics: list[str] | None = None) -> Result:
    return Result("success" if entities else "empty", list(entities), None, diagnostics or [])


def unrecognized(signature: str) -> Result:
    return Result("unrecognized", [], signature)


SCHEMA = "material_id string, status string, entities array<struct<entity_type:string,key:string,fields:string,completeness:string>>, signature string, diagnostics array<string>, error string"


def run_handler(materials: DataFrame, handler: Callable[[str, str, dict[str, Any]], Result], params: dict[str, Any] | None = None) -> DataFrame:
    """``handler(url, content, params)`` for every material (material_id, url, content); an error is a failed row."""
    given = params or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for m, url, content in zip(batch["material_id"], batch["url"], batch["content"]):
                try:
                    r = handler(url, content, given)
                    made = [{"entity_type": e.entity_type, "key": json.dumps(e.key, sort_keys=True, ensure_ascii=False), "fields": json.dumps(e.fields, sort_keys=True, ensure_ascii=False), "completeness": e.completeness} for e in r.entities]
                    rows.append((m, r.status, made, r.signature, r.diagnostics, None))
                except Exception as error:  # the row's outcome, not ours
                    rows.append((m, "failed", [], None, [], f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["material_id", "status", "entities", "signature", "diagnostics", "error"])

    return materials.select("material_id", "url", "content").mapInPandas(run, SCHEMA)


def checked(results: DataFrame, required: dict[str, dict[str, str]]) -> DataFrame:
    """``results`` with ``problems`` of their entities by the schema of their type ({type: {member: kind}}); a success with
    problems becomes ``invalid``. A type without a schema is a problem of its own."""
    def problems(e):
        found = F.when(~e["entity_type"].isin(list(required)), F.array(F.concat(F.lit("unknown type "), e["entity_type"])))
        for kind, members in required.items():
            found = found.when(e["entity_type"] == kind, validation_problems(e["fields"], members))
        return found

    out = results.withColumn("problems", F.flatten(F.transform("entities", problems)))
    return out.withColumn("status", F.when((F.col("status") == "success") & (F.size("problems") > 0), "invalid").otherwise(F.col("status")))


def entities_of(results: DataFrame) -> DataFrame:
    """One row per entity, with its position for delivery keys."""
    return results.where("status = 'success'").select("material_id", F.posexplode("entities").alias("position", "e")).select("material_id", "position", "e.*")


def scripted_model(prompt: str, rules: dict[str, str], default: str = "{}") -> str:
    """Stand-in for a language model in tests: the answer of the first rule whose text stands in the prompt."""
    return next((answer for text, answer in rules.items() if text in prompt), default)
