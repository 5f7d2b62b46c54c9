"""Fan-out of materials and results over the stages of a task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .predicates import Fields, Resolver, bindings, condition


def stage_order(stages: Sequence[Mapping[str, Any]]) -> list[str] | None:
    """Stages in dependency order, equal ones as written; None for a cycle."""
    waiting = {s["stage_id"]: {e["from"] for e in s.get("inputs") or []} for s in stages}
    out: list[str] = []
    while waiting:
        ready = [s for s, needs in waiting.items() if not needs & waiting.keys()]
        if not ready:
            return None
        out.append(ready[0])
        del waiting[ready[0]]
    return out


def route_materials(materials: DataFrame, stages: Sequence[Mapping[str, Any]], collect: str, resolver: Resolver, fields: Fields, task_source: str, forward_unknown: bool) -> DataFrame:
    """One row per (material, stage): all columns, stage_id and item_key; materials that no stage takes get none.

    A material is unknown when some stage has bindings and none of them matches; it goes to the consumers of
    ``unmatched_materials`` if forwarding is on. Rules are one expression, so a material is read once.
    """
    bound = [s for s in stages if s.get("bindings")]
    known = F.lit(False)
    for s in bound:
        known = known | bindings(s["bindings"], resolver, task_source)
    unknown = ~known if bound else F.lit(False)
    hits = []
    for s in stages:
        if s.get("kind", "handler") != "handler":
            continue
        takes = F.lit(False)
        for edge in s.get("inputs") or []:
            if edge["from"] != collect or edge.get("select", "output") not in ("output", "unmatched_materials"):
                continue
            if edge.get("select", "output") == "output":
                fits = bindings(s.get("bindings"), resolver, task_source)
            else:
                fits = unknown & F.lit(forward_unknown)
            takes = takes | fits & condition(edge.get("when"), fields)
        hits.append(F.when(takes, F.lit(s["stage_id"])))
    staged = materials.withColumn("__stages", F.filter(F.array(*hits), lambda x: x.isNotNull())).withColumn("unknown", unknown)
    return staged.withColumn("stage_id", F.explode("__stages")).drop("__stages")


def unknown_materials(materials: DataFrame, stages: Sequence[Mapping[str, Any]], resolver: Resolver, task_source: str) -> DataFrame:
    """Materials that no binding matches."""
    bound = [s for s in stages if s.get("bindings")]
    out = materials if bound else materials.limit(0)
    for s in bound:
        out = out.where(~bindings(s["bindings"], resolver, task_source))
    return out


def route_results(results: DataFrame, edges: Sequence[Mapping[str, Any]], fields: Fields, item: str = "item_key", status: str = "status") -> DataFrame:
    """Items of the stages behind a result: by select (output, input_material, problems) and condition.

    Columns: those of ``results`` and stage_id, select, next_key (<item>#<stage>#<edge>), equal on every replay.
    """
    hits = []
    for number, edge in enumerate(edges):
        select = edge.get("select", "output")
        fits = {"output": F.col(status) == "success", "problems": F.col(status).isin("failed", "unrecognized"), "input_material": F.lit(True)}[select]
        made = F.struct(F.lit(edge["to"]).alias("stage_id"), F.lit(select).alias("select"), F.concat_ws("#", F.col(item), F.lit(edge["to"]), F.lit(str(number))).alias("next_key"))
        hits.append(F.when(fits & condition(edge.get("when"), fields), made))
    return results.withColumn("__e", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select("*", "__e.*").drop("__e")
