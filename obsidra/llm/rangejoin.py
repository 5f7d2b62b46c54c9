"""Embedding near-dedup: an exact metric range join with pivots.

On unit vectors, cosine >= s is distance <= r = sqrt(2 - 2 s), a metric. A bounded sample gives pivots; each vector's
home is the cell of its nearest pivot. A vector x with a partner in cell j obeys the triangle inequality
d(x, p_j) - d(x, p_home) <= 2 r, and lies within r of the plane between both pivots; it visits every cell for which both
hold. All partners of a vector are then in its home cell, at home or visiting, so cells join on their own and each
link is counted once from each end. Cells are cut into blocks of bounded size, so no task grows with a cell; each pair of
blocks gives counts and a spanning forest of its links, at most a row per vector, whatever the number of links.

Only vectors of equal, non-null label meet. Equal vectors of one label count as one, with their number, before the join.

Defined cases: null or zero vectors, or ones with null or non-finite components, and rows with a null id or label link
with nothing (n_links 0, component_id their own id); rows that repeat an id are vectors of their own; vectors of different
length never link; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

#: Vectors of a cell aimed at, pivots at most, and vectors of a block.
CELL_ROWS, MOST_PIVOTS, BLOCK_ROWS = 4096, 1024, 4096
#: Slack for rounding when cells are chosen; links themselves are tested exactly.
SLACK = 1e-9


def usable(vector: str) -> str:
    """SQL: the vector takes part."""
    finite = "x is not null and not isnan(cast(x as double)) and abs(cast(x as double)) < double('Infinity')"
    return f"({vector} is not null and size({vector}) > 0 and forall({vector}, x -> {finite}) and exists({vector}, x -> x != 0))"


def matrix(column) -> np.ndarray:
    """Rows of equal length of a list column, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # keeps very large and very small vectors in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cells_of(u: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell of each vector, vector x cell: present at home or visiting)."""
    square = np.maximum(0.0, 2 - 2 * (u @ pivots.T))
    home = square.argmin(1)
    near = np.sqrt(square)
    own = square[np.arange(len(u)), home]
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (pivots @ pivots.T)))[home]
    triangle = near - np.sqrt(own)[:, None] <= 2 * radius + SLACK
    plane = square - own[:, None] <= 2 * (radius + SLACK) * apart + SLACK
    there = triangle & plane
    there[np.arange(len(u)), home] = True
    return home, there


def block_links(a: np.ndarray, b: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, copies: np.ndarray, similarity: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each a into b (with copies, itself left out), and edges that connect all linked ids."""
    count = np.zeros(len(a), np.int64)
    label = np.arange(len(b))
    touched = np.zeros(len(b), bool)
    edges: list[tuple[int, int]] = []
    for at in range(0, len(a), 512):
        linked = a[at : at + 512] @ b.T >= similarity
        linked &= a_ids[at : at + 512, None] != b_ids[None, :]
        count[at : at + 512] = linked @ copies
        for i in np.flatnonzero(linked.any(1)):
            found = np.flatnonzero(linked[i])
            touched[found] = True
            labels = np.unique(label[found])
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
            edges.append((int(a_ids[at + i]), int(b_ids[labels[0]])))
    for j in np.flatnonzero(touched & (label != np.arange(len(b)))):
        edges.append((int(b_ids[j]), int(b_ids[label[j]])))
    return count, edges


def near_vectors(vectors: DataFrame, similarity: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    takes_part = f"id is not null and label is not null and {usable('v')}"
    # vectors are compared by digests of their digits: they are carried once, and are no keys
    keyed = rows.withColumn("digest", F.when(F.expr(takes_part), F.sha2(F.expr("concat_ws(',', transform(v, x -> cast(cast(x as double) + 0D as string)))"), 256)))
    some = keyed.where(takes_part)
    # a node number of its own for each different vector, fixed by writing it: ids may repeat
    reps = staged(some.groupBy("label", "digest").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")).withColumn("node", F.monotonically_increasing_id()), "vectors", small=True).withColumn("dim", F.size("v"))
    largest = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    k = min(MOST_PIVOTS, max(1, largest // CELL_ROWS))
    # a bounded sample: the k vectors of the most frequent length with the smallest hash
    dim = (reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first() or [0])[0]
    sample = reps.where(F.col("dim") == dim).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(k).toArrow().column("v")
    pivots = unit(matrix(sample)) if len(sample) else np.zeros((0, 1))
    radius = float(np.sqrt(max(0.0, 2 - 2 * similarity)))

    @F.pandas_udf("struct<home:int,visits:array<int>>")
    def placed(v: pd.Series) -> pd.DataFrame:
        homes, visits = np.zeros(len(v), np.int64), [np.zeros(0, np.int32)] * len(v)
        lengths = v.map(len).to_numpy()
        fit = np.flatnonzero(lengths == dim)
        for at in range(0, len(fit), 1024):
            part = fit[at : at + 1024]
            home, there = cells_of(unit(np.stack(v.iloc[part].to_numpy()).astype(np.float64)), pivots, radius)
            homes[part] = home
            for i, row in zip(part, there):
                visits[i] = np.flatnonzero(row).astype(np.int32)
        for i in np.flatnonzero(lengths != dim):
            visits[i] = np.zeros(1, np.int32)  # other lengths have one cell
        return pd.DataFrame({"home": homes.astype(np.int32), "visits": visits})

    cells = staged(reps.withColumn("p", placed("v")).select("label", "dim", F.col("node").alias("id"), "v", "copies", F.col("p.home").alias("home"), F.explode("p.visits").alias("cell")), "cells", small=True)
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.count(F.when(F.col("home") == F.col("cell"), 1)) / BLOCK_ROWS).cast("int").alias("homes"))
    sized = cells.join(sizes, key).where("homes > 0")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    home = sized.where("home = cell").select(*key, part("homes").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("b"), F.lit(True).alias("is_home"), "id", "copies", "v")
    all_ = sized.select(*key, F.explode(F.sequence(F.lit(0), F.col("homes") - 1)).alias("a"), part("parts").alias("b"), F.lit(False).alias("is_home"), "id", "copies", "v")

    def joined(group, table):
        mask = table.column("is_home").to_numpy(zero_copy_only=False)
        ids, copies = table.column("id").to_numpy(), table.column("copies").to_numpy()
        u = unit(matrix(table.column("v")))
        count, edges = block_links(u[mask], u[~mask], ids[mask], ids[~mask], copies[~mask], similarity)
        hit = np.flatnonzero(count)
        own = ids[mask][hit]
        return pa.table(
            {
                "id": pa.array(np.concatenate([own, np.array([e[0] for e in edges], np.int64)])),
                "other": pa.concat_arrays([pa.nulls(len(own), pa.int64()), pa.array([e[1] for e in edges], pa.int64())]),
                "links": pa.concat_arrays([pa.array(count[hit]), pa.nulls(len(edges), pa.int64())]),
            }
        )

    found = staged(home.unionByName(all_).groupBy(*key, "a", "b").applyInArrow(joined, "id long, other long, links long"), "links", small=True)
    counts = found.where("links is not null").groupBy("id").agg(F.sum("links").alias("links")).select(F.col("id").alias("n1"), "links")
    parts = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("n2"), "component")
    known = (
        reps.select("label", "digest", "id", "node", "copies")
        .join(counts, F.col("node") == F.col("n1"), "left")
        .join(parts, F.col("node") == F.col("n2"), "left")
        .withColumn("component", F.coalesce("component", "node"))
        .withColumn("n", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    )
    least = known.groupBy("component").agg(F.min("id").alias("c"))
    linked = known.select("label", "digest", "n", "component").join(least, "component").drop("component")
    out = keyed.select("id", "label", "digest").join(linked, ["label", "digest"], "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
