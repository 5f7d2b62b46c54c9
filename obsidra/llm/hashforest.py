"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Vectors are lifted by one component, sqrt(M^2 - |x|^2) with M the largest norm, which turns inner products into angles.
Each tree hashes a vector to a string of sign bits of random projections and keeps its rows sorted by string. A query
descends every tree to its longest-prefix match (two binary searches) and ascends all trees synchronously, one bit at a
time, taking the rows under each prefix until it holds enough distinct candidates; those are scored exactly.

Rows are dealt to shards of bounded size by hash of the id, each shard with a forest of its own that up to
``BLOCK_QUERIES`` queries pass in steps (more queries come in several blocks; few shards are shared by as many blocks as there
are cores); the shards' best are merged. Every row is indexed; ``share`` of a shard's rows is what a query looks at.
On vectors without structure (independent components) no hash finds neighbours in far fewer: the README gives recall
and share as measured.

Defined cases: null or zero vectors, or ones with null or non-finite components, or a null id, take no part; a query
doesn't find its own id; ties go to the smaller id; fewer candidates than k give fewer rows; vectors meet those of their
own length only; rows that repeat id and vector are one candidate, a repeated query is one query; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .rangejoin import matrix, usable

TREES, BITS, SHARD_ROWS, BLOCK_QUERIES = 48, 24, 16384, 65536
#: Queries that descend at once.
STEP_QUERIES = 512
#: Rows of a shard that a query scores, as a share.
SHARE = 0.55
SEED = 20240229


def signatures(x: np.ndarray, lift: np.ndarray, trees: int = TREES, bits: int = BITS) -> np.ndarray:
    """(rows, trees) strings of ``bits`` sign bits, the first bit highest."""
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1] + 1, trees * bits))
    out = np.empty((len(x), trees), np.int64)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for at in range(0, len(x), 2048):
        signs = (x[at : at + 2048] @ planes[:-1] + lift[at : at + 2048, None] * planes[-1]) > 0
        out[at : at + 2048] = signs.reshape(-1, trees, bits) @ weights
    return out


class Forest:
    def __init__(self, x: np.ndarray, lift: np.ndarray) -> None:
        self.rows = len(x)
        sig = signatures(x, lift)
        self.order = np.argsort(sig, axis=0, kind="stable")
        self.sorted = np.take_along_axis(sig, self.order, 0)

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query its candidate rows: all trees ascend together until there are ``enough``."""
        for at in range(0, len(queries), STEP_QUERIES):
            yield from self._ascend(queries[at : at + STEP_QUERIES], enough)

    def _ascend(self, queries: np.ndarray, enough: int):
        sig = signatures(queries, np.zeros(len(queries)))
        low = np.empty((BITS + 1, TREES, len(queries)), np.int64)
        high = np.empty_like(low)
        for depth in range(BITS + 1):
            rest = (1 << (BITS - depth)) - 1
            for t in range(TREES):
                low[depth, t] = np.searchsorted(self.sorted[:, t], sig[:, t] & ~rest, "left")
                high[depth, t] = np.searchsorted(self.sorted[:, t], sig[:, t] | rest, "right")
        total = (high - low).sum(1)
        for q in range(len(queries)):
            seen = np.zeros(self.rows, bool)
            # the deepest level whose matches could be enough: above it the union can't be
            depth = int(np.flatnonzero(total[:, q] >= enough).max(initial=0))
            done = False
            while not done:
                for t in range(TREES):
                    seen[self.order[low[depth, t, q] : high[depth, t, q], t]] = True
                    if t % 8 == 7 and np.count_nonzero(seen) >= enough:
                        done = True
                        break
                done |= depth == 0
                depth -= 1
            yield np.flatnonzero(seen)


def best(x: np.ndarray, ids: np.ndarray, found: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k candidates with the largest inner product (ids, scores), ties to the smaller id."""
    found = found[ids[found] != own]
    if not len(found):
        return ids[:0], np.zeros(0)
    score = x[found] @ query
    if len(found) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        found = found[score >= least - 1e-9 * max(1.0, abs(least))]
    exact = (x[found] * query).sum(1)  # one order of addition for every row: equal vectors score equally
    order = np.lexsort((ids[found], -exact))[:k]
    return ids[found][order], exact[order]


def search(vectors: DataFrame, is_query: Column, k: int = 20, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of each row for which ``is_query`` holds."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), is_query.alias("q"))
    some = staged(rows.where(f"id is not null and {usable('v')}").withColumn("dim", F.size("v")), "search", small=True)
    stats = some.agg(F.count(F.lit(1)).alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + cast(x as double) * cast(x as double))")).alias("m"), F.count(F.when(F.col("q"), 1)).alias("q")).first()
    shards = max(1, -(-stats["n"] // SHARD_ROWS))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-stats["q"] // BLOCK_QUERIES), min(-(-stats["q"] // STEP_QUERIES), -(-2 * cores // shards)))
    norm = float(stats["m"] or 0.0)
    index = some.select("dim", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "id", "v")
    asked = some.where("q").select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "id", "v")

    def found(key, table):
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, x = table.column("id").to_numpy(), matrix(table.column("v"))
        queries, q_ids = x[asks], ids[asks]
        x, ids = x[~asks], ids[~asks]
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(ids):
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            lift = np.sqrt(np.maximum(0.0, norm - (x * x).sum(1)))
            enough = max(20 * k, int(np.ceil(share * len(ids))))
            for at, (own, query) in zip(Forest(x, lift).candidates(queries, enough), zip(q_ids, queries)):
                got, score = best(x, ids, at, query, own, k)
                out.append((np.full(len(got), own), got, score))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, (np.int64, np.int64, np.float64)[i]) for i in range(3)]
        return pa.table({"query_id": pa.array(cols[0]), "id": pa.array(cols[1]), "score": pa.array(cols[2])})

    merged = index.unionByName(asked).groupBy("dim", "shard", "block").applyInArrow(found, "query_id long, id long, score double").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
