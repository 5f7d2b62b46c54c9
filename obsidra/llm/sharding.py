"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order of a 64-bit hash of (id, size, crc32, text hash); the number does not depend on
how the input is partitioned. A keyed Feistel network over the smallest even-width power of two that holds N permutes
the numbers; a value that falls outside 0..N-1 is fed back until it lies inside (cycle walking), so the result is a
permutation of 0..N-1 that anyone can compute from (row number, N, seed). ``shard = p % shards`` and
``slot = p // shards``: shard sizes differ by one row at most and slots have no gaps.

Defined cases: a null text has size 1 and crc32 of the empty string, as the empty text has; rows that repeat in all
four keys take consecutive numbers, one each; null ids are ordinary keys; an empty table gives an empty result.
Text never enters a shuffle, only its digests; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed

ROUNDS = 6
#: Rows of a hash range: one window each.
RANGE_ROWS = 1 << 16


def feistel(numbers: np.ndarray, total: np.ndarray, seed: int) -> np.ndarray:
    """Permuted ``numbers`` in 0..total-1; ``total`` is the same for all of them."""
    out = numbers.astype(np.uint64)
    if not len(out):
        return out.astype(np.int64)
    n = int(total[0])
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = mixed(np.uint64(seed & (2**64 - 1)) + np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right ^ key) & mask)
        out[todo] = walked = (left << shift) | right
        todo = todo[walked >= np.uint64(n)]
    return out.astype(np.int64)


def shard(docs: DataFrame, shards: int = 16, seed: int = 20240229, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, row_number, position, shard, slot.

    ``bits``: log2 of the hash ranges that are numbered on their own, by default as many as give RANGE_ROWS rows each; the
    numbers do not depend on it.
    """
    if bits is None:
        bits = min(20, max(10, (docs.count() // RANGE_ROWS).bit_length()))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(F.col(id_col), text).alias("h"),
    )
    # rows that agree in every key are counted before the shuffle, so that a hot row is one record per task
    groups = keyed.groupBy("h", "id", "size", "crc").agg(F.count(F.lit(1)).alias("copies")).withColumn("range", F.shiftright("h", 64 - bits))
    # at most 2**bits rows: the only ones that meet in one task
    sizes = groups.groupBy("range").agg(F.sum("copies").alias("rows"))
    starts = sizes.select(
        "range",
        (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("before"),
        F.sum("rows").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    order = Window.partitionBy("range").orderBy("h", F.col("id").asc_nulls_first(), "size", "crc")
    numbered = (
        groups.withColumn("inside", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies"))
        .join(F.broadcast(starts), "range")
        .withColumn("first", F.col("before") + F.col("inside"))
        .withColumn("row_number", F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)))
    )

    @F.pandas_udf("long")
    def permuted(number: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(feistel(number.to_numpy(), total.to_numpy(), seed))

    return numbered.withColumn("position", permuted("row_number", "total")).select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        "row_number",
        "position",
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("position") / F.lit(shards)).cast("long").alias("slot"),
    )
