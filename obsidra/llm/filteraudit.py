"""Filter interaction audit: inclusion-exclusion over the joint failures of all subsets of filters.

Every document fails some of the filters. One aggregate per part counts, for each of the 2**n subsets of filters, the
documents that fail all of its members: the sum of the product of the members' flags, ``joint[S]``. Nothing else of the
documents is needed any more:

* survivors of the filters in S: ``kept[S] = sum over R in S of (-1)**|R| * joint[R]`` (Moebius inversion);
* a filter f after the set P: it removes ``kept[P] - kept[P + f]``, and ``joint[f]`` less that is redundant;
* failures of f only: ``sum over S with f of (-1)**(|S| - 1) * joint[S]``;
* the game "documents removed by the filters in S" has the Harsanyi dividends ``(-1)**(|S| + 1) * joint[S]``; a filter's
  Shapley value is its share of the dividends, 1/|S| of each. Summed over all n! orders it is a whole number.

Defined cases: a null text is the empty text; a null source is the part ''; a document without label is neither good nor
toxic, of several labels for an id one with 1 decides; of rows with equal text those with the smallest doc_id (all of
them, if the id repeats) don't fail as copies, all others do, and rows without an id come after those with one; empty
tables give an empty result; extra columns are ignored.

Copies: a text is its SHA-256. Rows are counted by (digest, part, flags, labels) with their least id before the shuffle,
so that a text with a third of all rows is one record per task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = "[^\\x20\\x09-\\x0D]+"
#: Most filters audited at once: 2**n aggregates and n! orders.
MOST_FILTERS = 6


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides alone (``text`` is not null)."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.char_length(text) * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def with_copies(rows: DataFrame, keys: Sequence[str], digest: str, id_col: str) -> DataFrame:
    """``rows`` counted by ``keys``, ``digest`` and ``copy``: whether an equal digest stands under a smaller id."""
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    same = rows.groupBy(id_col, digest, *keys).agg(F.count(F.lit(1)).alias("n"))
    cells = same.groupBy(digest, *keys).agg(F.sum("n").alias("rows"), F.min(F.struct(order.alias("order"), F.col("n"))).alias("least"))
    # a digest has no more cells than there are combinations of keys, however many rows it has
    first = F.min("least.order").over(Window.partitionBy(digest))
    original = F.when(F.col("least.order.none"), F.when(F.col("first.none"), F.col("rows")).otherwise(0)).when(F.col("least.order") == F.col("first"), F.col("least.n")).otherwise(0)
    split = cells.withColumn("first", first).withColumn("original", original)
    either = F.array(F.struct(F.lit(False).alias("copy"), F.col("original").alias("n")), F.struct(F.lit(True).alias("copy"), (F.col("rows") - F.col("original")).alias("n")))
    return split.select(*keys, F.explode(either).alias("cell")).select(*keys, "cell.copy", "cell.n").where("n > 0")


def document_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts ``n`` of documents by part, flags A to E, good and toxic."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    flags = text_failures(text)
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        *[flag.alias(name) for name, flag in flags.items()],
    )
    rated = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    rated = rated.where("id is not null")
    rows = rows.join(rated, "id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("good", "toxic")})
    return with_copies(rows, ["part", *flags, "good", "toxic"], "digest", "id").withColumnRenamed("copy", "E")


def joint_failures(cells: DataFrame, filters: Sequence[str], part_col: str, measures: Mapping[str, Column]) -> DataFrame:
    """Per part one array ``joint_<measure>`` of 2**n sums: at index S (bit i: filter i) of rows that fail all of S."""
    flag = [F.col(f).cast("long") for f in filters]
    product = lambda s: reduce(lambda x, y: x * y, [flag[i] for i in range(len(flag)) if s >> i & 1], F.lit(1).cast("long"))
    sums = {f"{m}_{s}": F.sum(amount * product(s)) for m, amount in measures.items() for s in range(1 << len(flag))}
    got = cells.groupBy(part_col).agg(*[column.alias(name) for name, column in sums.items()])
    return got.select(part_col, *[F.array(*[F.col(f"{m}_{s}") for s in range(1 << len(flag))]).alias(f"joint_{m}") for m in measures])


def moebius(joint: np.ndarray) -> np.ndarray:
    """``out[..., S]``: the sum over all R in S of (-1)**|R| * joint[..., R]."""
    n = joint.shape[-1].bit_length() - 1
    sign = np.array([(-1) ** s.bit_count() for s in range(1 << n)])
    out = joint * sign
    for i in range(n):
        holds = np.flatnonzero(np.arange(1 << n) >> i & 1)
        out[..., holds] += out[..., holds ^ 1 << i]
    return out


def audit(cells: DataFrame, filters: Sequence[str], part_col: str = "part", rows_col: str = "n", lost: Mapping[str, str] | None = None) -> DataFrame:
    """One row per part, order of the filters and step.

    ``cells``: flags named by ``filters`` (true: fails), ``rows_col`` documents each. ``lost``: result columns that count
    the removed documents for which a boolean column holds.
    """
    n, lost = len(filters), dict(lost or {})
    if not 0 < n <= MOST_FILTERS:
        raise ValueError(f"between 1 and {MOST_FILTERS} filters")
    measures = {"rows": F.col(rows_col)} | {name: F.when(F.col(c), F.col(rows_col)).otherwise(0) for name, c in lost.items()}
    joint = joint_failures(cells, filters, part_col, measures)
    orders = list(permutations(range(n)))
    names = pa.array(["".join(filters[i] for i in order) for order in orders for _ in order])
    step = np.array([k + 1 for _ in orders for k in range(n)], np.int32)
    which = np.array(orders).ravel()
    after = np.array([sum(1 << i for i in order[: k + 1]) for order in orders for k in range(n)])
    before = after ^ 1 << which
    members = np.array([s.bit_count() for s in range(1 << n)])
    holds = np.array([[s >> i & 1 for s in range(1 << n)] for i in range(n)])
    dividend = np.where(members % 2, 1, -1) * holds
    shares = dividend * (factorial(n) // np.maximum(members, 1))
    schema = T.StructType([joint.schema[part_col], T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType())])
    for name in ("kept", "removed", "redundant", "unique_fails", *lost, "shapley"):
        schema = schema.add(name, T.LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                sums = np.array([column[k].as_py() for column in batch.columns[1:]], np.int64)
                kept = moebius(sums)
                removed = kept[:, before] - kept[:, after]
                failing = sums[0][1 << which]
                columns = [kept[0][after], removed[0], failing - removed[0], (dividend @ sums[0])[which], *removed[1:], (shares @ sums[0])[which]]
                part = batch.column(0).take(pa.array(np.full(len(step), k)))
                yield pa.RecordBatch.from_arrays([part, names, pa.array(step), *map(pa.array, columns)], names=schema.names)

    return joint.mapInArrow(run, schema)
