"""Packed exchanges between groups of documents and ranges of names.

A group of documents counts each of its names once and sends one row per range of names: packed arrays instead of rows.
The reply goes back the same way. So a name that stands in every document makes one entry per group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_struct

NO_ID = np.iinfo(np.int64).min


def grouped_documents(docs: DataFrame, bits: int, id_col: str, text_col: str, replaced: set[str]) -> DataFrame:
    """(__row, __id, __text, __mark, __group): other columns, id, text, text hash and the hash range it falls into."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    mark = F.xxhash64(F.col(id_col), text)
    grouped = docs.select(
        row_struct(docs, (text_col, *replaced)).alias("__row"),
        F.col(id_col).cast("long").alias("__id"),
        text.alias("__text"),
        mark.alias("__mark"),
        F.shiftright(mark, 64 - bits).cast("int").alias("__group"),
    )
    return grouped.repartition(1 << bits, "__group")  # tasks follow the data, whatever the session's setting


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype=dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def distinct_rows(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """The documents of a group, in order and once each, and the document of each row."""
    ids = table.column("__id").combine_chunks().fill_null(NO_ID).to_numpy()
    marks = table.column("__mark").to_numpy()
    order = np.lexsort((marks, ids))
    new = np.ones(len(order), bool)
    new[1:] = (ids[order][1:] != ids[order][:-1]) | (marks[order][1:] != marks[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return table.take(pa.array(order[new])), which


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def by_range(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the name ranges in sorted ``keys``, and the ranges that have any."""
    ranges = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begin = np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1])) if len(ranges) else np.zeros(0, np.int64)
    return np.append(begin, len(keys)), ranges[begin]


def counted_names(name: np.ndarray, group: int, bits: int) -> pa.Table:
    """Rows (range, group, names, often) of the names of one group; often: it has the name at several places."""
    name = np.sort(name)
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    begin = np.flatnonzero(new)
    often = np.diff(np.append(begin, len(name))) > 1
    name = name[begin]
    bound, ranges = by_range(name, bits)
    rows = [packed(name[a:b]) for a, b in zip(bound[:-1], bound[1:])]
    again = [packed(often[a:b]) for a, b in zip(bound[:-1], bound[1:])]
    return pa.table({"range": pa.array(ranges, pa.int32()), "group": pa.array([group] * len(rows), pa.int32()), "names": pa.array(rows, pa.binary()), "often": pa.array(again, pa.binary())})


def shared_names(key, table):
    """Rows (group, names) of the names of one range that stand at several places."""
    parts = [np.frombuffer(x, np.uint64) for x in table.column("names").to_pylist()]
    name = np.concatenate(parts)
    often = joined(table.column("often"), bool)
    group = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(name, kind="stable")
    name, often, group = name[order], often[order], group[order]
    equal = name[1:] == name[:-1]
    shared = often.copy()
    shared[1:] |= equal
    shared[:-1] |= equal
    name, group = name[shared], group[shared]
    order = np.argsort(group, kind="stable")
    name, group = name[order], group[order]
    bound = np.searchsorted(group, np.arange(len(parts) + 1))
    ids = table.column("group").to_pylist()
    has = [i for i in range(len(parts)) if bound[i] < bound[i + 1]]
    return pa.table({"group": pa.array([ids[i] for i in has], pa.int32()), "names": pa.array([packed(name[bound[i] : bound[i + 1]]) for i in has], pa.binary())})
