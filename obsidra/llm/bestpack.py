"""Best-fit packing: repeat counts of few-document patterns by non-negative least squares.

A document is its token ids and an end id. Longer documents than ``capacity`` are cut so that only the first piece is
short. A piece of full length is a sequence; all others are known to the plan by their length alone, so the plan is made
from a histogram of ``capacity`` numbers, however many documents there are:

1. patterns of two or three lengths that fill a sequence exactly are enumerated;
2. how often each is repeated is fitted to the histogram by non-negative least squares (lengths weighted by their
   tokens), with an active set, so that no more patterns are used than there are lengths;
3. repeats are rounded and cut to what is there; the residual histogram is packed by best fit decreasing, on counts.

The plan is a list of intervals: pieces of one length with ranks [a, b) go to sequences s, s + 1, ... at one offset. Ranks
are numbered per block of documents (bounded by bytes of text) and length; the blocks' counts are summed by a window per
length over blocks. No row is sorted, and texts are tokenized once.

Defined cases: null and empty texts are the end id alone; repeated rows are packed once each; null ids are ordinary;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, staged, text_buffers, tidy
from .textunits import BytePairs, UnitTable, bare_units, gathered, kept_in_worker

#: Rounds of the active set, and patterns that enter it in one round.
FIT_ROUNDS, FIT_ENTERING = 60, 32
#: Bytes of text whose pieces are numbered together.
BLOCK_BYTES = 64 << 20
RANK_BITS = 44


@dataclass(frozen=True)
class Plan:
    """Intervals in order of (length, first rank): where pieces of that length go from that rank on."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces by length and rank."""
        key = (self.length << RANK_BITS) + self.rank
        at = np.searchsorted(key, (length.astype(np.int64) << RANK_BITS) + rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none), ascending, that sum to ``capacity``; all lengths are in ``present``."""
    there = np.zeros(capacity + 1, bool)
    there[present] = True
    there[0] = True  # no third document
    found = []
    for small in [0, *present[present <= capacity // 3].tolist()]:
        middle = np.arange(max(small, 1), (capacity - small) // 2 + 1)
        large = capacity - small - middle
        ok = there[middle] & there[large]
        found.append(np.stack([np.full(int(ok.sum()), small), middle[ok], large[ok]], 1))
    return np.concatenate(found)


def fitted_repeats(shapes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of ``shapes``, repeats >= 0) that fit the histogram ``counts`` with the least squared error in tokens.

    Active set: patterns whose lengths are short of documents enter, those whose repeats would be negative leave, and the
    repeats of the rest solve the normal equations.
    """
    size = len(counts)
    weight = np.arange(size, dtype=float)  # tokens of a length; 0 for none
    target = counts * weight
    active, x = np.zeros(0, np.int64), np.zeros(0)
    matrix, rest = np.zeros((0, size)), target
    for _ in range(FIT_ROUNDS):
        gain = (weight * rest)[shapes].sum(1)
        best = np.argsort(-gain, kind="stable")[: 40 * FIT_ENTERING]
        best = best[gain[best] > 1e-6 * target.sum()]
        taken, entering = np.isin(np.arange(len(shapes)), active), []
        used = np.zeros(size, bool)
        for row in best[~taken[best]].tolist():  # patterns that share no length enter together
            if not used[shapes[row]].any():
                used[shapes[row][shapes[row] > 0]] = True
                entering.append(row)
                if len(entering) == FIT_ENTERING:
                    break
        if not entering:
            break
        added = np.zeros((len(entering), size))
        for slot in range(shapes.shape[1]):
            np.add.at(added, (np.arange(len(entering)), shapes[entering, slot]), weight[shapes[entering, slot]])
        active, matrix = np.append(active, entering), np.concatenate([matrix, added])
        while len(active):
            gram = matrix @ matrix.T
            x = np.linalg.solve(gram + np.eye(len(gram)) * 1e-9 * gram.trace(), matrix @ target)
            stays = x > 0
            if stays.all():
                break
            active, matrix = active[stays], matrix[stays]
        rest = target - x @ matrix if len(active) else target
        if np.abs(rest).sum() < 1e-6 * target.sum():
            break
    return active, x[: len(active)]


def best_fit(counts: np.ndarray, capacity: int, first: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit decreasing on a histogram: ([(length, pieces, sequence, offset)], next free sequence number)."""
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of sequences (first, number)
    out = []

    def fill(free: int, run: int, number: int, length: int, left: int) -> int:
        """Puts up to ``left`` pieces into ``number`` like sequences; the pieces put."""
        each = free // length
        whole = min(number, left // each)
        for slot in range(each if whole else 0):
            out.append((length, whole, run, capacity - free + slot * length))
        if whole:
            room.setdefault(free - each * length, []).append((run, whole))
        more = left - whole * each
        if more >= each or whole == number:
            more = 0
        for slot in range(more):
            out.append((length, 1, run + whole, capacity - free + slot * length))
        used = whole + (more > 0)
        if more:
            room.setdefault(free - more * length, []).append((run + whole, 1))
        if used < number:
            room.setdefault(free, []).append((run + used, number - used))
        return whole * each + more

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            free = min((f for f, runs in room.items() if f >= length and runs), default=None)
            if free is None:
                number = -(-left // (capacity // length))
                run, first = first, first + number
                left -= fill(capacity, run, number, length, left)
            else:
                run, number = room[free].pop()
                left -= fill(free, run, number, length, left)
    return out, first


def packing_plan(counts: np.ndarray, capacity: int) -> Plan:
    """Where the pieces of each length go; ``counts[l]`` pieces have length l (0 to ``capacity``)."""
    left = np.array(counts, np.int64)
    left[0] = 0
    placed: list[tuple[int, int, int, int]] = [(capacity, int(left[capacity]), 0, 0)] if left[capacity] else []
    first = int(left[capacity])
    left[capacity] = 0
    shapes = patterns(np.flatnonzero(left), capacity)
    if len(shapes):
        rows, repeats = fitted_repeats(shapes, left.astype(float)[: capacity + 1])
        for k in np.argsort(-repeats, kind="stable").tolist():
            lengths, times = np.unique(shapes[rows[k]][shapes[rows[k]] > 0], return_counts=True)
            number = int(min(np.rint(repeats[k]), (left[lengths] // times).min()))
            if number <= 0:
                continue
            offset = 0
            for length, copies in zip(lengths.tolist(), times.tolist()):
                for _ in range(copies):
                    placed.append((length, number, first, offset))
                    offset += length
            left[lengths] -= number * times
            first += number
    rest, first = best_fit(left, capacity, first)
    placed += rest
    lengths = np.array([p[0] for p in placed], np.int64)
    order = np.argsort(lengths, kind="stable")
    lengths, number, sequence, offset = (np.array([p[i] for p in placed], np.int64)[order] for i in range(4))
    before = np.cumsum(number) - number
    start = np.searchsorted(lengths, lengths)
    return Plan(lengths, before - before[start] if len(before) else before, sequence, offset, first)


PIECES = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("rank", T.LongType()),
    ]
)


def ranks_inside(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each value's number among equal ones, counted on from ``seen`` (updated)."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    out = np.empty(len(lengths), np.int64)
    out[order] = np.arange(len(lengths)) - np.searchsorted(ordered, ordered) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def cut_pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool, block_bytes: int, part_bytes: int
) -> DataFrame:
    """Pieces of all documents with their rank among equal lengths of a block. No shuffle."""
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(f.name, rows.schema["row"].dataType if f.name == "row" else f.dataType) for f in PIECES])
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: UnitTable = kept_in_worker("pack", vocabulary, lambda: UnitTable(BytePairs(vocabulary, specials=True).encode))
        task, block, seen, size = TaskContext.get().partitionId(), 0, np.zeros(capacity + 1, np.int64), 0
        for batch in batches:
            column, bounds = batch.column(1), text_buffers(batch.column(1))[1]
            for i, j in slices(bounds, part_bytes):
                if size > block_bytes:
                    block, size, seen = block + 1, 0, np.zeros(capacity + 1, np.int64)
                size += int(bounds[j] - bounds[i])
                units = [bare_units(t) for t in column.slice(i, j - i).to_pylist()]
                numbers = table.numbers(units)
                tokens, unit_ends = gathered(table.flat, table.begin, numbers)
                last = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
                ends = unit_ends[last]  # each document's end among all tokens
                begins = np.append(0, ends[:-1])
                n = ends - begins + 1
                ids = np.insert(tokens, ends, end_id).astype("<u4")
                begins = begins + np.arange(len(n))
                pieces = -(-n // capacity)
                owner = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(number, head[owner] + (number - 1) * capacity, 0)
                length = np.where(number, capacity, head[owner])
                low = begins[owner] + start
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + length).tolist())]
                arrays = [
                    pa.array(np.full(len(owner), task << 24 | block)),
                    batch.column(0).slice(i, j - i).take(pa.array(owner)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(np.array(crc, np.int64)),
                    pa.array(ranks_inside(length, seen)),
                ]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.append(low, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                table.trim()
        tidy()

    return rows.mapInArrow(run, schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ids if asked for.

    ``vocabulary``: the JSON of a byte-level tokenizer.
    """
    pieces = staged(cut_pieces(docs, vocabulary, capacity, end_id, id_col, text_col, with_ids, block_bytes, part_bytes), "pack-pieces")
    blocks = pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = staged(blocks.withColumn("base", F.sum("n").over(order) - F.col("n")), "pack-bases", small=True)
    counts = np.zeros(capacity + 1, np.int64)
    for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect():  # capacity rows at most
        counts[r["length"]] = r["n"]
    plan = packing_plan(counts, capacity)

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.place(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    ranked = pieces.join(bases.drop("n"), ["block", "length"]).withColumn("at", placed("length", F.col("base") + F.col("rank")))
    return ranked.select(F.col("row").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
