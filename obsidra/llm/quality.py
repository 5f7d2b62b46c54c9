"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Features of a text are hashed: every distinct word, the last three bytes of every distinct word, and words that repeat
their predecessor, each at a place of one table of 2**bits weights that all grades share. With z the sum of the
weights of a text's features (each distinct feature once) and ordered thresholds c1 < c2 < ... the model is
P(grade >= k) = logistic(z - c_k). It gives each text an expected grade and tail probabilities.

Training uses at most ``max_labels`` rated rows (a documented bound: the rows with the smallest hash of their id);
features in fewer than ``min_docs`` training texts, or no more frequent in some grade than chance explains, keep weight 0. Scoring covers every row and whole texts.

Defined cases: a null or empty text has z = 0; null ratings are left out; several ratings of one text all count;
without any rating every row is kept with null probabilities; repeated rows get equal results; extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITESPACE, mixed, row_struct, slices, text_buffers, tidy, word_hashes


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def bits(self) -> int:
        return int(len(self.weights)).bit_length() - 1


def _word_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    after = np.empty(len(data), bool)
    if len(data):
        space = WHITESPACE[data]
        after[-1] = True
        after[:-1] = space[1:]
        inner = offsets[1:-1]
        after[inner[(inner > 0) & (inner < len(data))] - 1] = True
        after &= ~space
    return np.flatnonzero(after)


def features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of each distinct feature of each text, in order of the text."""
    h, first = word_hashes(data, offsets)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    end = _word_ends(data, offsets)
    padded = np.concatenate([np.zeros(2, np.uint8), data]).astype(np.uint64)
    tail = mixed(padded[end] << np.uint64(16) | padded[end + 1] << np.uint64(8) | padded[end + 2] | np.uint64(1 << 60))
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    places = np.concatenate([h, tail, np.full(int(again.sum()), 0x5EED, np.uint64)]) >> np.uint64(64 - bits)
    both = np.concatenate([owner, owner, owner[again]]).astype(np.uint64) << np.uint64(bits) | places
    both = np.unique(both)
    return (both >> np.uint64(bits)).astype(np.int64), (both & np.uint64((1 << bits) - 1)).astype(np.int64)


def telling(owner: np.ndarray, place: np.ndarray, reached: np.ndarray, bits: int, min_docs: int, min_z: float) -> np.ndarray:
    """Features whose texts reach some grade more or less often than chance would have it, by ``min_z`` deviations."""
    seen = np.bincount(place, minlength=1 << bits)
    out = np.zeros(1 << bits, bool)
    for column in reached.T:
        share = column.mean()
        hits = np.bincount(place, column[owner].astype(float), minlength=1 << bits)
        out |= np.abs(hits - seen * share) >= min_z * np.sqrt(seen * share * (1 - share) + 1e-9)
    return out & (seen >= min_docs)


def fit_ordinal(owner: np.ndarray, place: np.ndarray, grades: np.ndarray, bits: int, min_docs: int = 3, min_z: float = 4.5, steps: int = 200, l2: float = 2e-4) -> OrdinalModel:
    """Full-batch Adam on the mean of the cumulative-link log loss, over the telling features."""
    n, levels = len(grades), int(grades.max()) + 1 if len(grades) else 1
    reached = grades[:, None] >= np.arange(1, levels)[None, :]
    use = telling(owner, place, reached, bits, min_docs, min_z)[place]
    owner, place = owner[use], place[use]
    columns, place = np.unique(place, return_inverse=True)
    share = np.clip(reached.mean(0), 1e-3, 1 - 1e-3)
    cuts = -np.log(share / (1 - share))
    w = np.zeros(len(columns))
    x = np.concatenate([w, cuts])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, cuts = x[: len(columns)], x[len(columns) :]
        z = np.bincount(owner, w[place], minlength=n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -30, 30)))
        miss = p - reached
        grad = np.concatenate([np.bincount(place, miss.sum(1)[owner], minlength=len(columns)) / n + l2 * w, -miss.mean(0)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        x = x - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        x[len(columns) :] = np.maximum.accumulate(x[len(columns) :])  # thresholds stay ordered
    weights = np.zeros(1 << bits, np.float32)
    weights[columns] = x[: len(columns)]
    return OrdinalModel(weights, x[len(columns) :].copy())


def train(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", max_labels: int = 6000, min_docs: int = 3, bits: int = 18) -> OrdinalModel | None:
    """A model of ``ratings`` (id, grade 0..K); None when there is none."""
    rated = ratings.select(F.col(id_col).alias("__id"), F.col(grade_col).cast("int").alias("__grade")).where("__id is not null and __grade >= 0")
    sample = rated.orderBy(F.xxhash64("__id"), "__id", "__grade").limit(max_labels)  # bounded, so the broadcast is
    joined = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(sample), "__id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("__text"))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                owner, place = features(data[part[0] : part[-1]], part - part[0], bits)
                starts = np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(place.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(i, j - i).cast(pa.string()), batch.column("__grade").slice(i, j - i), lists], ["id", "grade", "places"])

    table = joined.mapInArrow(extract, "id string, grade int, places array<int>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    if not table.num_rows:
        return None
    grades = table.column("grade").to_numpy()
    lists = table.column("places").combine_chunks()
    lengths = np.diff(np.asarray(lists.offsets))
    return fit_ordinal(np.repeat(np.arange(len(grades)), lengths), np.asarray(lists.flatten()).astype(np.int64), grades, bits, min_docs)


def score(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", min_tail: float = 0.4) -> DataFrame:
    """``docs`` with expected_grade, tail_probability (of the highest grade), grade and kept."""
    added = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("kept", T.BooleanType())]
    names = {f.name for f in added}
    rows = docs.select(row_struct(docs, tuple(names)).alias("__row"), F.col(text_col).cast("string").alias("__text"))
    schema = T.StructType([rows.schema["__row"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if model is None:
                none = pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("__row"), none, none, pa.nulls(n, pa.int32()), pa.array(np.ones(n, bool))], ["__row", *[f.name for f in added]])
                continue
            data, offsets = text_buffers(batch.column("__text"))
            z = np.zeros(n)
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                owner, place = features(data[part[0] : part[-1]], part - part[0], model.bits)
                z[i:j] = np.bincount(owner, model.weights[place].astype(np.float64), minlength=j - i)
            tails = 1 / (1 + np.exp(-np.clip(z[:, None] - model.thresholds[None, :], -500, 500)))
            top = tails[:, -1] if tails.shape[1] else np.ones(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__row"), pa.array(tails.sum(1)), pa.array(top), pa.array((tails >= 0.5).sum(1).astype(np.int32)), pa.array(top >= min_tail)],
                ["__row", *[f.name for f in added]],
            )
        tidy()

    return rows.mapInArrow(run, schema).select("__row.*", *[f.name for f in added])


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from quality and toxic marks: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
