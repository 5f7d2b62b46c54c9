"""Cross-tokenizer alignment: per-byte labels of two tokenizations of one text.

A byte is labelled by what ends there: no token, one of tokenizer A, one of B, or both. A regular expression scans the
label string for spans up to each both-label; a span is a token group, and the counts of its labels say how many tokens
of A and of B it holds. Between two neighbouring labels exactly one token of A and one of B overlap, so a text has as many
links (overlapping pairs of occurrences) as labels.

Texts are sequences of units at whose ends both tokenizers have a token's end (:mod:`.textunits`), so labels are
scanned once per distinct unit; groups and links of a text are those of its units, end to end.

Corpus counts. Documents are taken in blocks bounded by bytes of text and by distinct pairs. A block numbers its pairs,
counts the documents that hold each, and keeps of each document only the numbers of its pairs, delta-coded and
compressed; both go to a written table. Counts of blocks are summed per pair, the highest per id of A is a window over the
pairs of one id (no more than B has ids), and the sums come back to the blocks that hold the pair, where they meet its
documents. No key has more rows than there are blocks, and nothing grows with the corpus in a task or the driver.

Defined cases: null and empty texts, and texts that the tokens' bytes don't give back, have no tokens: zeros and an empty
groups text; repeated rows are documents of their own; null ids are ordinary; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, staged, text_buffers, tidy
from .sentencepieces import MARK
from .textunits import CACHE_UNITS, BytePairs, UnitTable, gathered, kept_in_worker, spaced_units, unit_of

#: Label bytes: nothing ends, a token of A, of B, of both.
LABELS = np.frombuffer(b".abx", np.uint8)
SPAN = re.compile(rb"[^x]*x")
#: Bounds of a block.
BLOCK_BYTES, BLOCK_PAIRS = 48 << 20, 1 << 21
#: Bytes of text aligned at once (a longer text goes alone).
PART_BYTES = 512 << 10


class Pieces:
    """Ids of units by a SentencePiece model that puts a space before each text."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.raw = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.raw.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else piece.replace(MARK, " ").encode())

    def encode(self, units: list[str]) -> list[list[int]]:
        """Ids of ``units``, whose first space is the model's own; it gives none to an empty text."""
        alone = [self.model.piece_to_id(MARK)]
        return [ids or alone for ids in self.model.encode([u[1:] for u in units], num_threads=1)]


class Aligner:
    """Groups and links of units, kept by unit number."""

    def __init__(self, vocabulary: str, model: bytes) -> None:
        self.a, self.b = BytePairs(vocabulary, specials=False), Pieces(model)
        self.size_b = len(self.b.raw)
        self.units = UnitTable(self.a.encode)
        self.raw = [self._table(self.a.raw), self._table(self.b.raw)]
        self.reset()

    @staticmethod
    def _table(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))

    def reset(self) -> None:
        self.units.reset()
        self.groups: list[str] = []
        #: per unit: tokens of A, of B, groups, links; -1 tokens: the bytes are not given back
        self.facts = np.zeros((0, 4), np.int64)
        self.pairs, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def trim(self) -> None:
        if len(self.groups) > CACHE_UNITS:
            self.reset()

    def _given_back(self, side: int, ids: np.ndarray, bounds: np.ndarray, want: np.ndarray, want_ends: np.ndarray) -> np.ndarray:
        """Whether the tokens of each unit, ``ids[bounds[k] : bounds[k + 1]]``, are its bytes."""
        flat, begin = self.raw[side]
        data, ends = gathered(flat, begin, ids)
        got = ends[bounds]
        same = np.diff(got) == np.diff(want_ends)
        whole = np.repeat(same, np.diff(got))
        wanted = np.repeat(same, np.diff(want_ends))
        wrong = np.flatnonzero(data[whole] != want[wanted])
        owner = np.repeat(np.arange(len(same)), np.diff(got))[whole]
        same[owner[wrong]] = False
        return same

    def learn(self, units: list[str], ids_a: np.ndarray, bounds_a: np.ndarray) -> None:
        """Aligns new ``units``, each not empty."""
        got = self.b.encode(units)
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        ids_b, bounds_b = np.fromiter(chain.from_iterable(got), np.int64, int(sizes.sum())), np.append(0, np.cumsum(sizes))
        ids_a = ids_a.astype(np.int64)
        raw = [u.encode() for u in units]
        want, want_ends = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))))
        ok = self._given_back(0, ids_a, bounds_a, want, want_ends) & self._given_back(1, ids_b, bounds_b, want, want_ends)
        fine_a, fine_b, fine = np.repeat(ok, np.diff(bounds_a)), np.repeat(ok, np.diff(bounds_b)), np.flatnonzero(ok)
        ids_a, ids_b = ids_a[fine_a], ids_b[fine_b]
        counts = [np.diff(bounds_a)[fine], np.diff(bounds_b)[fine]]
        ends = np.cumsum(np.diff(want_ends)[fine])
        kinds = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        for side, ids in ((0, ids_a), (1, ids_b)):
            kinds[np.cumsum(np.diff(self.raw[side][1])[ids]) - 1] |= 1 << side
        spans = np.fromiter((m.end() for m in SPAN.finditer(LABELS[kinds].tobytes())), np.int64)
        at = np.flatnonzero(kinds)
        ends_a, ends_b = kinds[at] & 1, kinds[at] >> 1
        through_a, through_b = np.cumsum(ends_a, dtype=np.int64), np.cumsum(ends_b, dtype=np.int64)
        pairs = ids_a[through_a - ends_a] * self.size_b + ids_b[through_b - ends_b]
        label = np.searchsorted(at, spans - 1)  # the labels at which groups end
        group_a, group_b = through_a[label].tolist(), through_b[label].tolist()
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, i, j = [], 0, 0
        for k, m in zip(group_a, group_b):
            groups.append(f"{','.join(text_a[i:k])}|{','.join(text_b[j:m])}")
            i, j = k, m
        n_groups = np.diff(np.append(0, np.searchsorted(spans, ends, side="right")))
        n_links = np.diff(np.append(0, np.searchsorted(at, ends)))
        facts = np.full((len(units), 4), -1, np.int64)
        facts[:, 3] = 0
        facts[fine] = np.stack([counts[0], counts[1], n_groups, n_links], 1)
        self.facts = np.concatenate([self.facts, facts])
        self.pairs = np.append(self.pairs, pairs)
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(facts[:, 3]))
        texts, low = [""] * len(units), 0
        for k, n in zip(fine.tolist(), n_groups.tolist()):
            texts[k] = ";".join(groups[low : low + n])
            low += n
        self.groups += texts

    def numbers(self, units: list[list[str]]) -> np.ndarray:
        before = len(self.units.known)
        out = self.units.numbers(units)
        if len(self.units.known) > before:
            new = [unit_of(k) for k in list(self.units.known)[before:]]
            begin = self.units.begin[before:]
            self.learn(new, self.units.flat[begin[0] : begin[-1]], begin - begin[0])
        return out


class PairNumbers:
    """Numbers of a block's pairs in order of arrival, and the documents that hold each."""

    def __init__(self) -> None:
        self.codes, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.docs = np.zeros(0, np.int64)

    def add(self, codes: np.ndarray) -> np.ndarray:
        """Numbers of ``codes``, each of them a document's own."""
        fresh, inverse, counts = np.unique(codes, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.codes, fresh)
        known = np.zeros(len(fresh), bool)
        inner = at < len(self.codes)
        known[inner] = self.codes[at[inner]] == fresh[inner]
        number = np.empty(len(fresh), np.int64)
        number[known] = self.number[at[known]]
        number[~known] = len(self.codes) + np.arange(int((~known).sum()))
        self.codes = np.insert(self.codes, at[~known], fresh[~known])
        self.number = np.insert(self.number, at[~known], number[~known])
        self.docs = np.append(self.docs, np.zeros(int((~known).sum()), np.int64))
        self.docs[number] += counts
        return number[inverse]

    def listed(self) -> np.ndarray:
        """Codes by number."""
        out = np.empty(len(self.codes), np.int64)
        out[self.number] = self.codes
        return out


def packed(numbers: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending ``numbers`` and how often each occurs: differences and times in planes of bytes, compressed."""
    values = np.concatenate([np.diff(numbers, prepend=0), times]).astype("<u4")
    return len(numbers).to_bytes(4, "little") + pa.compress(values.view(np.uint8).reshape(-1, 4).T.tobytes(), "zstd", asbytes=True)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(4, 2 * n)
    values = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(values[:n]), values[n:]


FACTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned(
    docs: DataFrame, vocabulary: str, model: bytes, id_col: str, text_col: str, with_groups: bool, block_bytes: int, part_bytes: int
) -> DataFrame:
    """Rows of two kinds: a document's facts and packed pairs, or a block's pairs (``codes``, ``docs``). No shuffle."""
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("row", rows.schema["row"].dataType)])
    for name in FACTS:
        schema = schema.add(name, T.LongType())
    schema = schema.add("groups_sha256", T.StringType()).add("groups", T.StringType()).add("links", T.BinaryType())
    schema = schema.add("codes", T.ArrayType(T.LongType())).add("docs", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner: Aligner = kept_in_worker("align", (vocabulary, model), lambda: Aligner(vocabulary, model))
        task, block, size, numbered = TaskContext.get().partitionId(), 0, 0, PairNumbers()
        kind = None

        def closed() -> pa.RecordBatch:
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (numbered.listed(), numbered.docs)]
            empty = [pa.nulls(1, kind), *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([task << 24 | block]), *empty, *lists], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            bounds = text_buffers(batch.column(1))[1]
            for i, j in slices(bounds, part_bytes):
                if size and (size + bounds[j] - bounds[i] > block_bytes or len(numbered.codes) > BLOCK_PAIRS):
                    yield closed()
                    block, size, numbered = block + 1, 0, PairNumbers()
                size += int(bounds[j] - bounds[i])
                texts = batch.column(1).slice(i, j - i).to_pylist()
                units = [spaced_units(t) if t else [] for t in texts]
                number = aligner.numbers(units)
                last = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)))
                bad = np.append(0, np.cumsum(aligner.facts[number, 0] < 0))
                sums = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(aligner.facts[number], 0)])
                first = np.append(0, last[:-1])
                good = (bad[last] == bad[first]) & (last > first)
                facts = np.where(good[:, None], sums[last] - sums[first], 0)
                names, groups, listed = number.tolist(), [], aligner.groups
                for ok, a, b in zip(good.tolist(), first.tolist(), last.tolist()):
                    groups.append(";".join([listed[n] for n in names[a:b]]) if ok else "")
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                owner = np.repeat(np.arange(len(units)), last - first)
                fine = good[owner]
                codes, ends = gathered(aligner.pairs, aligner.begin, number[fine])
                holder = np.repeat(owner[fine], np.diff(ends))
                # one sort by document, then pair
                span = len(aligner.a.raw) * aligner.size_b
                ordered = np.sort(holder * span + codes)
                head = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)
                times = np.diff(np.append(head, len(ordered)))
                holder, codes = np.divmod(ordered[head], span)
                mine = numbered.add(codes)
                order = np.lexsort((mine, holder))
                mine, times = mine[order], times[order]
                cuts = np.searchsorted(holder, np.arange(len(units) + 1)).tolist()
                links = [packed(mine[a:b], times[a:b]) if b > a else None for a, b in zip(cuts[:-1], cuts[1:])]
                arrays = [
                    pa.array(np.full(len(units), task << 24 | block)),
                    batch.column(0).slice(i, j - i),
                    *[pa.array(facts[:, k]) for k in range(4)],
                    pa.array(digests, pa.string()),
                    pa.array(groups if with_groups else [None] * len(units), pa.string()),
                    pa.array(links, pa.binary()),
                    pa.nulls(len(units), pa.list_(pa.int64())),
                    pa.nulls(len(units), pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
                aligner.trim()
        if size:
            yield closed()
        tidy()

    return rows.mapInArrow(run, schema)


def align(
    docs: DataFrame,
    vocabulary: str,
    model: bytes,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_groups: bool = False,
    block_bytes: int = BLOCK_BYTES,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, and the groups if asked for.

    ``vocabulary``: the JSON of tokenizer A, a byte-level one; ``model``: the file of B, a SentencePiece model.
    """
    size_b = len(Pieces(model).raw)
    table = staged(aligned(docs, vocabulary, model, id_col, text_col, with_groups, block_bytes, part_bytes), "align-blocks")
    listed = table.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "docs")).alias("number", "pair")).select("block", "number", "pair.codes", "pair.docs")
    counts = listed.groupBy("codes").agg(F.sum("docs").alias("count"))
    highest = F.max("count").over(Window.partitionBy(F.expr(f"codes div {size_b}")))
    counts = staged(counts.withColumn("best", F.col("count") == highest), "align-counts", small=True)
    known = listed.drop("docs").join(counts, "codes").select(F.col("block").alias("of"), "number", "count", "best")
    rows = table.where("codes is null").drop("codes", "docs")
    if not with_groups:
        rows = rows.drop("groups")
    kept = [f for f in rows.schema if f.name not in ("block", "links")]
    schema = T.StructType([*kept, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        number = right.column("number").to_numpy()
        count, best = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        count[number], best[number] = right.column("count").to_numpy(), right.column("best").to_numpy(zero_copy_only=False)
        n_best, total = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for k, data in enumerate(left.column("links").to_pylist()):
            if data is not None:
                numbers, times = unpacked(data)
                n_best[k], total[k] = best[numbers] @ times, count[numbers] @ times
        out = [left.column(f.name) for f in kept]
        return pa.Table.from_arrays([*out, pa.array(n_best), pa.array(total)], names=schema.names)

    done = rows.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(summed, schema)
    return done.select(F.col("row").alias(id_col), *FACTS, "n_best", "count_sum", "groups_sha256", *(["groups"] if with_groups else []))
