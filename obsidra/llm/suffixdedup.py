"""Suffix-array dedup on bytes: every byte inside a string of ``width`` bytes that starts more than once goes.

Three rounds. (1) Each window of ``width`` bytes is filed under the least fingerprint of its ``GRAM``-byte strings; names
are counted over the corpus and those at one place drop out: equal windows have equal names, so no repeat is lost.
(2) Runs of windows under one shared name (with all their bytes) go to the shard of that name, where equal runs
become one with a number, and the shard's suffix array is built by external induced sorting (:mod:`.induced`): suffixes
whose common prefix with a neighbour (or a copy) reaches ``width`` are the repeats. (3) Each document drops the bytes they cover.

A name under which more than ``hot_runs`` different runs stand (a common line in many contexts) would fill one shard: its
windows are filed anew, each under the fingerprint of all its bytes, counted as in round 1, and only those at several places
go on, spread over all shards.

Matches never cross documents: a byte that UTF-8 has not stands between the runs. All copies of a repeat go, the first
one too; overlaps of a text with itself count.

Defined cases: a null text is empty; texts shorter than ``width`` keep all; rows that repeat id and text are one document
and get equal results; kept bytes may end inside a character, so they are binary; columns of the input are kept, those
with names of result columns are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, group_bits, mixed, slices, text_buffers, text_bytes, tidy
from .exchange import by_range, counted_names, distinct_rows, grouped_documents, in_sorted, joined, packed, shared_names
from .induced import MEMORY_BYTES, repeated

GRAM = 32
#: A byte that no UTF-8 text has.
BORDER = b"\xff"
_MULT = 0xD1342543DE82EF95
_CODES = np.random.default_rng(977).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(4)
def _powers_below(n: int, base: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a slice's length only."""
    if n <= SLICE_BYTES:
        return _powers_below(SLICE_BYTES, base)[:n]
    return _powers_below.__wrapped__(n, base)


def sliding(x: np.ndarray, width: int, ufunc: np.ufunc, fill: int) -> np.ndarray:
    """ufunc over all ``width`` consecutive values, by prefixes and suffixes of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    head = ufunc.accumulate(blocks, axis=1).ravel()
    tail = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(tail[: n - width + 1], head[width - 1 : n])


class _Windows:
    """The windows inside one text each (their starts ``at``) of some texts, and the fingerprint each is filed under."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int) -> None:
        n, gram = len(data), min(GRAM, width)
        self.width, self.at, self.key = width, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        if n < width:
            return
        self.sums = np.empty(n + 1, np.uint64)
        self.sums[0] = 0
        np.cumsum(_CODES[data] * powers(n, _MULT), out=self.sums[1:])
        self.inverse = powers(n, pow(_MULT, -1, 1 << 64))
        self.grams = mixed((self.sums[gram:] - self.sums[:-gram]) * self.inverse[: n - gram + 1])
        key = sliding(self.grams, width - gram + 1, np.minimum, (1 << 64) - 1)
        inside = np.zeros(n + 1, np.int32)
        begin, end = offsets[:-1], offsets[1:]
        has = end - begin >= width
        np.add.at(inside, begin[has], 1)
        np.add.at(inside, end[has] - width + 1, -1)
        self.at = np.flatnonzero(np.cumsum(inside[: len(key)]) > 0)
        self.key = key[self.at]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first window, last window, name) of runs of windows under one name."""
        if not len(self.at):
            return self.at, self.at, self.key
        new = np.ones(len(self.at), bool)
        new[1:] = (self.key[1:] != self.key[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        begin = np.flatnonzero(new)
        return self.at[begin], self.at[np.append(begin[1:], len(self.at)) - 1], mixed(self.key[begin])

    def places(self) -> np.ndarray:
        """The name of every place that some window is filed under: equal strings inside one run are several places."""
        if not len(self.at):
            return self.key
        span = self.width - min(GRAM, self.width) + 1
        used = np.zeros(len(self.grams) + span - 1, np.uint64)
        used[span - 1 + self.at] = self.key
        # a window's key is the least of its fingerprints: a place is used if the largest key around equals its own
        return mixed(self.grams[sliding(used, span, np.maximum, 0) == self.grams])

    def prints(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of the bytes [begin, end)."""
        return mixed((self.sums[end] - self.sums[begin]) * self.inverse[begin] + (end - begin).astype(np.uint64)) if len(begin) else np.zeros(0, np.uint64)


def _parts(table: pa.Table, width: int):
    """(first byte, bytes, windows) of slices of a group."""
    data, offsets = text_buffers(table.column("__text"))
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        own = data[part[0] : part[-1]]
        yield int(part[0]), own, _Windows(own, part - part[0], width)


#: What a group says of a name: the least fingerprint of its runs, their number, and whether it has several places.
NAME = np.dtype([("name", "<u8"), ("least", "<u8"), ("runs", "<u4"), ("often", "?")])
#: Names of usual frequency, hot ones, and fingerprints of windows under hot names.
COLD, HOT, WINDOW = 0, 1, 2


def _counted_runs(name: np.ndarray, content: np.ndarray, places: np.ndarray, group: int, bits: int) -> pa.Table:
    """Rows (range, group, names) of the names of one group: of its runs and of the places they are filed under."""
    order = np.lexsort((content, name))
    name, content = name[order], content[order]
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    different = new.copy()
    different[1:] |= content[1:] != content[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(begin), NAME)
    out["name"], out["least"] = name[begin], content[begin]
    out["runs"] = np.add.reduceat(different, begin, dtype=np.int64) if len(begin) else 0
    places = np.sort(places)
    out["often"] = np.searchsorted(places, out["name"], "right") - np.searchsorted(places, out["name"], "left") > 1
    bound, ranges = by_range(out["name"], bits)
    return pa.table({"range": pa.array(ranges, pa.int32()), "group": pa.array([group] * len(ranges), pa.int32()), "names": pa.array([packed(out[a:b]) for a, b in zip(bound[:-1], bound[1:])], pa.binary())})


def _sorted_names(table: pa.Table, kind: int) -> np.ndarray:
    """The names of one kind that a group is told of."""
    return np.sort(joined(table.filter(pc.equal(table.column("kind"), kind)).column("names"), np.uint64))


def suffix_dedup(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text", hot_runs: int = 8192, memory: int = MEMORY_BYTES) -> DataFrame:
    """``docs`` (without the text) with n_bytes, n_removed, n_spans, kept (bytes) and removed (byte spans)."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    added = [
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept", T.BinaryType()),
        T.StructField("removed", T.ArrayType(span)),
    ]
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    bits = group_bits(text_bytes(docs, text_col))
    grouped = grouped_documents(docs, bits, id_col, text_col, {f.name for f in added})

    def name_texts(key, table):
        table, _ = distinct_rows(table)
        found = [(np.zeros(0, np.uint64),) * 3]
        for _, _, windows in _parts(table, width):
            first, last, name = windows.runs()
            found.append((name, windows.prints(first, last + width), windows.places()))
        name, content, places = (np.concatenate(x) for x in zip(*found))
        tidy()
        return _counted_runs(name, content, places, key[0].as_py(), bits)

    def told_names(key, table):
        """Rows (group, kind, names) of the names of one range that stand at several places."""
        parts = [np.frombuffer(x, NAME) for x in table.column("names").to_pylist()]
        group = np.repeat(table.column("group").to_numpy(), [len(x) for x in parts])
        names = np.concatenate(parts)
        order = np.lexsort((names["least"], names["name"]))
        names, group = names[order], group[order]
        new = np.ones(len(names), bool)
        new[1:] = names["name"][1:] != names["name"][:-1]
        begin = np.flatnonzero(new)
        other = new.copy()
        other[1:] |= names["least"][1:] != names["least"][:-1]
        size = np.diff(np.append(begin, len(names)))
        shared = (size > 1) | np.logical_or.reduceat(names["often"], begin)
        hot = np.add.reduceat(other + names["runs"].astype(np.int64) - 1, begin) > hot_runs  # copies in many groups are one run
        kind = np.repeat(np.where(shared, np.where(hot, HOT, COLD), -1), size)
        rows = []
        for k in (COLD, HOT):
            at = np.flatnonzero(kind == k)
            at = at[np.argsort(group[at], kind="stable")]
            own, start = np.unique(group[at], return_index=True)
            rows += [(int(g), k, packed(names["name"][at[a:b]])) for g, a, b in zip(own, start, np.append(start[1:], len(at)))]
        tidy()
        return pa.table({"group": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "names": pa.array([r[2] for r in rows], pa.binary())})

    def hot_windows(key, left, right):
        """Rows (range, group, names, often) of the windows under hot names."""
        hot = _sorted_names(right, HOT)
        found = [np.zeros(0, np.uint64)]
        if left.num_rows and len(hot):
            for _, _, windows in _parts(distinct_rows(left)[0], width):
                at = windows.at[in_sorted(mixed(windows.key), hot)] if len(windows.at) else windows.at
                found.append(windows.prints(at, at + width))
        tidy()
        return counted_names(np.concatenate(found), left.column("__group")[0].as_py() if left.num_rows else 0, bits)

    def runs(key, left, right):
        """Rows (range, group, bytes, lengths, counts, starts): different runs of windows under shared names."""
        rows: dict[int, dict[bytes, list[int]]] = {}
        if left.num_rows and right.num_rows:
            cold, hot, again = (_sorted_names(right, kind) for kind in (COLD, HOT, WINDOW))
            for base, own, windows in _parts(distinct_rows(left)[0], width):
                first, last, name = windows.runs()
                hit = in_sorted(name, cold)
                first, last, name = first[hit], last[hit], name[hit]
                if len(hot) and len(windows.at):
                    at = windows.at[in_sorted(mixed(windows.key), hot)]
                    other = windows.prints(at, at + width)
                    hit = in_sorted(other, again)
                    first, last, name = np.append(first, at[hit]), np.append(last, at[hit]), np.append(name, other[hit])
                raw = own.tobytes()
                to = (name >> np.uint64(64 - bits)).tolist()
                for a, b, r in zip(first.tolist(), last.tolist(), to):
                    rows.setdefault(r, {}).setdefault(raw[a : b + width], []).append(base + a)
        group = left.column("__group")[0].as_py() if left.num_rows else 0
        tidy()
        return pa.table(
            {
                "range": pa.array(list(rows), pa.int32()),
                "group": pa.array([group] * len(rows), pa.int32()),
                "bytes": pa.array([b"".join(r) for r in rows.values()], pa.binary()),
                "lengths": pa.array([packed(np.fromiter(map(len, r), np.int32, len(r))) for r in rows.values()], pa.binary()),
                "counts": pa.array([packed(np.fromiter(map(len, r.values()), np.int32, len(r))) for r in rows.values()], pa.binary()),
                "starts": pa.array([packed(np.array([s for x in r.values() for s in x], np.int64)) for r in rows.values()], pa.binary()),
            }
        )

    def sort_shard(key, table):
        """Rows (group, starts, lengths): runs of repeated windows."""
        number: dict[bytes, int] = {}
        copies: list[int] = []
        held = []
        for raw, lengths, counts in zip(*(table.column(c).to_pylist() for c in ("bytes", "lengths", "counts"))):
            at, mine = 0, []
            for length, count in zip(np.frombuffer(lengths, np.int32).tolist(), np.frombuffer(counts, np.int32).tolist()):
                run = raw[at : at + length]
                at += length
                i = number.setdefault(run, len(number))
                if i == len(copies):
                    copies.append(0)
                copies[i] += count
                mine.append((i, count))
            held.append(mine)
        # equal runs are sorted once: a suffix of one that has copies shares all its bytes with its neighbours, theirs
        text = BORDER.join(number)
        flags = repeated(np.frombuffer(text, np.uint8), width, memory)
        del text
        spans: list[tuple[list[int], list[int]]] = []
        at = 0
        for run, i in number.items():
            mark = flags[at : at + len(run) - width + 1]
            if copies[i] > 1:
                mark[:] = True
            step = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
            spans.append((step[::2].tolist(), (step[1::2] - step[::2]).tolist()))
            at += len(run) + 1
        groups, starts, lengths = [], [], []
        for mine, group, where in zip(held, table.column("group").to_pylist(), table.column("starts").to_pylist()):
            where = np.frombuffer(where, np.int64).tolist()
            at, s, n = 0, [], []
            for i, count in mine:
                begin, size = spans[i]
                for base in where[at : at + count]:
                    s += [base + b for b in begin]
                    n += size
                at += count
            if s:
                groups.append(group)
                starts.append(packed(np.array(s, np.int64)))
                lengths.append(packed(np.array(n, np.int32)))
        tidy()
        return pa.table({"group": pa.array(groups, pa.int32()), "starts": pa.array(starts, pa.binary()), "lengths": pa.array(lengths, pa.binary())})

    schema = T.StructType([grouped.schema["__row"], *added])

    def remove(key, left, right):
        if not left.num_rows:
            return pa.table([left.column("__row"), *(pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), spans_type))], names=["__row", *[f.name for f in added]])
        table, which = distinct_rows(left)
        data, offsets = text_buffers(table.column("__text"))
        edge = np.zeros(len(data) + 1, np.int32)
        if right.num_rows:
            start, length = joined(right.column("starts"), np.int64), joined(right.column("lengths"), np.int32)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + length - 1 + width, -1)
        gone = np.cumsum(edge[:-1]) > 0
        del edge
        total = np.append(0, np.cumsum(gone))
        new = gone.copy()
        new[1:] &= ~gone[:-1]
        inner = offsets[:-1][offsets[:-1] < len(data)]
        new[inner] |= gone[inner]  # a span ends with its text
        begin = np.flatnonzero(new)
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        final = offsets[1:][np.diff(offsets) > 0] - 1
        last[final] |= gone[final]
        end = np.flatnonzero(last) + 1
        bound = np.searchsorted(begin, offsets)
        owner_start = np.repeat(offsets[:-1], np.diff(bound))
        spans = pa.ListArray.from_arrays(pa.array(bound.astype(np.int32)), pa.StructArray.from_arrays([pa.array(begin - owner_start), pa.array(end - begin)], ["start", "length"]))
        raw = data[~gone].tobytes()
        cut = (offsets - total[offsets]).tolist()
        removed = total[offsets[1:]] - total[offsets[:-1]]
        at = pa.array(which)
        tidy()
        cols = [pa.array(np.diff(offsets)), pa.array(removed), pa.array(np.diff(bound)), pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:])], pa.binary()), spans]
        return pa.table([left.column("__row"), *(c.take(at) for c in cols)], names=["__row", *[f.name for f in added]])

    by_group = grouped.groupBy("__group")
    told = by_group.applyInArrow(name_texts, "range int, group int, names binary").repartition(1 << bits, "range").groupBy("range").applyInArrow(told_names, "group int, kind int, names binary")
    anew = by_group.cogroup(told.groupBy("group")).applyInArrow(hot_windows, "range int, group int, names binary, often binary")
    again = anew.repartition(1 << bits, "range").groupBy("range").applyInArrow(shared_names, "group int, names binary").select("group", F.lit(WINDOW).alias("kind"), "names")
    sent = by_group.cogroup(told.unionByName(again).groupBy("group")).applyInArrow(runs, "range int, group int, bytes binary, lengths binary, counts binary, starts binary")
    found = sent.repartition(1 << bits, "range").groupBy("range").applyInArrow(sort_shard, "group int, starts binary, lengths binary")
    return by_group.cogroup(found.groupBy("group")).applyInArrow(remove, schema).select("__row.*", *[f.name for f in added])
