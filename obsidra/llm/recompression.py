"""Substring dedup on words: recompression finds repeats, their words verify them.

A text is its words as 64-bit names. Recompression shortens it by rounds: runs of one token get one name, then in
every round neighbouring tokens (a, b) get one name where a keyed coin of a is 0 and that of b is 1. A name is a function
of what it stands for, so a round needs no exchange to be global: equal substrings get equal symbols in their interior, in
whatever document. Each symbol carries the words that decided it (its support).

Each window of ``window`` words is filed under the longest symbol whose support lies inside it (then by hash): equal
windows hold equal symbols at equal offsets, so they are filed under the same name (a window that holds no whole support
is filed under its own hash). The Spark rounds are:

1. Symbols are counted globally; those seen once drop out with all their windows.
2. Windows under shared symbols meet by 96-bit fingerprints over two independent word names; each learns where it starts
   first.
3. Windows that repeat are joined to maximal repeats: (place, place of the first occurrence, words). The words of each are
   digested (blake2b, 128 bits of their bytes), and the digest goes to the document group of the first occurrence.
4. That group compares the digests with its own text, and every document drops the words that its repeats cover. A repeat
   whose words differ (two windows with one fingerprint) ends the job with an error that asks for another ``seed``: what is removed is
   verified, never assumed.

Between rounds a group of documents exchanges packed arrays, one row for each pair of a group and a name range; a name
counts once per group, whatever its frequency, so no key gathers more rows than there are groups.

Order: smaller id first (null before all), texts of one id by their hash, then the start. Rows that repeat id and text
are one document and get equal results. A null text has no words. Empty tables give empty results. Columns of the input
are kept; those with the names of result columns are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import group_bits, mixed, plain_words, rolling, slices, text_buffers, text_bytes, tidy, word_names, word_places
from .exchange import NO_ID, by_range, counted_names, distinct_rows, grouped_documents, in_sorted, joined, packed, shared_names

ROUNDS = 4
_FAR = 1 << 40
_ONE, _ANOTHER = 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9


def symbols(h: np.ndarray, owner: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names after ``rounds`` of recompression, with their first word, and the support [low, high) that decided them.

    A support that leaves its document is given as infinite: such a symbol need not be the same elsewhere.
    """
    n = len(h)
    if not n:
        return h, *(np.zeros(0, np.int64),) * 3
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    length = end - start
    name = h[start]
    runs = length > 1
    name[runs] = mixed(name[runs] ^ mixed(length[runs].astype(np.uint64)))
    own = owner[start]
    # a run is decided by its two neighbours as well
    first, last = np.ones(len(own), bool), np.ones(len(own), bool)
    first[1:] = own[1:] != own[:-1]
    last[:-1] = first[1:]
    low, high = np.where(first, -_FAR, start - 1), np.where(last, _FAR, end + 1)
    for turn in range(rounds):
        coin = (mixed(name + np.uint64(0x9E37 * (turn + 1))) >> np.uint64(63)).astype(bool)
        same = own[1:] == own[:-1]
        pair = np.zeros(len(name), bool)
        pair[:-1] = same & ~coin[:-1] & coin[1:]
        second = np.zeros(len(name), bool)
        second[1:] = pair[:-1]
        # a single of coin 0 is decided by its right neighbour, of coin 1 by its left one; a pair by itself
        right_low, right_high = np.full(len(name), -_FAR), np.full(len(name), _FAR)
        left_low, left_high = right_low.copy(), right_high.copy()
        right_low[:-1][same], right_high[:-1][same] = low[1:][same], high[1:][same]
        left_low[1:][same], left_high[1:][same] = low[:-1][same], high[:-1][same]
        to_right = ~coin
        low, high = np.minimum(low, np.where(to_right, right_low, left_low)), np.maximum(high, np.where(to_right, right_high, left_high))
        at = np.flatnonzero(pair)
        name = name.copy()
        name[at] = mixed(name[at] * np.uint64(0x9FB21C651E98DF25) + mixed(name[at + 1] ^ np.uint64(turn + 77)))
        keep = ~second
        name, low, high, start, own = name[keep], low[keep], high[keep], start[keep], own[keep]
    return name, start, low, high


def windows_of(first: np.ndarray, width: int, n: int) -> np.ndarray:
    """Starts of all windows inside one text each; ``first``: the texts' first words (one more at the end)."""
    ok = np.zeros(n + 1, np.int32)
    begin, end = first[:-1], first[1:]
    has = end - begin >= width
    np.add.at(ok, begin[has], 1)
    np.add.at(ok, end[has] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0)


def filed(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window starts, the name each is filed under, the place of that name)."""
    n = len(h)
    at = windows_of(first, width, n)
    if not len(at):
        return at, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, start, low, high = symbols(h, owner)
    # longest symbol first, then by hash: long symbols are rare, so few windows share one by chance
    length = np.diff(np.append(start, n))
    name = np.maximum(63 - length, 0).astype(np.uint64) << np.uint64(58) | mixed(name) >> np.uint64(6)
    fits = high - low <= width
    name, start, low, high = name[fits], start[fits], low[fits], high[fits]
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    best, place = np.full(n, none), np.full(n, _FAR)
    spare = low - (high - width)  # the windows from high-width to low hold the support
    for step in range(width + 1):
        use = spare >= step
        if not use.any():
            break
        p = high[use] - width + step
        inside = p >= 0
        np.minimum.at(best, p[inside], name[use][inside])
    for step in range(width + 1):
        use = spare >= step
        if not use.any():
            break
        p = high[use] - width + step
        inside = p >= 0
        p, got, where = p[inside], name[use][inside], start[use][inside]
        hit = best[p] == got
        np.minimum.at(place, p[hit], where[hit])
    key, where = mixed(best[at]), place[at]
    bare = best[at] == none
    if bare.any():
        key[bare] = mixed(rolling(h, width, _ONE)[at[bare]] ^ np.uint64(0xABCDEF))
        where[bare] = at[bare]
    return at, key, where


class _Slice:
    """Some documents of a group: the words' bytes and places, and the numbers of the first document and the first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, doc: int, word: int) -> None:
        self.data, self.doc, self.word = data, doc, word
        self.start, self.end, self.first = word_places(data, offsets)

    def __len__(self) -> int:
        return len(self.start)

    def names(self, table: int = 0) -> np.ndarray:
        return word_names(self.data, self.start, self.end, table)

    def prints(self, at: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window in ``at``, over two independent names of its words."""
        return rolling(self.names(), window, _ONE + seed)[at], (rolling(self.names(1), window, _ANOTHER + seed)[at] >> np.uint64(32)).astype(np.uint32)


def _texts(table: pa.Table) -> Iterator[_Slice]:
    data, offsets = text_buffers(table.column("__text"))
    word = 0
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        one = _Slice(data[part[0] : part[-1]], part - part[0], i, word)
        word += len(one)
        yield one


def _digests(part: _Slice, begin: np.ndarray, words: np.ndarray) -> list[bytes]:
    """Digests of the words of repeats that begin at the slice's words ``begin``."""
    if not len(begin):
        return []
    text, bound = plain_words(part.data, part.start, part.end)
    raw = memoryview(text)
    return [hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bound[begin].tolist(), bound[begin + words].tolist())]


#: What a group learns of the windows that start earlier elsewhere, and what it claims of another group's text.
LATER = np.dtype([("one", "<u8"), ("two", "<u4"), ("place", "<u4"), ("group", "<i4")])
CLAIM = np.dtype([("place", "<u4"), ("words", "<u4"), ("digest", "S16")])


def _key(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """96 bits as 64, for looking up inside a group."""
    return one ^ mixed(two.astype(np.uint64))


def substring_dedup(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """``docs`` with n_words, n_removed, kept_text (kept words joined by one space) and removed (word spans)."""
    spans_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()), T.StructField("removed", spans_type)]
    names = {f.name for f in added}
    bits = group_bits(text_bytes(docs, text_col))
    grouped = grouped_documents(docs, bits, id_col, text_col, names)

    def name_texts(key, table):
        table, _ = distinct_rows(table)
        found = []
        for part in _texts(table):
            at, name, place = filed(part.names(), part.first, window)
            change = np.ones(len(at), bool)
            change[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1])
            found.append(name[change])
        out = counted_names(np.concatenate(found) if found else np.zeros(0, np.uint64), key[0].as_py(), bits)
        tidy()
        return out

    def windows(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"range": pa.array([], pa.int32()), "group": pa.array([], pa.int32()), "windows": pa.array([], pa.binary())})
        left, _ = distinct_rows(left)
        ids = left.column("__id").combine_chunks().fill_null(NO_ID).to_numpy()
        shared = np.sort(joined(right.column("names"), np.uint64))
        found = []
        for part in _texts(left):
            at, name, _ = filed(part.names(), part.first, window)
            at = at[in_sorted(name, shared)]
            doc = np.searchsorted(part.first, at, side="right") - 1 + part.doc
            found.append((*part.prints(at, window, seed), ids[doc], (at + part.word).astype(np.uint32)))
        one, two, doc, place = (np.concatenate(x) for x in zip(*found))
        del found
        order = np.lexsort((two, one))  # stable: the first of each is the earliest of this group
        one, two, doc, place = one[order], two[order], doc[order], place[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        one, two, doc, place = one[new], two[new], doc[new], place[new]
        bound, ranges = by_range(one, bits)
        rows = [packed(doc[a:b], one[a:b], two[a:b], place[a:b]) for a, b in zip(bound[:-1], bound[1:])]
        tidy()
        return pa.table({"range": pa.array(ranges, pa.int32()), "group": pa.array([left.column("__group")[0].as_py()] * len(rows), pa.int32()), "windows": pa.array(rows, pa.binary())})

    def first_windows(key, table):
        parts = table.column("windows").to_pylist()
        sizes = [len(x) // 24 for x in parts]
        doc = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(parts, sizes)])
        one = np.concatenate([np.frombuffer(x, np.uint64, n, 8 * n) for x, n in zip(parts, sizes)])
        two = np.concatenate([np.frombuffer(x, np.uint32, n, 16 * n) for x, n in zip(parts, sizes)])
        place = np.concatenate([np.frombuffer(x, np.uint32, n, 20 * n) for x, n in zip(parts, sizes)])
        del parts
        ids = table.column("group").to_numpy()
        group = np.repeat(ids, sizes)  # groups are ranges of the texts' hashes: they order texts of one id
        order = np.lexsort((group, doc, two, one))
        one, two, group, place = one[order], two[order], group[order], place[order]
        later = np.zeros(len(one), bool)
        later[1:] = (one[1:] == one[:-1]) & (two[1:] == two[:-1])
        head = np.maximum.accumulate(np.where(later, 0, np.arange(len(one))))[later]
        out = np.empty(len(head), LATER)
        out["one"], out["two"], out["place"], out["group"] = one[later], two[later], place[head], group[head]
        group = group[later]
        order = np.argsort(group, kind="stable")
        out, group = out[order], group[order]
        own = np.unique(group)
        bound = np.append(np.searchsorted(group, own), len(group))
        tidy()
        return pa.table({"group": pa.array(own, pa.int32()), "later": pa.array([packed(out[a:b]) for a, b in zip(bound[:-1], bound[1:])], pa.binary())})

    def repeats(key, left, right):
        """Rows (to, covered, claims): the words that a group's repeats cover, and claims on the texts they repeat."""
        if not left.num_rows:
            return pa.table({"to": pa.array([], pa.int32()), "covered": pa.array([], pa.binary()), "claims": pa.array([], pa.binary())})
        own = left.column("__group")[0].as_py()
        left, _ = distinct_rows(left)
        parts = list(_texts(left))
        at, keys = [], []
        for part in parts:
            w = windows_of(part.first, window, len(part))
            at.append(w + part.word)
            keys.append(_key(*part.prints(w, window, seed)))
        at, keys = np.concatenate(at), np.concatenate(keys)
        order = np.argsort(keys, kind="stable")
        same = np.zeros(len(keys), bool)
        same[1:] = keys[order][1:] == keys[order][:-1]
        head = np.empty(len(keys), np.int64)
        head[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(keys))))]
        repeat = head != np.arange(len(keys))
        source, where = np.full(len(keys), own, np.int32), at[head]
        later = joined(right.column("later"), LATER) if right.num_rows else np.zeros(0, LATER)
        if len(later):
            known = _key(later["one"], later["two"])
            order = np.argsort(known)
            known, later = known[order], later[order]
            place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            hit = np.flatnonzero(known[place] == keys)
            source[hit], where[hit] = later["group"][place[hit]], later["place"][place[hit]]
            repeat[hit] = True
        at, source, where = at[repeat], source[repeat], where[repeat]
        # maximal repeats: windows one after the other, as are their first occurrences
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (where[1:] != where[:-1] + 1) | (source[1:] != source[:-1])
        begin = np.flatnonzero(new)
        words = np.diff(np.append(begin, len(at))) + window - 1
        at, source, where = at[begin], source[begin], where[begin]
        claims = np.empty(len(at), CLAIM)
        claims["place"], claims["words"] = where, words
        digests: list[bytes] = []
        bound = np.searchsorted(at, [p.word for p in parts] + [1 << 62])
        for part, a, b in zip(parts, bound[:-1], bound[1:]):
            digests += _digests(part, at[a:b] - part.word, words[a:b])
        claims["digest"] = digests
        to = [own]
        covered, packed_claims = [packed(at.astype(np.uint32), words.astype(np.uint32))], [None]
        for group in np.unique(source):
            to.append(int(group))
            covered.append(None)
            packed_claims.append(packed(np.unique(claims[source == group])))
        tidy()
        return pa.table({"to": pa.array(to, pa.int32()), "covered": pa.array(covered, pa.binary()), "claims": pa.array(packed_claims, pa.binary())})

    schema = T.StructType([grouped.schema["__row"], *added])
    span_list = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def remove(key, left, right):
        if not left.num_rows:
            return pa.table([left.column("__row"), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], span_list)], names=["__row", *[f.name for f in added]])
        unique, which = distinct_rows(left)
        mine = [np.frombuffer(x, np.uint32) for x in right.column("covered").to_pylist() if x]
        at = np.concatenate([x[: len(x) // 2] for x in mine]).astype(np.int64) if mine else np.zeros(0, np.int64)
        length = np.concatenate([x[len(x) // 2 :] for x in mine]).astype(np.int64) if mine else np.zeros(0, np.int64)
        claims = np.unique(joined(right.column("claims"), CLAIM))
        columns = []
        for part in _texts(unique):
            n = len(part)
            asked = claims[(claims["place"] >= part.word) & (claims["place"] < part.word + n)]
            found = _digests(part, asked["place"].astype(np.int64) - part.word, asked["words"].astype(np.int64))
            if not np.array_equal(np.array(found, "S16"), asked["digest"]):
                raise ValueError("two windows of different words have one fingerprint: run substring_dedup with another seed")
            inside = (at >= part.word) & (at < part.word + n)
            edge = np.zeros(n + 1, np.int32)
            np.add.at(edge, at[inside] - part.word, 1)
            np.add.at(edge, at[inside] - part.word + length[inside], -1)
            columns.append(_kept(part, np.cumsum(edge[:n]) > 0))
        taken = pa.array(which)
        cols = [pa.concat_arrays([c[i] for c in columns]).take(taken) for i in range(4)]
        tidy()
        return pa.table([left.column("__row"), *cols], names=["__row", *[f.name for f in added]])

    by_group = grouped.groupBy("__group")
    counted = by_group.applyInArrow(name_texts, "range int, group int, names binary, often binary").repartition(1 << bits, "range").groupBy("range").applyInArrow(shared_names, "group int, names binary")
    met = by_group.cogroup(counted.groupBy("group")).applyInArrow(windows, "range int, group int, windows binary").repartition(1 << bits, "range").groupBy("range").applyInArrow(first_windows, "group int, later binary")
    told = by_group.cogroup(met.groupBy("group")).applyInArrow(repeats, "to int, covered binary, claims binary")
    out = by_group.cogroup(told.groupBy("to")).applyInArrow(remove, schema)
    return out.select("__row.*", *[f.name for f in added])


def _kept(part: _Slice, gone: np.ndarray) -> list[pa.Array]:
    """(words, removed words, kept text, removed spans) of each document of a slice."""
    docs = len(part.first) - 1
    owner = np.repeat(np.arange(docs), np.diff(part.first))
    text, bound = plain_words(part.data, part.start[~gone], part.end[~gone])
    # a text ends before the space after its last word
    last = np.searchsorted(owner[~gone], np.arange(docs + 1))
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), docs, [None, pa.py_buffer(bound[last].astype(np.int64)), pa.py_buffer(text)])
    texts = pc.binary_slice(texts, 0, -1).cast(pa.string())
    edge = gone.copy()
    edge[1:] &= ~(gone[:-1] & (owner[1:] == owner[:-1]))
    begin = np.flatnonzero(edge)
    edge = gone.copy()
    edge[:-1] &= ~(gone[1:] & (owner[1:] == owner[:-1]))
    end = np.flatnonzero(edge) + 1
    spans = pa.StructArray.from_arrays([pa.array(begin - part.first[owner[begin]]), pa.array(end - begin)], ["start", "length"])
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[begin], np.arange(docs + 1)).astype(np.int32)), spans)
    return [pa.array(np.diff(part.first)), pa.array(np.bincount(owner[gone], minlength=docs).astype(np.int64)), texts, lists]
