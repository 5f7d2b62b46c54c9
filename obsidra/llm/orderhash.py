"""MinHash near-dedup: order MinHash over word shingles, candidates verified by banded alignment.

A sketch takes the ``tuple_size`` smallest of a text's occurrence-labelled shingles (word 5-grams; the n-th occurrence
of a shingle is a shingle of its own) under one hash order and keeps them in the order of the text; so equal sketches
ask for equal content in equal order. Each of ``sketches`` sketches is a bucket key, and so is each pair of neighbouring
sketches. Copies of a text count as one. A candidate pair is linked when the banded edit distance of the two word
sequences is at most (1 - similarity) * the longer length. The band is exactly as wide as that bound, so the
verification is exact. Classes are connected components of the links.

Two rounds decide every pair of every bucket. (1) All members of a bucket meet its smallest one (the hub). (2) Where the
members of a bucket fell into several components, each two of different ones that lengths and bags allow are compared, in
blocks that hold a text once, until links join them. A bag counts a text's words by hash; one edit moves one word of each
bag, so what bags rule out is never similar. A pair of several buckets is compared in that of its first equal sketch
(pairs of sketches only elect more hubs: who shares one shares both sketches).

Defined cases: texts with equal word sequences (null and empty ones too: no words) are one class; a text with fewer
than five words has itself as its one shingle, so only copies match; ties of ids go to the text hash; a null id is
smaller than all; repeated rows get one row each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mixed, rolling, row_struct, slices, staged, text_buffers, tidy, word_hashes
from .components import components

SHINGLE, TUPLE, SKETCHES, SIMILARITY = 5, 2, 16, 0.8
#: Columns to either side in the first band tried, and words up to which a text's words have a bit mask each.
BAND, SHORT_WORDS = 64, 8192
#: Members of one hub that are verified in one group.
GROUP_MEMBERS = 64
#: Bins of a text's bag of words.
BAG = 64
#: Members of one bucket in a block; larger buckets are compared block by block.
BLOCK_MEMBERS = 1024
BLOCK_COLUMNS = ["key", "low", "high", "place", "id", "mark", "component", "partners"]
#: Rows about large hubs, or about classes, that are broadcast at most; more are joined by shuffling.
BROADCAST_HUBS = 100_000


def order_sketches(h: np.ndarray, first: np.ndarray, shingle: int = SHINGLE, tuple_size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """(texts, sketches) order-MinHash values of texts with word hashes ``h``; a text without words gets zeros."""
    n = len(first) - 1
    out = np.zeros((n, sketches), np.uint64)
    counts = np.diff(first)
    grams = np.maximum(counts - shingle + 1, np.minimum(counts, 1))  # a short text is one shingle
    has = np.flatnonzero(grams)
    if not len(has):
        return out
    whole = np.repeat(np.arange(n), counts)
    at = np.concatenate([np.arange(first[i], first[i] + grams[i]) for i in has]) if len(has) < 64 else _ranges(first[:-1][has], grams[has])
    owner = np.repeat(has, grams[has])
    base = np.zeros(len(at), np.uint64)
    full = counts[owner] >= shingle
    base[full] = rolling(h, shingle, 0x9E6D62D06F6A9A9B)[at[full]]
    for i in has[counts[has] < shingle]:
        base[np.searchsorted(owner, i)] = mixed(np.bitwise_xor.reduce(mixed(h[first[i] : first[i + 1]] + np.arange(counts[i], dtype=np.uint64))))[0]
    # occurrence labels: rank among equal shingles of the text, in order of the text
    order = np.lexsort((base, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (base[order][1:] == base[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    # every shingle is mixed with its label, whether its slice of texts holds repetitions or not
    place = np.arange(len(order))
    label = np.empty(len(order), np.uint64)
    label[order] = (place - np.maximum.accumulate(np.where(again, 0, place))).astype(np.uint64)
    base = mixed(base + label * np.uint64(0xD6E8FEB86659FD93))
    begin = np.append(0, np.cumsum(grams[has]))[:-1]
    rank = np.repeat(np.arange(len(has)), grams[has])
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for s in range(sketches):
        x = mixed(base ^ mixed(np.uint64(s + 1)))
        picked, places = [], []
        for _ in range(tuple_size):
            least = np.minimum.reduceat(x, begin)
            hit = np.flatnonzero(x == least[rank])
            # the first place of each text's minimum; a text with fewer shingles than tuple_size gives `top` again
            one = hit[np.unique(rank[hit], return_index=True)[1]]
            picked.append(least)
            places.append(at[one])
            x[one] = top
        picked, places = np.stack(picked, 1), np.stack(places, 1)
        turn = np.argsort(places, axis=1, kind="stable")
        picked = np.take_along_axis(picked, turn, 1)
        value = np.full(len(has), np.uint64(s + 1))
        for k in range(tuple_size):
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + picked[:, k])
        out[has, s] = value
    return out


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.arange(int(length.sum())) + np.repeat(begin - (ends - length), length)


def within(a: list, b: list, most: int) -> bool:
    """Whether the edit distance of two sequences is at most ``most``: bit-parallel in bands, each wider than the one before."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    # a common start or end changes no distance
    i, stop = 0, len(b)
    while i < stop and a[i] == b[i]:
        i += 1
    j = 0
    while j < stop - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not b or most == 0:
        return len(a) <= most
    if len(a) > len(b) + most:
        return False
    band = max(BAND, len(a) - len(b))
    while band * 4 < most:  # few edits need no wide band
        if _banded(a, b, band):
            return True
        band *= 8
    return _banded(a, b, most)


def _banded(a: list, b: list, most: int) -> bool:
    """``within`` over a band of 2 * most + 1 columns; memory follows the texts' length and the band, not their product."""
    # columns: a; rows: b. Bit k of a row stands for the column (row - most + k).
    width = 2 * most + 1
    mask = (1 << width) - 1
    columns = _Columns(a, most)
    # vertical differences of row 0: the columns from 0 on rise by one
    up, down = (mask << most) & mask, 0
    distance, m = most, len(a)
    high, limit = 1 << (width - 1), most
    for row, x in enumerate(b):
        eq = columns.equal(x, row)
        zero = (((((eq & up) + up) ^ up) | eq | down)) & mask
        plus, minus = (down | ~(zero | up)) & mask, zero & up
        if row + most < m:  # the band's last column moves on
            distance += not zero & high
        else:
            high_here = 1 << (width - 1 - (row + most - m + 1))
            distance += bool(plus & high_here)
            distance -= bool(minus & high_here)
        half = zero >> 1
        up, down = (minus | ~(half | plus)) & mask, half & plus
    return distance <= limit


class _Columns:
    """Where a sequence has a value, as bits of the band around a row."""

    def __init__(self, a: list, most: int) -> None:
        self.most, self.width = most, 2 * most + 1
        self.mask = (1 << self.width) - 1
        self.short = len(a) <= SHORT_WORDS
        self.bits: dict = {}
        if self.short:  # one number a value: at most SHORT_WORDS**2 bits in all
            for k, x in enumerate(a):
                self.bits[x] = self.bits.get(x, 0) | 1 << k
            return
        number = np.fromiter((self.bits.setdefault(x, len(self.bits)) for x in a), np.int32, len(a))
        self.places = np.argsort(number, kind="stable").astype(np.int32)
        self.bound = np.append(0, np.cumsum(np.bincount(number))).tolist()

    def equal(self, x, row: int) -> int:
        shift = row - self.most
        if self.short:
            eq = self.bits.get(x, 0)
            return (eq >> shift if shift >= 0 else eq << -shift) & self.mask
        at = self.bits.get(x)
        if at is None:
            return 0
        begin, end = self.bound[at], self.bound[at + 1]
        own = self.places[begin:end]
        if end - begin > 8:
            own = own[np.searchsorted(own, shift) : np.searchsorted(own, shift + self.width)]
        if len(own) <= 8:
            return sum(1 << k - shift for k in own.tolist() if 0 <= k - shift < self.width)
        bits = np.zeros(self.width, np.uint8)
        bits[own - shift] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def similar(a: list, b: list, similarity: float = SIMILARITY) -> bool:
    return within(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9))


def bags(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, BAG) words of each text by hash, 255 at most; a cut count only lowers differences."""
    n = len(first) - 1
    at = np.repeat(np.arange(n), np.diff(first)) * BAG + (h[first[0] : first[-1]] % np.uint64(BAG)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * BAG), 255).astype(np.uint8).reshape(n, BAG)


def least_distances(bag: np.ndarray, others: np.ndarray) -> np.ndarray:
    """What the edit distances of a text and others are at least, by their bags."""
    step = others.astype(np.int16) - bag.astype(np.int16)
    return np.maximum(np.maximum(step, 0).sum(axis=1), np.maximum(-step, 0).sum(axis=1))


class SharedWords:
    """How many words texts share, as multisets: no two texts with fewer than that can be within a distance.

    ``h``: word hashes of consecutive texts, ``first``: each text's first word. Equal hashes of different words only raise a number.
    """

    def __init__(self, h: np.ndarray, first: np.ndarray) -> None:
        self.first, self.length = first, np.diff(first)
        owner = np.repeat(np.arange(len(self.length)), self.length)
        order = np.lexsort((h, owner))
        h = h[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        place = np.arange(len(h))
        nth = place - np.maximum.accumulate(np.where(again, 0, place))
        self.number = np.unique(mixed(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True)[1]
        by = np.argsort(self.number, kind="stable")
        self.holders = owner[by]
        self.begin = np.searchsorted(self.number[by], np.arange(int(self.number.max(initial=-1)) + 2))

    def of(self, i: int) -> np.ndarray:
        """Words that text ``i`` shares with each text."""
        own = self.number[self.first[i] : self.first[i + 1]]
        return np.bincount(self.holders[_ranges(self.begin[own], self.begin[own + 1] - self.begin[own])], minlength=len(self.length))

    def near(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` that the words shared with text ``i`` don't rule out."""
        longer = np.maximum(self.length[i], self.length[others])
        return others[longer - self.of(i)[others] <= ((1 - similarity) * longer + 1e-9).astype(np.int64)]


def sketch_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, words, sketches, bag) of every row; mark: 128-bit digest of the words' bytes."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                own = data[part[0] : part[-1]]
                h, first = word_hashes(own, part - part[0])
                found = order_sketches(h, first)
                held = bags(h, first)
                marks = _marks(own, part - part[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(marks, pa.binary()), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * SKETCHES), pa.array(found.view(np.int64).ravel())), pa.array([b.tobytes() for b in held], pa.binary())],
                    ["id", "mark", "words", "sketches", "bag"],
                )
        tidy()

    return rows.mapInArrow(run, "id long, mark binary, words long, sketches array<long>, bag binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: id, class_id (the smallest id of its class), class_rows, kept (the class's one).

    ``kept`` holds for one id of each class; rows that repeat that id and text are all marked, they are one document.
    """
    rows, labelled = _classes(docs, id_col, text_col, similarity)
    return rows.join(labelled, "mark").select(
        F.col("id").alias(id_col), "class_id", "class_rows", (F.col("id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("head"))).alias("kept")
    )


def _classes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(rows with id and mark; different texts with mark, class_id, head and class_rows)."""
    rows = staged(sketch_table(docs, id_col, text_col), "sketches")
    # copies count once; the smallest id stands for them
    texts = rows.groupBy("mark").agg(F.min(F.struct(F.col("id"), F.col("words"))).alias("least"), F.count(F.lit(1)).alias("copies"), F.first("sketches").alias("sketches"), F.first("bag").alias("bag")).select(F.col("least.id").alias("id"), "mark", F.col("least.words").alias("words"), "copies", "sketches", "bag")
    keys = F.expr(
        f"flatten(transform(sequence(0, {SKETCHES - 1}), i -> array(xxhash64(i, sketches[i]), xxhash64(i, sketches[i], sketches[(i + 1) % {SKETCHES}]))))"
    )
    bucketed = texts.where("words > 0").select("id", "mark", "words", F.posexplode(keys).alias("at", "key"))
    hubs = bucketed.groupBy("key").agg(F.min(F.struct("id", "mark", "words")).alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = staged(bucketed.join(hubs, "key").where("mark != hub.mark"), "met")
    # lengths too far apart can't be similar
    pairs = staged(
        met.where(f"least(words, hub.words) >= {similarity} * greatest(words, hub.words) - 1e-6")
        .select("id", "mark", F.col("hub.id").alias("hub_id"), F.col("hub.mark").alias("hub"))
        .distinct(),
        "pairs",
        small=True,
    )
    links = staged(_verified(docs, pairs, id_col, text_col, similarity), "links")
    found = components(links.select(F.col("mark").alias("a"), F.col("hub").alias("b")))
    # the hub has met them all; every second key is of one sketch
    others = met.where("n > 2 and at % 2 = 0").select("key", F.expr("cast(at / 2 as int)").alias("sketch"), "id", "mark", "words")
    undecided = staged(_undecided(others, texts.select("mark", "sketches", "bag"), found, similarity), "undecided")
    if not undecided.isEmpty():
        links = links.unionByName(staged(_compared(docs, undecided, id_col, text_col, similarity), "links"))
        found = components(links.select(F.col("mark").alias("a"), F.col("hub").alias("b")))
    linked = texts.select("id", "mark", "copies").join(found, F.col("mark") == F.col("node")).select("id", "mark", "copies", "component")
    heads = linked.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("head"), F.sum("copies").alias("rows"))
    heads = F.broadcast(heads) if heads.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else heads
    members = linked.join(heads, "component").select("mark", "head", "rows")
    labelled = texts.select("id", "mark", "copies").join(members, "mark", "left").withColumn("head", F.coalesce("head", F.struct("id", "mark")))
    return rows, labelled.select("mark", F.col("head.id").alias("class_id"), F.col("head.mark").alias("head"), F.coalesce("rows", "copies").alias("class_rows"))


def _undecided(others: DataFrame, held: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """Rows (key, low, high, place, id, mark, component, partners) of the members of a block (key, low, high) with pairs to compare.

    ``partners``: places (packed int32) of smaller place in another component that lengths and bags don't rule out.
    """
    placed = others.join(found, F.col("mark") == F.col("node"), "left").select("key", "sketch", "id", "mark", "words", F.coalesce("component", "mark").alias("component"))
    split = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.ceil(F.count(F.lit(1)) / BLOCK_MEMBERS).cast("int").alias("parts")).where("least < most").select("key", "parts")
    members = placed.join(split, "key").join(held, "mark").withColumn("own", F.pmod(F.xxhash64("mark", "key"), F.col("parts")).cast("int"))
    # every two parts of a bucket meet once
    met = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = met.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "sketch", "id", "mark", "words", "component", "sketches", "bag")

    def choose(key, table):
        table = table.sort_by("words")
        words, own = (table.column(c).to_numpy() for c in ("words", "own"))
        number: dict[bytes, int] = {}
        component = np.array([number.setdefault(c, len(number)) for c in table.column("component").to_pylist()])
        bag = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(-1, BAG)
        sketch = table.column("sketch")[0].as_py()
        earlier = table.column("sketches").combine_chunks().flatten().to_numpy().reshape(-1, SKETCHES)[:, :sketch]
        most = ((1 - similarity) * words + 1e-9).astype(np.int64)
        begin = np.searchsorted(words, words - most)  # shorter ones are too short for this one
        partners, used = [], np.zeros(len(words), bool)
        for i, a in enumerate(begin.tolist()):
            near = a + np.flatnonzero((component[a:i] != component[i]) & ((own[a:i] != own[i]) | (key[1] == key[2])))
            near = near[~(earlier[near] == earlier[i]).any(axis=1)]
            near = near[least_distances(bag[i], bag[near]) <= most[i]]
            used[near] = True
            used[i] |= len(near) > 0
            partners.append(near.astype(np.int32).tobytes())
        at = np.flatnonzero(used)
        few = table.select(["key", "low", "high", "id", "mark", "component"]).take(pa.array(at))
        return few.append_column("place", pa.array(at)).append_column("partners", pa.array([partners[i] for i in at], pa.binary())).select(BLOCK_COLUMNS)

    schema = "key long, low int, high int, place long, id long, mark binary, component binary, partners binary"
    return blocks.groupBy("key", "low", "high").applyInArrow(lambda key, table: choose([k.as_py() for k in key], table), schema)


def _compared(docs: DataFrame, undecided: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """Links (mark, hub) that join the components of each block as far as its undecided pairs are similar."""
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    joined = texts.join(undecided.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("id"))).select(*[c for c in BLOCK_COLUMNS if c != "id"], "__text")

    def compare(table):
        data, offsets = text_buffers(table.column("__text"))
        marks, places, component, partners = (table.column(c).to_pylist() for c in ("mark", "place", "component", "partners"))
        # an id may stand for several texts: only the row with the digest asked for counts
        rows = {places[r]: r for r, mark in enumerate(_marks(data, offsets)) if marks[r] == mark}
        words = lambda r: data[offsets[r] : offsets[r + 1]].tobytes().split()
        parent: dict[bytes, bytes] = {}

        def top(c):
            while parent.setdefault(c, c) != c:
                parent[c] = c = parent[parent[c]]
            return c

        good = []
        shared = SharedWords(*word_hashes(data, offsets))
        for r in rows.values():
            mine = None
            met = [p for place in np.frombuffer(partners[r], np.int32).tolist() if (p := rows.get(place)) is not None]
            if not met:
                continue
            for p in shared.near(r, np.array(met), similarity).tolist():
                if (a := top(component[r])) == (b := top(component[p])):
                    continue
                mine = mine or words(r)
                if similar(mine, words(p), similarity):
                    parent[a] = b
                    good.append((marks[r], marks[p]))
        tidy(len(data))
        return pa.table({"mark": pa.array([a for a, _ in good], pa.binary()), "hub": pa.array([b for _, b in good], pa.binary())})

    return joined.groupBy("key", "low", "high").applyInArrow(compare, "mark binary, hub binary")


def _verified(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """The ``pairs`` (id, mark, hub_id, hub) whose texts are similar.

    Members of a hub meet it in groups of about GROUP_MEMBERS; the hub's text goes to each group once.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    # only hubs with more members than a group holds are cut; there is at most one of them in GROUP_MEMBERS pairs
    large = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / GROUP_MEMBERS).cast("int").alias("parts")).where("parts > 1")
    large = F.broadcast(large) if large.limit(BROADCAST_HUBS + 1).count() <= BROADCAST_HUBS else large
    part = F.pmod(F.xxhash64("mark"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(large, "hub", "left").withColumn("part", part).drop("parts")
    members = dealt.select("id", "mark", "hub", "part", F.lit(False).alias("is_hub"))
    heads = dealt.select(F.col("hub_id").alias("id"), F.col("hub").alias("mark"), "hub", "part", F.lit(True).alias("is_hub")).distinct()
    wanted = members.unionByName(heads)
    joined = texts.join(wanted.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("id"))).select("hub", "part", "mark", "is_hub", "__text")

    def verify(key, table):
        data, offsets = text_buffers(table.column("__text"))
        marks = table.column("mark").to_pylist()
        # an id may stand for several texts: only the row with the digest asked for counts
        mine = [marks[r] == mark for r, mark in enumerate(_marks(data, offsets))]
        words = lambda r: data[offsets[r] : offsets[r + 1]].tobytes().split()
        hub = key[0].as_py()
        head = next((words(r) for r in range(len(marks)) if mine[r] and marks[r] == hub), None)
        rows = {marks[r]: r for r in range(len(marks)) if mine[r] and marks[r] != hub}
        good = [mark for mark, r in rows.items() if head is not None and similar(words(r), head, similarity)]
        tidy(len(data))
        return pa.table({"mark": pa.array(good, pa.binary()), "hub": pa.array([hub] * len(good), pa.binary())})

    return joined.groupBy("hub", "part").applyInArrow(verify, "mark binary, hub binary")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each class (its smallest id); of rows that repeat id and words one stays."""
    heads = _classes(docs, id_col, text_col, similarity)[1].where("mark = head").select(F.col("class_id").alias("__head"), F.col("head").alias("__hmark"))
    marked = with_mark(docs, text_col)
    joined = marked.join(heads, (F.col("__mark") == F.col("__hmark")) & F.col(id_col).cast("long").eqNullSafe(F.col("__head")))
    first = F.row_number().over(Window.partitionBy("__mark").orderBy(F.col(id_col)))
    return joined.withColumn("__nth", first).where("__nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def with_mark(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with __mark, the digest of the word sequence."""
    rows = docs.select(row_struct(docs).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([rows.schema["__row"], T.StructField("__mark", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("__text"))
            for i, j in slices(offsets):
                part = offsets[i : j + 1]
                marks = _marks(data[part[0] : part[-1]], part - part[0])
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(i, j - i), pa.array(marks, pa.binary())], ["__row", "__mark"])

    return rows.mapInArrow(run, schema).select("__row.*", "__mark")


def _marks(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """128-bit digests of the word sequences: of the words' own bytes, so different texts have different ones."""
    return [hashlib.blake2b(b" ".join(data[a:b].tobytes().split()), digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
