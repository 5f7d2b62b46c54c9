"""Suffix sorting by recursive induction, with common-prefix values, over disk-backed queues.

Suffixes are split into two types by their first letters' order (L: larger than the next suffix, S: smaller). The
leftmost S suffixes are sorted first: their substrings are named in order, and the text of names is sorted by the same
procedure, level by level, until a text of names fits the memory given. All others follow by induction: a scan of what is
sorted so far takes from each suffix the one before it and hands it to the queue of its first letter if it is of type L
(ascending scan), then, in a descending scan, if it is of type S. Letters are visited in order, so the queues together are
a priority queue keyed by (letter, arrival); what they hold beyond a share of the memory lies on disk until its letter is
reached. A queue holds tuples (suffix, common prefix with the one before it in the queue): the prefix value of an induced
suffix is one more than the least value between its source and the source of the entry before it.

Large alphabets (names) share queues: a queue serves a block of letters, and of a block as many letters are handed on
at once as no pending suffix can still be filed among.

Memory: text, types, runs, seeds and names beyond a sixteenth of ``memory`` each are mapped from temporary files of the
task; the sorted L suffixes and pending tuples go to disk as well; arrays in hand hold ``memory`` / 512 suffixes. Only
a number for each different letter or name, and a block's suffixes (a 512th of a level's text), stay in memory.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np

_BIG = np.int32(1 << 30)
#: Bytes that one sort may hold.
MEMORY_BYTES = 64 << 20
#: Queues of one scan: letters beyond that share them.
BLOCKS = 1024

Pairs = tuple[np.ndarray, np.ndarray]


class Work:
    """The memory of one sort."""

    def __init__(self, memory: int = MEMORY_BYTES) -> None:
        self.memory = memory
        self.chunk = max(64, memory // 512)
        #: suffixes that are sorted without queues
        self.direct = max(32, memory // 64)

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory // 16:
            return np.empty(n, dtype)
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.asarray(np.memmap(file, dtype, "r+", shape=(n,)))

    def parts(self, n: int) -> Iterator[tuple[int, int]]:
        for a in range(0, n, self.chunk):
            yield a, min(n, a + self.chunk)


class Queues:
    """First-in first-out queues of pairs of arrays by key, partly in one temporary file."""

    def __init__(self, most: int) -> None:
        self.most, self.held = most, 0
        self.memory: dict[int, list[Pairs]] = defaultdict(list)
        self.sizes: dict[int, int] = defaultdict(int)
        self.disk: dict[int, deque[tuple[int, int, np.dtype, np.dtype]]] = defaultdict(deque)
        self.file = None

    def put(self, key: int, one: np.ndarray, two: np.ndarray) -> None:
        self.memory[key].append((one, two))
        size = one.nbytes + two.nbytes + 256
        self.sizes[key] += size
        self.held += size
        if self.held > self.most:
            for largest in sorted(self.sizes, key=self.sizes.get, reverse=True):
                self._spill(largest)
                if self.held <= self.most // 2:
                    break

    def _spill(self, key: int) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, 2)
        parts = self.memory.pop(key)
        one, two = parts[0] if len(parts) == 1 else tuple(np.concatenate(x) for x in zip(*parts))
        self.file.write(np.ascontiguousarray(one).data)
        self.file.write(np.ascontiguousarray(two).data)
        self.disk[key].append((at, len(one), one.dtype, two.dtype))
        self.held -= self.sizes.pop(key)

    def _read(self, at: int, n: int, one: np.dtype, two: np.dtype, skip: int = 0, most: int | None = None) -> Pairs:
        most = n - skip if most is None else min(most, n - skip)
        self.file.seek(at + skip * one.itemsize)
        a = np.frombuffer(self.file.read(most * one.itemsize), one)
        self.file.seek(at + n * one.itemsize + skip * two.itemsize)
        return a, np.frombuffer(self.file.read(most * two.itemsize), two)

    def empty(self, key: int) -> bool:
        return not self.disk.get(key) and not self.memory.get(key)

    def chunks(self, key: int, most: int) -> Iterator[Pairs]:
        """What the queue of ``key`` holds and gets meanwhile, in order, in pieces of about ``most``; it is empty afterwards."""
        while True:
            if self.disk.get(key):
                record = self.disk[key].popleft()
                for skip in range(0, record[1], most):
                    yield self._read(*record, skip, most)
            elif self.memory.get(key):
                parts = self.memory.pop(key)
                self.held -= self.sizes.pop(key)
                at = 0
                while at < len(parts):
                    end, n = at + 1, len(parts[at][0])
                    while end < len(parts) and n + len(parts[end][0]) <= most:
                        n += len(parts[end][0])
                        end += 1
                    yield parts[at] if end == at + 1 else tuple(np.concatenate(x) for x in zip(*parts[at:end]))
                    at = end
            else:
                return

    def reversed_chunks(self, key: int, most: int) -> Iterator[Pairs]:
        """What the queue holds, last first."""
        for one, two in reversed(self.memory.pop(key, [])):
            yield one[::-1], two[::-1]
        self.held -= self.sizes.pop(key, 0)
        for record in reversed(self.disk.pop(key, ())):
            for skip in range((record[1] - 1) // most * most, -1, -most):
                one, two = self._read(*record, skip, most)
                yield one[::-1], two[::-1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _range_minima(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Minimum of values[begin..end], both included, for each pair."""
    out = np.empty(len(begin), values.dtype)
    if not len(begin):
        return out
    level = np.log2(end - begin + 1).astype(np.int64)
    table, step = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-step], table[step:])
            step *= 2
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[begin[at]], table[end[at] - step + 1])
    return out


class _Scan:
    """One scan over all suffixes of a level: hands on sources in their order and files the suffixes before them."""

    def __init__(self, text: np.ndarray, kind: np.ndarray, run: np.ndarray, bound: np.ndarray, ascending: bool, work: Work) -> None:
        self.text, self.kind, self.run, self.bound, self.ascending, self.work = text, kind, run, bound, ascending, work
        self.own = bound[1:] - bound[:-1] == 1
        self.queues = Queues(work.memory // 4)
        self.least = np.full(int(bound[-1]), -1, np.int32)  # since the last entry of each letter; -1: it had none

    def feed(self, suffix: np.ndarray, prefix: np.ndarray) -> None:
        before = suffix - 1
        ok = np.flatnonzero((suffix > 0) & (self.kind[before] != self.ascending))
        least = prefix.min()
        if not len(ok):
            np.minimum(self.least, least, out=self.least)
            return
        before = before[ok]
        letter = self.text[before]
        order = np.argsort(letter, kind="stable")
        place, letter = ok[order], letter[order]
        first = np.ones(len(order), bool)
        first[1:] = letter[1:] != letter[:-1]
        begin = np.zeros(len(order), np.int64)
        begin[1:][~first[1:]] = place[:-1][~first[1:]] + 1
        value = _range_minima(prefix, begin, place)
        heads = np.flatnonzero(first)
        value[heads] = np.minimum(value[heads], self.least[letter[heads]])
        tails = np.append(heads[1:], len(order)) - 1
        np.minimum(self.least, least, out=self.least)
        rest = np.minimum.accumulate(prefix[::-1])[::-1]  # least from each place to the end
        after = place[tails] + 1
        self.least[letter[tails]] = np.where(after < len(prefix), rest[np.minimum(after, len(prefix) - 1)], _BIG)
        value += 1
        before = before[order]
        block = np.searchsorted(self.bound, letter[heads], side="right") - 1
        new = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        cut = np.append(heads[new], len(order)).tolist()
        for k, a, b in zip(block[new].tolist(), cut[:-1], cut[1:]):
            self.queues.put(k, before[a:b], value[a:b])

    def block(self, b: int, others: Iterator[Pairs]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | bool]]:
        """(suffixes, prefix values, which are induced) of the block's letters in scan order; ``others``: the given ones."""
        if self.own[b]:
            last = None
            for suffix, value in self.queues.chunks(b, self.work.chunk):
                last = suffix[-1]
                yield suffix, value, True
                self.feed(suffix, value)
            first = True
            for suffix, value in others:
                value = value.copy()
                if first:
                    # an induced and a given suffix of one letter share the shorter of their runs
                    value[0] = 0 if last is None else min(self.run[last], self.run[suffix[0]])
                    first = False
                yield suffix, value, False
                self.feed(suffix, value)
            return
        given = [*others]
        if not given and self.queues.empty(b):
            return
        low, high = self.bound[b], self.bound[b + 1]
        parts = [*self.queues.chunks(b, 1 << 40)]
        n = sum(len(p[0]) for p in parts)
        suffix, value = (np.concatenate(x) for x in zip(*parts, *given))
        induced = np.arange(len(suffix)) < n
        last, last_letter = -1, -1
        while len(suffix):
            letter = self.text[suffix].astype(np.int64)
            order = np.lexsort((~induced, letter if self.ascending else -letter))
            suffix, value, induced, letter = suffix[order], value[order], induced[order], letter[order]
            before = suffix - 1
            target = self.text[before].astype(np.int64)
            inside = (suffix > 0) & (self.kind[before] != self.ascending) & (target >= low) & (target < high)
            ready = len(suffix)
            if inside.any():
                stop = target[inside].min() if self.ascending else target[inside].max()
                ready = int(np.count_nonzero(letter < stop if self.ascending else letter > stop))
                ready = ready or int(np.count_nonzero((letter == stop) & induced))
            now, share, mine, own = suffix[:ready], value[:ready].copy(), induced[:ready], letter[:ready]
            previous = np.append(last, now[:-1])
            same = np.append(last_letter, own[:-1]) == own
            seam = np.flatnonzero(~mine & ~(same & ~np.append(True, mine[:-1])))  # the first given one of its letter
            share[seam] = np.where(same[seam], np.minimum(self.run[previous[seam]], self.run[now[seam]]), 0)
            yield now, share, mine
            self.feed(now, share)
            last, last_letter = now[-1], own[-1]
            fresh = [*self.queues.chunks(b, 1 << 40)]
            suffix, value = (np.concatenate(x) for x in zip((suffix[ready:], value[ready:]), *fresh))
            induced = np.append(induced[ready:], np.ones(len(suffix) - len(induced) + ready, bool))


def _types(text: np.ndarray, work: Work) -> Pairs:
    """(True for type S, length of the run of one letter that starts at each place), from the end on."""
    n = len(text)
    kind, run = work.array(n, bool), work.array(n, np.int32)
    for a, b in reversed([*work.parts(n)]):
        part = np.asarray(text[a:b])
        new = np.ones(b - a, bool)
        new[1:] = part[1:] != part[:-1]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], b - a)
        length = end - begin
        rises = np.zeros(len(begin), bool)
        rises[:-1] = part[end[:-1]] > part[begin[:-1]]
        more = 0
        if b == n:
            rises[-1] = True  # the end mark
        elif text[b] == part[-1]:
            rises[-1], more = kind[b], int(run[b])
        else:
            rises[-1] = text[b] > part[-1]
        left = np.repeat(end, length) - np.arange(b - a)
        left[begin[-1] :] += more
        kind[a:b], run[a:b] = np.repeat(rises, length), left
    return kind, run


def _blocks(text: np.ndarray, letters: int, work: Work) -> np.ndarray:
    """First letters of blocks, one more at the end: single letters, or neighbours that are rare together."""
    if letters <= BLOCKS:
        return np.arange(letters + 1)
    counts = np.zeros(letters, np.int64)
    for a, b in work.parts(len(text)):
        counts += np.bincount(text[a:b], minlength=letters)
    target = max(1, len(text) // BLOCKS)
    share = (np.cumsum(counts) - counts) // target
    starts = np.flatnonzero(np.append(True, share[1:] != share[:-1]))
    large = np.flatnonzero(counts > target)
    return np.unique(np.concatenate([starts, large, large + 1, [letters]]))


def _names(text: np.ndarray, kind: np.ndarray, at: np.ndarray, letters: int, work: Work) -> tuple[np.ndarray, int]:
    """(order-keeping name from 1 of the substring from each place of ``at`` to the next one, different names).

    Letters count with their types, so no substring is the beginning of another one.
    """
    m = len(at)
    bits = (2 * letters + 1).bit_length()
    step = max(1, 62 // bits)
    out = work.array(m, np.int32)
    last = 0

    def keys(index: np.ndarray, column: int) -> np.ndarray:
        begin = at[index].astype(np.int64) + column
        end = np.where(index + 1 < m, at[np.minimum(index + 1, m - 1)], len(text) - 1)
        key = np.zeros(len(index), np.int64)
        for k in range(step):
            key <<= bits
            inside = np.flatnonzero(begin + k <= end)
            p = begin[inside] + k
            key[inside] |= text[p].astype(np.int64) * 2 + 1 + kind[p]
        return key

    def small(index: np.ndarray, column: int) -> None:
        nonlocal last
        rank = np.zeros(len(index), np.int64)
        todo = np.arange(len(index))
        while len(todo):
            key = keys(index[todo], column)
            order = np.lexsort((key, rank[todo]))
            todo, key = todo[order], key[order]
            own = rank[todo]
            group = np.ones(len(todo), bool)
            group[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
            begin = np.flatnonzero(group)
            size = np.diff(np.append(begin, len(todo)))
            same = np.append(True, own[1:] != own[:-1])
            base = np.maximum.accumulate(np.where(same, np.arange(len(todo)), 0))
            rank[todo] = own + np.repeat(begin, size) - base
            # a name is settled once it is single or its substrings have ended
            open_ = np.repeat(size > 1, size) & (key & ((1 << bits) - 1) > 0)
            todo, column = todo[open_], column + step
        values, place = np.unique(rank, return_inverse=True)
        out[index] = place + last + 1
        last += len(values)

    def large(chunks, count: int, column: int) -> None:
        nonlocal last
        if count <= work.direct:
            small(np.concatenate([*chunks()]), column)
            return
        sample = np.concatenate([keys(c[:: max(1, len(c) // 64)], column) for c in chunks()])
        pivots = np.unique(np.sort(sample)[:: max(1, len(sample) // 256)])
        queues, sizes = Queues(work.memory // 8), defaultdict(int)
        for c in chunks():
            key = keys(c, column)
            bucket = np.searchsorted(pivots, key, "left") + np.searchsorted(pivots, key, "right")  # odd: equals a pivot
            order = np.argsort(bucket, kind="stable")
            c, bucket, key = c[order], bucket[order], key[order]
            begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for k, a, b in zip(bucket[begin].tolist(), begin.tolist(), np.append(begin[1:], len(c)).tolist()):
                queues.put(k, c[a:b], key[a:b])
                sizes[k] += b - a
        for k in sorted(sizes):
            if k % 2 and not pivots[k // 2] & ((1 << bits) - 1):  # ended: all alike
                last += 1
                for c, _ in queues.chunks(k, work.chunk):
                    out[c] = last
                continue
            again = Queues(work.memory // 8)
            for c, key in queues.chunks(k, work.chunk):
                again.put(0, c, key)
            large(lambda q=again: _peek(q, work.chunk), sizes[k], column + step if k % 2 else column)
            again.close()
        queues.close()

    large(lambda: (np.arange(a, b) for a, b in work.parts(m)), m, 0)
    return out, last


def _peek(queues: Queues, most: int) -> Iterator[np.ndarray]:
    """First arrays of the one queue, which stays as it is."""
    for record in queues.disk[0]:
        for skip in range(0, record[1], most):
            yield queues._read(*record, skip, most)[0]
    for one, _ in queues.memory[0]:
        yield one


def _ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
    """(rank of each key from 1, different keys)."""
    order = np.argsort(key)
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = up = np.cumsum(new)
    return rank, int(up[-1]) if len(up) else 0


def _sorted_directly(names: np.ndarray, distinct: int, where: np.ndarray, depth: int) -> Pairs:
    """(order of the suffixes of ``names``, names that each shares with the one before it) in memory, by doubling."""
    m = len(names)
    rank = names.astype(np.int64)
    ranks, step = [rank], 1
    while distinct < m and step < m:
        reach = where[np.minimum(np.arange(m) + step, m)] - where[:m]
        if (reach[: m - step] >= depth).all():
            break
        following = np.zeros(m, np.int64)
        following[: m - step] = rank[step:]
        rank, distinct = _ranked(rank * (m + 1) + following)
        ranks.append(rank)
        step *= 2
    order = np.argsort(rank, kind="stable")
    # skip equal names from the longest step down
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        ok = (a < m) & (b < m)
        same = np.zeros(len(a), bool)
        same[ok] = ranks[k][a[ok]] == ranks[k][b[ok]]
        a[same] += 1 << k
        b[same] += 1 << k
        np.minimum(a, m, out=a)
        np.minimum(b, m, out=b)
    return order, np.append(0, a - order[:-1])


def _leftmost(text: np.ndarray, kind: np.ndarray, at: np.ndarray, letters: int, depth: int, work: Work) -> Pairs:
    """The leftmost S suffixes ``at`` in order, each with the letters it shares with the one before it."""
    m, n = len(at), len(text)
    names, distinct = _names(text, kind, at, letters, work)
    order, share = work.array(m, np.int32), work.array(m, np.int32)
    if distinct == m:
        for a, b in work.parts(m):
            order[names[a:b] - 1] = np.arange(a, b)
        share[:] = 0
    elif m <= work.direct:
        order[:], share[:] = _sorted_directly(np.asarray(names), distinct, np.append(at, n), depth)
    else:
        reduced = work.array(m + 1, np.int32)
        reduced[:m], reduced[m] = names, 0
        del names
        end = m
        for suffix, value in suffix_array(reduced, distinct + 1, depth // 2 + 1, work):
            order[end - len(suffix) : end] = suffix[::-1]
            share[end - len(suffix) + 1 : end + 1] = value[::-1][: m - end + len(suffix) - 1]
            end -= len(suffix)
        share[0] = 0
    # letters: those of the shared names, then one by one
    seeds, shared = work.array(m, np.int32), work.array(m, np.int32)
    shared[0] = 0
    for a, b in work.parts(m):
        seeds[a:b] = at[order[a:b]]
    for a, b in work.parts(m - 1):
        before, own = np.asarray(order[a:b]), np.asarray(order[a + 1 : b + 1])
        step = np.asarray(share[a + 1 : b + 1]).astype(np.int64)
        reach = lambda i: np.where(i < m, at[np.minimum(i, m - 1)], n)
        x, y = reach(before + step).astype(np.int64), reach(own + step).astype(np.int64)
        letters_ = x - at[before]
        todo = np.flatnonzero((x < n) & (y < n) & (letters_ < depth))
        while len(todo):
            todo = todo[text[x[todo]] == text[y[todo]]]
            x[todo] += 1
            y[todo] += 1
            letters_[todo] += 1
            todo = todo[(x[todo] < n) & (y[todo] < n) & (letters_[todo] < depth)]
        shared[a + 1 : b + 1] = letters_
    return seeds, shared


def suffix_array(text: np.ndarray, letters: int, depth: int, work: Work) -> Iterator[Pairs]:
    """Yields (suffixes, prefix values) of ``text``, the largest suffix first; the end mark's own suffix is left out.

    ``text``: numbers from 1 below ``letters``, with a 0 at the end. A value is what a suffix shares with the one before it
    (the next larger one), exact below ``depth``; suffixes that agree in ``depth`` letters may come in any order.
    """
    n = len(text)
    if n == 1:
        return
    kind, run = _types(text, work)
    found, carried = [], False
    for a, b in work.parts(n):
        part = np.asarray(kind[a:b])
        before = np.append(carried or a == 0, part[:-1])
        found.append((np.flatnonzero(part & ~before) + a).astype(np.int32))
        carried = bool(part[-1])
    at = work.array(sum(map(len, found)), np.int32)
    np.concatenate(found, out=at)
    del found
    seeds, shared = _leftmost(text, kind, at, letters, depth, work)
    del at
    bound = _blocks(text, letters, work)
    sizes = np.zeros(len(bound) - 1, np.int64)
    for a, b in work.parts(len(seeds)):
        sizes += np.bincount(np.searchsorted(bound, text[seeds[a:b]], side="right") - 1, minlength=len(sizes))
    starts = np.append(0, np.cumsum(sizes)).tolist()

    def seeds_of(b: int) -> Iterator[Pairs]:
        for i in range(starts[b], starts[b + 1], work.chunk):
            j = min(starts[b + 1], i + work.chunk)
            yield np.asarray(seeds[i:j]), np.asarray(shared[i:j])

    lower = Queues(work.memory // 8)

    def lower_of(b: int) -> Iterator[Pairs]:
        after = 0  # what the last one shares with the one after it, as the scan descends
        for suffix, value in lower.reversed_chunks(b, work.chunk):
            yield suffix, np.append(np.int32(after), value[:-1])
            after = value[-1]

    up = _Scan(text, kind, run, bound, True, work)
    down = _Scan(text, kind, run, bound, False, work)
    try:
        for b in range(len(bound) - 1):
            for suffix, value, induced in up.block(b, seeds_of(b)):
                if induced is True:
                    lower.put(b, suffix, value)
                elif induced is not False and induced.any():
                    lower.put(b, suffix[induced], value[induced])
        up.queues.close()
        for b in range(len(bound) - 2, -1, -1):
            for suffix, value, _ in down.block(b, lower_of(b)):
                yield suffix, value
    finally:
        for queues in (up.queues, down.queues, lower):
            queues.close()


def byte_suffixes(data: np.ndarray, depth: int, memory: int = MEMORY_BYTES) -> Iterator[Pairs]:
    """``suffix_array`` of bytes."""
    work = Work(memory)
    text = work.array(len(data) + 1, np.int16)
    for a, b in work.parts(len(data)):
        text[a:b] = data[a:b]
        text[a:b] += 1
    text[len(data)] = 0
    return suffix_array(text, 257, depth, work)


def repeated(data: np.ndarray, width: int, memory: int = MEMORY_BYTES) -> np.ndarray:
    """For each place whether the ``width`` letters from it on also start somewhere else."""
    out = np.zeros(len(data) + 1, bool)
    last = len(data)
    for suffix, value in byte_suffixes(data, width, memory):
        hit = np.flatnonzero(value >= width)
        out[suffix[hit]] = True
        out[np.append(last, suffix[:-1])[hit]] = True
        last = suffix[-1]
    return out[:-1]
