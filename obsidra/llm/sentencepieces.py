"""SentencePiece encoding and decoding: shared-prefix Viterbi over the trie of distinct marked words.

A text gets the word mark in front and for every space, and is cut into marked words: marks, then characters that occur
in pieces; other characters stand alone and become their bytes. The distinct words of a batch are sorted, which lists
the leaves of their trie in depth-first order: the forward states of a word's prefix that it shares with the word before
stay on a stack, only the rest is computed.

Forward states. For a unigram model: the best sum of piece scores of a prefix and its last piece (Viterbi). For a BPE
model the lawful segmentation of a prefix is unique, and a segmentation is lawful exactly when every two neighbouring
pieces are (merging the two pieces' text gives them back); so the state is the one last piece that lawfully follows the
state before it. The ids equal those of the model's own merging order.

Defined cases: null and empty texts give no ids and decode to the empty text; the mark character itself counts as a
space; repeated rows get equal results; other columns pass, those with result names are replaced; an empty table gives
an empty result. A decoded byte run that isn't UTF-8 gives U+FFFD.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_struct, slices, text_buffers, tidy, worker_cache

MARK = "▁"
#: Kinds of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Distinct words kept between batches of a task, and decided pairs of pieces kept between tasks.
CACHE_WORDS, CACHE_PAIRS = 300_000, 400_000
#: Bytes of text that are cut into words at once (a longer text goes alone).
PART_BYTES = 256 << 10


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    """Pieces with scores and kinds; ``merges``: a BPE model (else unigram)."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    merges: bool
    prefix: bool = True
    ids: dict[str, int] = field(default_factory=dict)
    bytes_: list[int] = field(default_factory=list)
    unknown: int = 0
    digest: str = ""

    def __post_init__(self) -> None:
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (NORMAL, USER)}
        named = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == BYTE}
        self.bytes_ = [named[f"<0x{b:02X}>"] for b in range(256)] if len(named) == 256 else []
        self.digest = hashlib.sha256(repr((self.pieces, self.scores, self.kinds, self.merges, self.prefix)).encode()).hexdigest()
        self.unknown = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)

    def raw(self) -> list[bytes]:
        """What each id stands for, with spaces for marks."""
        byte = {i: bytes([b]) for b, i in enumerate(self.bytes_)}
        known = {NORMAL: 1, USER: 1}
        return [byte.get(i) if k == BYTE else p.replace(MARK, " ").encode() if k in known else " ⁇ ".encode() if k == UNKNOWN else b"" for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]


def load(path: str) -> PieceModel:
    """The model in a SentencePiece file; its normaliser must be the identity."""
    import struct

    pieces, scores, kinds, merges, prefix = [], [], [], False, True
    for number, value in _fields(Path(path).read_bytes()):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece[1].decode())
            scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            merges = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            prefix = bool(spec.get(3, 1))
            if spec.get(2) or spec.get(4, 1):
                raise ValueError("only models that keep the text as it is are supported")
    if any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(pieces, kinds) if k in (NORMAL, USER)):
        raise ValueError("a piece spans words")
    return PieceModel(pieces, scores, kinds, merges, prefix)


class Encoder:
    """Encodes batches of distinct words; keeps what it has learnt."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.longest = max((len(p) for p in model.ids), default=1)
        inner = {c for p in model.ids for c in p if c != MARK and c in model.ids}
        # a word may be cut between a letter or digit and a sign that no piece has after one
        tied = {b for p in model.ids for a, b in zip(p, p[1:]) if a.isalnum()}
        letters, signs = {c for c in inner if c.isalnum()}, {c for c in inner if not c.isalnum()}
        listed = lambda chars: "[" + "".join(re.escape(c) for c in sorted(chars)) + "]"
        a, s, q = (listed(x) if x else "(?!)" for x in (letters, signs, signs & tied))
        parts = [f"{MARK}*+(?:{a}++(?:{q}{s}*+{a}++)*+(?:{q}{s}*+)?+|{s}++(?:{a}++{q}{s}*+)*+{a}*+)"]
        self.cut = re.compile("|".join([*parts, f"{MARK}+", "."]), re.DOTALL)
        #: longest piece by its last three characters
        self.reach: dict[str, int] = {}
        for piece in model.ids:
            if len(piece) > 2:
                self.reach[piece[-3:]] = max(self.reach.get(piece[-3:], 0), len(piece))
        self.lawful: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        #: words of the generation before; those that occur again are taken over
        self.older: dict[str, tuple[int, ...]] = {}
        #: forward states of the prefixes of the last word: last piece, its first character, score
        self.last: list[int] = [-1]
        self.begin: list[int] = [0]
        self.best: list[float] = [0.0]

    def merged(self, text: str) -> list[int]:
        """Pieces of ``text`` by the model's merging order: highest score first, leftmost among equals."""
        ids, scores = self.model.ids, self.model.scores
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                got = ids.get(parts[i] + parts[i + 1])
                if got is not None and (best is None or scores[got] > best):
                    best, at = scores[got], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ids.get(p, -1) for p in parts]

    def follows(self, a: int, b: int) -> bool:
        pieces = self.model.pieces
        return self.merged(pieces[a] + pieces[b]) == [a, b]

    def alone(self, c: str) -> tuple[int, ...]:
        if c in self.model.ids:
            return (self.model.ids[c],)
        if self.model.bytes_:
            return tuple(self.model.bytes_[b] for b in c.encode("utf-8", "replace"))
        return (self.model.unknown,)

    def forward(self, word: str, shared: int) -> tuple[int, ...]:
        """Ids of ``word``, whose first ``shared`` characters are those of the word before."""
        get, reach, lawful, size = self.model.ids.get, self.reach.get, self.lawful, len(self.model.pieces)
        merges, scores = self.model.merges, self.model.scores
        last, begins, best = self.last, self.begin, self.best
        del last[shared + 1 :], begins[shared + 1 :], best[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            longest = reach(word[end - 3 : end], 2) if end > 2 else end
            state = None
            for begin in range(max(0, end - longest), end):
                got = get(word[begin:end])
                if got is None:
                    continue
                if not merges:
                    total = best[begin] + scores[got]
                    if state is None or total > state[2]:
                        state = (got, begin, total)
                    continue
                if begin:
                    key = last[begin] * size + got
                    ok = lawful.get(key)
                    if ok is None:
                        ok = lawful[key] = self.follows(last[begin], got)
                    if not ok:
                        continue
                state = (got, begin, 0.0)
                break
            if state is None:
                raise ValueError(f"no lawful segmentation of {word[:end]!r}")
            last.append(state[0])
            begins.append(state[1])
            best.append(state[2])
        out = []
        end = len(word)
        while end:
            out.append(last[end])
            end = begins[end]
        out.reverse()
        return tuple(out)

    def learn(self, words: set[str]) -> None:
        """Adds the ids of ``words``, depth-first through their trie."""
        if len(self.words) + len(words) > CACHE_WORDS // 2:
            self.older, self.words = self.words, {}
        self.words.update((w, self.older[w]) for w in words & self.older.keys())
        if len(self.lawful) > CACHE_PAIRS:
            self.lawful.clear()
        ids = self.model.ids
        before = ""
        for word in sorted(words - self.words.keys()):
            if len(word) == 1 or word[-1] not in ids:
                self.words[word] = self.alone(word)
                continue
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            self.words[word] = self.forward(word, shared)
            before = word
        del self.last[1:], self.begin[1:], self.best[1:]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's first; one more at the end)."""
        mark = MARK if self.model.prefix else ""
        cut = [self.cut.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts]
        distinct = set().union(*cut) if cut else set()
        self.learn(distinct)
        number = {w: i for i, w in enumerate(distinct)}
        known = [self.words[w] for w in distinct]
        lengths = np.fromiter(map(len, known), np.int64, len(known))
        begin = np.append(0, np.cumsum(lengths))
        flat = np.fromiter((i for w in known for i in w), np.int32, int(begin[-1]))
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        which = np.fromiter((number[w] for words in cut for w in words), np.int64, int(counts.sum()))
        ids, ends = _gather(flat, begin, lengths, which)
        return ids, ends[np.append(0, np.cumsum(counts))]


def _gather(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat``'s segments ``which``, end to end, and where each ends (0 before the first)."""
    sizes = lengths[which]
    ends = np.append(0, np.cumsum(sizes))
    at = np.arange(int(ends[-1])) + np.repeat(begin[which] - ends[:-1], sizes)
    return flat[at], ends


class Decoder:
    def __init__(self, model: PieceModel) -> None:
        raw = model.raw()
        self.prefix = model.prefix
        self.lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.append(0, np.cumsum(self.lengths))
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of each text [bounds[i], bounds[i+1]) of ``ids``."""
        data, ends = _gather(self.flat, self.begin, self.lengths, ids)
        whole, at = data.tobytes(), ends[bounds]
        out = [whole[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [t[1:] if self.prefix and t[:1] == b" " else t for t in out]


def coders(model: PieceModel) -> tuple[Encoder, Decoder]:
    """Encoder and decoder of the worker process, with the lawful pairs that earlier tasks have learnt."""
    cache = worker_cache()
    if cache.get("pieces", ("",))[0] != model.digest:
        cache["pieces"] = (model.digest, Encoder(model), Decoder(model))
    return cache["pieces"][1:]


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ids, n_ids and round_trip (the ids decode to the text). No shuffle: each task encodes its rows."""
    added = [T.StructField("n_ids", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())]
    names = {f.name for f in added}
    rows = docs.select(row_struct(docs, tuple(names)).alias("__row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    schema = T.StructType([rows.schema["__row"], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = coders(model)
        for batch in batches:
            column = batch.column("__text")
            for i, j in slices(text_buffers(column)[1], PART_BYTES):
                texts = column.slice(i, j - i).to_pylist()
                ids, bounds = encoder.encode(texts)
                back = decoder.decode(ids, bounds)
                same = [b == t.replace(MARK, " ").encode() for b, t in zip(back, texts)]
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(i, j - i), pa.array(np.diff(bounds)), lists, pa.array(same, pa.bool_())], ["__row", *[f.name for f in added]])
        encoder.words, encoder.older = {}, {}  # other stages need the worker's memory
        tidy()

    return rows.mapInArrow(run, schema).select("__row.*", *[f.name for f in added])


def decode(encoded: DataFrame, model: PieceModel, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded_text; null ids decode to the empty text."""
    rows = encoded.select(row_struct(encoded, ("decoded_text",)).alias("__row"), F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)")).alias("__ids"))
    schema = T.StructType([rows.schema["__row"], T.StructField("decoded_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, decoder = coders(model)
        for batch in batches:
            lists = batch.column("__ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            bounds = np.asarray(lists.offsets).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in decoder.decode(flat, bounds - bounds[0])]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(texts, pa.string())], ["__row", "decoded_text"])

    return rows.mapInArrow(run, schema).select("__row.*", "decoded_text")
