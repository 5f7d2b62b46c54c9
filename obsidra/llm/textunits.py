"""Texts as sequences of units that tokenizers can encode one by one.

A unit begins at a space that follows a character other than white space, and goes to the next such place. Neither a
byte-level tokenizer with the usual pattern (a word takes the space before it, never one after) nor a piece model whose
pieces don't span words has a token across such a place, so the ids of a text are those of its units, end to end. Texts
have few different units, and each is encoded once.

A key stands for a unit: the unit without its first space, or, at the head of a text that isn't preceded by one,
:data:`BARE` and the unit. No key of the first kind holds a space after another character.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import worker_cache

BARE = "\0 "
#: A space after white space: only such texts need the slower cut.
_DOUBLE, _CUT = re.compile(r"\s "), re.compile(r"(?<=\S)(?= )")
#: Fixed value: the pattern by which byte-level vocabularies of this kind cut text.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose classes all Unicode versions in use agree on.
_SETTLED = re.compile("[\0-ɏ]*")
#: Units kept between batches of a worker, at most.
CACHE_UNITS = 300_000


def bare_units(text: str) -> list[str]:
    """Keys of the units of ``text``."""
    parts = text.split(" ") if not _DOUBLE.search(text) else [p if not k else p[1:] for k, p in enumerate(_CUT.split(text))]
    parts[0] = BARE + parts[0]
    return parts


def spaced_units(text: str) -> list[str]:
    """Keys of the units of a space and ``text``."""
    if text[:1] != " " and not _DOUBLE.search(text):
        return text.split(" ")
    return [p[1:] for p in _CUT.split(" " + text)]


def unit_of(key: str) -> str:
    return key[2:] if key.startswith(BARE) else " " + key


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = sorted(set(range(256)) - set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairs:
    """Ids of units by a byte-level vocabulary, equal to those of the ``tokenizers`` library.

    Units of settled characters go through the faster ``tiktoken`` with the same ranks; all others, and those with a
    special token's string where ``specials`` asks for its id, through ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str, specials: bool) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        given = json.loads(vocabulary)
        added = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        byte = byte_characters()
        ranks = {bytes(byte[c] for c in token): i for token, i in given["model"]["vocab"].items() if token not in added}
        self.raw = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        for token, i in added.items():
            self.raw[i] = token.encode()
        self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_str(vocabulary)
        self.slow.encode_special_tokens = not specials
        self.specials = re.compile("|".join(map(re.escape, added))) if specials and added else None

    def encode(self, units: list[str]) -> list[list[int]]:
        quick, special = self.fast.encode_ordinary, self.specials
        out = [quick(u) if _SETTLED.fullmatch(u) and not (special and special.search(u)) else None for u in units]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, got in zip(rest, self.slow.encode_batch_fast([units[i] for i in rest], add_special_tokens=False) if rest else []):
            out[i] = got.ids
        return out


def gathered(flat: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``flat``'s segments ``which`` end to end (segment k is [begin[k], begin[k+1])), and where each ends, 0 first."""
    sizes = begin[which + 1] - begin[which]
    ends = np.append(0, np.cumsum(sizes))
    at = np.arange(int(ends[-1])) + np.repeat(begin[which] - ends[:-1], sizes)
    return flat[at], ends


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class UnitTable:
    """Numbers of units, and the ids of each number: ``flat[begin[k] : begin[k + 1]]``."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]]) -> None:
        self.encode = encode
        self.reset()

    def reset(self) -> None:
        self.known = _Numbers()
        self.flat, self.begin = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def numbers(self, units: list[list[str]]) -> np.ndarray:
        """Numbers of all units of consecutive texts; new ones are encoded."""
        before = len(self.known)
        count = sum(map(len, units))
        out = np.fromiter(map(self.known.__getitem__, chain.from_iterable(units)), np.int64, count)
        if len(self.known) > before:
            self.learn([unit_of(k) for k in list(self.known)[before:]])
        return out

    def learn(self, units: list[str]) -> None:
        ids = self.encode(units)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))])
        self.begin = np.append(self.begin, self.begin[-1] + np.cumsum(sizes))

    def trim(self) -> None:
        """Forgets all units once there are too many."""
        if len(self.known) > CACHE_UNITS:
            self.reset()


def kept_in_worker(name: str, key: object, make: Callable[[], object]):
    """What a worker process sets up once for all its tasks."""
    cache = worker_cache()
    if cache.get(name, (None,))[0] != key:
        cache[name] = (key, make())
    return cache[name][1]
