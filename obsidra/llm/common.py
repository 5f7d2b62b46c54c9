"""Helpers shared by the corpus operators: staging, sizing, word hashing."""

from __future__ import annotations

import ctypes
import math
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII bytes that part words: space and tab to carriage return.
WHITESPACE = np.zeros(256, dtype=bool)
WHITESPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Bytes of text handled at once by a Python worker (a longer text goes alone).
SLICE_BYTES = 1 << 20

#: Random numbers by (place in the word modulo 64, byte): a word's hash is their sum. Two tables give independent hashes.
_CODES = np.random.default_rng(20240229).integers(0, 1 << 64, (2, 64 * 256), dtype=np.uint64)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where it is unset (local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="obsidra-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def staged(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again: cuts lineage and outlives lost executors.

    ``small``: rows are few next to the work that makes them, so they go to a sixteenth of the shuffle partitions before
    writing, of which adaptive execution splits those beyond its advisory size; the work itself keeps its parallelism.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/obsidra/{name}-{uuid.uuid4().hex}"
    if small:
        df = df.hint("rebalance", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of ``df`` (file bytes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """A scan too small to be cut into a quarter of a split per core, dealt to all cores; a larger one as it is, unshuffled."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if plan_bytes(df) * 4 < cores * split else df


def text_bytes(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of all texts: one aggregate over the column."""
    return int(df.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0)


def group_bits(total: int, least: int = 3, most: int = 24) -> int:
    """log2 of the number of groups for ``total`` bytes of text.

    A group holds 4 MiB, more as the root of the input (groups and ranges both grow, so that a packed row between them
    stays filled), at most 32 MiB.
    """
    size = min(32 << 20, max(4 << 20, math.isqrt(4096 * total)))
    return min(most, max(least, max(1, -(-total // size) - 1).bit_length()))


def worker_cache() -> dict:
    """A dict of the worker process: what is costly to set up serves all tasks that it runs."""
    return sys.__dict__.setdefault("_obsidra_worker", {})


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64's constants)."""
    x = np.array(x, np.uint64, ndmin=1)  # arrays wrap around silently
    y = x >> np.uint64(30)
    x ^= y
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=y)
    x ^= y
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=y)
    x ^= y
    return x


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string array without copying; null is the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    large = pa.types.is_large_string(texts.type)
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if large else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [i, j) of at most ``most`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def word_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each word of consecutive texts, each text's first word; n+1 numbers).

    Words are maximal runs of bytes outside :data:`WHITESPACE`; a word never crosses a text.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = WHITESPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    before[inner] = True
    after[inner - 1] = True
    start = np.flatnonzero(~space & before)
    return start, np.flatnonzero(~space & after) + 1, np.searchsorted(start, offsets)


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: int = 0) -> np.ndarray:
    """64-bit hashes of the words [start, end): sums of random numbers drawn by place and byte, then mixed.

    Unlike a polynomial modulo 2**64 no pattern of bytes makes the sums of two words agree; ``table`` chooses the numbers.
    """
    if not len(start):
        return np.zeros(0, np.uint64)
    n = len(data)
    kind = np.int32 if n < 1 << 31 else np.int64
    place = np.zeros(n, kind)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    np.subtract(np.arange(n, dtype=kind), place, out=place)
    codes = _CODES[table].take((place & 63).astype(np.uint16) << np.uint16(8) | data)
    longest = int((end - start).max())
    if longest > 64:
        far = np.flatnonzero((place >= 64) & (place < longest))
        codes[far] = mixed(codes[far] + (place[far] >> 6).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    both = np.empty(2 * len(start), np.int64)
    both[::2], both[1::2] = start, end
    return mixed(np.add.reduceat(codes, both[: len(both) - (end[-1] == n)])[::2])


def plain_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of the words [start, end), one space after each; where each word begins, one more at the end)."""
    length = end - start
    bound = np.append(0, np.cumsum(length + 1))
    out = np.full(int(bound[-1]), 0x20, np.uint8)
    if len(start):
        place = np.arange(int(bound[-1]) - len(start))
        begin = np.cumsum(length) - length
        out[place + np.repeat(np.arange(len(start)), length)] = data[place + np.repeat(start - begin, length)]
    return out, bound


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and each text's first word (n+1 numbers)."""
    start, end, first = word_places(data, offsets)
    return word_names(data, start, end), first


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(0x9FB21C651E98DF25) + b)


def rolling(h: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all ``width`` consecutive values, positions 0 .. len-width: halves are hashed together, level by level."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    level, size = mixed(h ^ np.uint64(seed)), 1
    out, done = None, 0
    while True:
        if width & size:
            out = level if out is None else _joined(out[: len(h) - done - size + 1], level[done:])
            done += size
        if done == width:
            return out
        level = _joined(level[:-size], level[size:])
        size *= 2


def tidy(used: int = 1 << 30) -> None:
    """Gives memory that this worker has freed back to the system: workers live on through later stages.

    ``used``: bytes of text that were at hand; a small group leaves things as they are, for there are many of them.
    """
    if used < 4 * SLICE_BYTES:
        return
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # no glibc
        pass


def row_struct(df: DataFrame, without: tuple[str, ...] = ()):
    """All columns but ``without`` as one struct column, so that no name can clash with the operator's own."""
    names = [c for c in df.columns if c not in without]
    return F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(True).alias("__none"))
