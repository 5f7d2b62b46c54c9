"""Functions of single values that no built-in expresses, run over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

#: Bytes of rows that a function over parts takes at once (a longer row goes alone).
PART_BYTES = 1 << 20


def by_batch(returns: str | DataType) -> Callable:
    """Decorator: a function of one value of each column, called once a row; rows come and go as Arrow batches."""
    return lambda f: F.udf(f, returns, useArrow=True)


def parts(columns: tuple[pa.Array, ...], most: int = PART_BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """Runs of rows of at most ``most`` bytes, in order."""
    n = len(columns[0])
    if n < 2 or sum(c.nbytes for c in columns) <= most:
        yield columns
        return
    for begin, end in ((0, n // 2), (n // 2, n)):
        yield from parts(tuple(c.slice(begin, end - begin) for c in columns), most)


def by_parts(returns: str) -> Callable:
    """Decorator: a function of Arrow arrays, called over :func:`parts` of each batch; a part's result leaves before the next is made,
    so what Python holds follows the bytes of a part and not those of a batch's rows."""

    def made(f: Callable[..., pa.Array]) -> Callable:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for part in parts(batch if isinstance(batch, tuple) else (batch,)):
                    yield f(*part)

        return F.arrow_udf(run, returns)

    return made


def by_values(returns: str) -> Callable:
    """Decorator: a function of one text or bytes of each column to a text or bytes (``returns``: string or binary), called once a row
    of a part; results leave as soon as they make up a part themselves."""
    kind = {"string": pa.string(), "binary": pa.binary()}[returns]

    def made(f: Callable) -> Callable:
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                for part in parts(batch if isinstance(batch, tuple) else (batch,)):
                    out, held = [], 0
                    for row in zip(*[c.to_pylist() for c in part]):
                        value = f(*row)
                        out.append(value)
                        held += len(value or "")
                        if held > PART_BYTES:
                            yield pa.array(out, kind)
                            out, held = [], 0
                    if out:
                        yield pa.array(out, kind)

        return F.arrow_udf(run, returns)

    return made
