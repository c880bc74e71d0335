"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of a side that are multiplied together at most; larger groups are cut into blocks.
BLOCK = 2048


def valid(vector: str) -> Column:
    """Vectors that take part: not null or empty, no component null or not finite, not all zero."""
    odd = f"exists({vector}, x -> x is null or isnan(x) or abs(cast(x as double)) = double('Infinity'))"
    return F.expr(f"{vector} is not null and size({vector}) > 0 and not coalesce({odd}, true) and exists({vector}, x -> x <> 0)")


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length as doubles."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree in the first `keys` columns (numbers), from rows sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(n)) for n in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield _joined(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
