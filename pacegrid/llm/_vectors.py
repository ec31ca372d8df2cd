"""Vector columns: which rows count, and their entries as whole numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole numbers of a vector stay below this, so that differences fit a long.
MOST = 1 << 62


def finite(rows: DataFrame, columns: list[str], vector: str = "embedding") -> tuple[DataFrame, int]:
    """``columns`` and ``vector`` of the rows whose vector is not null and has finite entries only, and its length.

    Vectors of another length than most such rows have (of lengths that are as
    frequent, the longer counts) have no place in the space and go, too.
    """
    good = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    kept = rows.select(*columns, vector).where(F.col(vector).isNotNull() & good)
    lengths = kept.groupBy(F.size(vector).alias("_length")).agg(F.count(F.lit(1)).alias("_n"))
    first = lengths.orderBy(F.desc("_n"), F.desc("_length")).first()
    wide = first[0] if first else 0
    return kept.where(F.size(vector) == wide), wide


def floors(column: pa.Array, wide: int, factor: int) -> np.ndarray:
    """(rows, wide) of ``floor(factor * entry)``; raises where one doesn't fit."""
    entries = np.floor(factor * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if entries.size and np.abs(entries).max() >= MOST:
        raise ValueError("an entry of a vector is too large for a long")
    return entries.astype(np.int64).reshape(len(column), wide)


def packed(values: np.ndarray) -> pa.Array:
    """Each row as bytes: the least of 1, 2, 4 or 8 bytes that hold all its numbers, and the numbers in it; equal rows, equal bytes."""
    most = np.maximum(values.max(axis=1, initial=0), ~values.min(axis=1, initial=0))
    out = np.empty(len(values), object)
    for size, below in ((1, 0), (2, 1 << 7), (4, 1 << 15), (8, 1 << 31)):
        rows = np.flatnonzero((most >= below) & ((most < 1 << (8 * size - 1)) if size < 8 else True))
        raw, step = values[rows].astype(f"<i{size}").tobytes(), size * values.shape[1]
        head = bytes([size])
        for k, row in enumerate(rows.tolist()):
            out[row] = head + raw[k * step : (k + 1) * step]
    return pa.array(out.tolist(), pa.binary())


def unpacked(column: pa.Array, wide: int) -> np.ndarray:
    """(rows, wide) of ``packed`` rows."""
    rows = column.to_pylist()
    out = np.empty((len(rows), wide), np.int64)
    size = np.array([r[0] for r in rows], np.int64)
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        out[at] = np.frombuffer(b"".join(rows[i][1:] for i in at), f"<i{n}").reshape(len(at), wide)
    return out
