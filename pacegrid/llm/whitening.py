"""Embedding whitening by an exact integer scatter.

Entries become whole numbers.  Every task sums its vectors' entries and the
products of each two of them without any rounding, in as many limbs as they need;
Spark adds the limbs up.  From n, the sums S and the products the driver forms
``n * XtX - S St`` exactly, which no shift of the entries changes, and only that
is turned into floating point and decomposed by ``eigh``.  So neither a large mean
nor the order of rows or tasks changes the model.

The driver holds what is quadratic in the vectors' length, whatever their number.

Defined results: rows whose vector is null or has a null or non-finite entry go, and
those of another length than most have; rows with a null or repeated id stay, one result
each; an empty table gives no rows.  Copies of a vector count once in the fit.  A component
without variance (of constant dimensions, or of fewer vectors than dimensions) has a null
``whitened`` and ``explained`` 0; ``identity_error`` is over the other components, 0 if there
are none.  ``deviation`` is null where it doesn't fit a long; ``deviation_digits`` always has it.
An entry too large for a long is an error.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _vectors

FACTOR, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Bits of a limb in a product and in a table of sums.
_LIMB, _PART = 16, 30
#: Numbers of so many bits are whole in a double.
_WHOLE = 53
_LONG = 1 << 63


def products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of whole numbers, exactly, as Python integers.

    Matrices of limbs are multiplied as doubles, which hold every partial sum.
    """
    limbs, rest = [], y
    while True:
        top = bool(rest.size == 0 or np.abs(rest + (rest < 0)).max() < 1 << (_LIMB - 1))
        limbs.append((rest if top else rest & ((1 << _LIMB) - 1)).astype(np.float64))
        if top:
            break
        rest = rest >> _LIMB
    step = 1 << (_WHOLE - 2 * _LIMB)
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for start in range(0, len(y), step):
        at = slice(start, start + step)
        for a, left in enumerate(limbs):
            for b, right in enumerate(limbs):
                total += (left[at].T @ right[at]).astype(np.int64).astype(object) << (_LIMB * (a + b))
    return total


def sums(y: np.ndarray) -> np.ndarray:
    """Column sums of whole numbers, exactly, as Python integers."""
    low, high = y & 0xFFFFFFFF, y >> 32
    return low.sum(axis=0).astype(object) + (high.sum(axis=0).astype(object) << 32)


def _cells(n: int, s: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
    """Sums of a task as rows (i, j, part, value) of limbs: (-1, -1) is the number of vectors, (i, -1) a sum, i <= j a product."""
    keys = [(-1, -1, n)] + [(i, -1, v) for i, v in enumerate(s)] + [(i, j, p[i, j]) for i in range(len(s)) for j in range(i, len(s))]
    rows = []
    for i, j, value in keys:
        part = 0
        while not -(1 << _PART) <= value < 1 << _PART:
            rows.append((i, j, part, value & ((1 << _PART) - 1)))
            value, part = value >> _PART, part + 1
        rows.append((i, j, part, value))
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows)], ["i", "j", "part", "value"])


@dataclass
class Model:
    """What whitens a vector: ``n`` vectors with sums ``s``, unit eigenvectors in columns and their eigenvalues, falling."""

    n: int
    s: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """(rows, components): ``y`` less the mean, on each component, by its deviation; NaN without variance."""
        mean = np.array([int(v) / self.n for v in self.s])
        has = self.values > 0
        scale = np.where(has, np.sqrt(np.where(has, self.values, 1)), np.nan)
        return ((y - mean) @ self.vectors) / scale

    def deviations(self, y: np.ndarray) -> list[int]:
        """Sums over dimensions of ``(n * y - s) ** 2``, exactly."""
        most = self.n * int(np.abs(y).max(initial=0)) + max((abs(int(v)) for v in self.s), default=0)
        kind = np.int64 if most * most * max(1, y.shape[1]) < _LONG else object
        apart = y.astype(kind) * self.n - self.s.astype(kind)
        return (apart * apart).sum(axis=1).tolist()


def scatter(n: int, s: np.ndarray, p: np.ndarray) -> np.ndarray:
    """``n * p - s st``: n squared times the covariance, exactly."""
    return n * p - np.outer(s, s)


def decomposed(n: int, s: np.ndarray, p: np.ndarray, components: int) -> Model:
    whole = scatter(n, s, p)
    variance = np.array([[int(v) / (n * n) for v in row] for row in whole])
    values, vectors = np.linalg.eigh(variance)
    take = np.argsort(-values, kind="stable")[:components]
    trace = int(sum(whole[i, i] for i in range(len(s)))) / (n * n)
    noise = trace * len(s) * np.finfo(float).eps
    values = np.where(values[take] > noise, values[take], 0.0)
    return Model(n, s, vectors[:, take], values, values / trace if trace else values)


def fit(fitted: DataFrame, wide: int, components: int) -> Model:
    """The model of a list of different vectors (column ``vector``, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
        for batch in batches:
            y = _vectors.unpacked(batch.column("vector"), wide)
            n, s, p = n + len(y), s + sums(y), p + products(y)
        if n:
            yield _cells(n, s, p)

    cells = fitted.mapInArrow(run, "i long, j long, part long, value long").groupBy("i", "j", "part").agg(F.sum("value").alias("value"))
    n, s, p = 0, np.zeros(wide, object), np.zeros((wide, wide), object)
    for i, j, part, value in cells.toLocalIterator():  # of the length's square
        value = int(value) << (_PART * part)
        if i < 0:
            n += value
        elif j < 0:
            s[i] += value
        else:
            p[i, j] += value
            if i != j:
                p[j, i] += value
    return decomposed(n, s, p, components)


def identity_error(fitted: DataFrame, model: Model) -> float:
    """The largest entry of the whitened vectors' covariance less the identity, measured on all vectors of the fit."""
    wide = len(model.s)
    has = np.flatnonzero(model.values > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((len(has), len(has))), np.zeros(len(has))
        for batch in batches:
            w = model.whitened(_vectors.unpacked(batch.column("vector"), wide))[:, has]
            total, first = total + w.T @ w, first + w.sum(axis=0)
        i, j = np.indices(total.shape).reshape(2, -1)
        columns = (np.append(i, range(len(has))), np.append(j, np.full(len(has), -1)), np.append(total.ravel(), first))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "value"])

    covariance, mean = np.zeros((len(has), len(has))), np.zeros(len(has))
    for i, j, value in fitted.mapInArrow(run, "i long, j long, value double").groupBy("i", "j").agg(F.sum("value")).collect():
        if j < 0:
            mean[i] = value / model.n
        else:
            covariance[i, j] = value / model.n
    return float(np.abs(covariance - np.outer(mean, mean) - np.eye(len(has))).max(initial=0.0))


def whitening(embeddings: DataFrame, components: int = COMPONENTS, factor: int = FACTOR, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits for each vector and component.

    x is ``floor(factor * entry) + offset``; the offset is the shift that is subtracted again before anything is summed.
    """
    rows, wide = _vectors.finite(embeddings, [F.col("vec_id").cast("long").alias("vec_id")])
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_digits string"
    if not wide:
        return rows.sparkSession.createDataFrame([], schema)

    def shifted(column: pa.Array) -> np.ndarray:
        x = _vectors.floors(column, wide, factor) + offset
        return x - offset

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([_vectors.packed(shifted(batch.column("embedding")))], ["vector"])

    fitted = _tables.stored(rows.select("embedding").mapInArrow(pack, "vector binary").distinct(), "whitening-fit")
    model = fit(fitted, wide, components)
    error = identity_error(fitted, model)
    _tables.drop(fitted)
    held = rows.sparkSession.sparkContext.broadcast(model)  # of the length's square at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        k = len(m.values)
        for batch in batches:
            y = shifted(batch.column("embedding"))
            exact = m.deviations(y)
            long, digits = pa.array([d if d < _LONG else None for d in exact], pa.int64()), pa.array(list(map(str, exact)))
            owner = pa.array(np.repeat(np.arange(len(y)), k))
            whole = m.whitened(y).ravel()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(owner), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(y))), pa.array(np.full(len(owner), m.n)), long.take(owner),
                    pa.array(whole, mask=np.isnan(whole)), pa.array(np.tile(m.explained, len(y))), pa.array(np.full(len(owner), error)), digits.take(owner),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_digits"],
            )

    return rows.mapInArrow(run, schema)
