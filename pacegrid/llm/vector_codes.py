"""Product codes of vectors, with codebooks moved by k-means under an Exponion search.

A vector's entries become whole numbers and are cut into equal parts; every part
position has a codebook.  A part's nearest entry is sought from the entry it had in
the round before: an entry that is as near as that one lies at most twice as far from it
as the part does, so of the entry's other entries, sorted by their distance, only a head
can win (``D <= 4 * d`` between squares; the edge counts, for ties).  All distances are
whole numbers, ties go to the lower index, and so the result is that of a search of all
entries.

Rounds are one pass over a table that keeps each vector with its code, and a sum of the
parts of each entry: a few numbers for each entry and task, which Spark adds up.  The
driver holds codebooks only.

Defined results: rows whose vector is null or has a null or non-finite component go, and those
of another length than most have; rows with a null or repeated id stay, one result each.  The
codebooks start with the least ids; of rows of one id the one with the least components counts,
null is the last id.  Fewer ids give fewer entries.  An empty table gives no rows.  A length that the parts
don't divide, or components too large for exact longs, are errors.  Other columns but ``label`` are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _vectors

FACTOR, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6


def nearest(points: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest entry, squared distance) of each point, and how many distances that took, from the entries ``start`` on."""
    between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
    apart = lambda rows, k: ((points[rows] - entries[k]) ** 2).sum(axis=1)
    best, least = start.astype(np.int64), np.empty(len(points), np.int64)
    taken = len(points)
    for k in range(len(entries)):
        own = np.flatnonzero(start == k)
        if not len(own):
            continue
        # sorted by distance, then by index; the entry itself is left out
        others = np.argsort(between[k], kind="stable")
        others = others[others != k]
        near = apart(own, k)
        reach = np.searchsorted(between[k][others], 4 * near, side="right")
        order = np.argsort(-reach, kind="stable")
        own, near, reach = own[order], near[order], reach[order]
        here = np.full(len(own), k)
        for place, other in enumerate(others.tolist()):
            n = int(np.searchsorted(-reach, -place, side="left"))  # points whose reach goes past this place
            if not n:
                break
            taken += n
            found = apart(own[:n], other)
            wins = (found < near[:n]) | ((found == near[:n]) & (other < here[:n]))
            near[:n][wins], here[:n][wins] = found[wins], other
        best[own], least[own] = here, near
    return best, least, taken


def coded(vectors: np.ndarray, books: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, parts) indexes and squared distances under ``books`` (parts, entries, part length), searched from the codes ``before``."""
    parts, _, long = books.shape
    code, far = np.empty((len(vectors), parts), np.int64), np.empty((len(vectors), parts), np.int64)
    for p in range(parts):
        code[:, p], far[:, p], _ = nearest(vectors[:, p * long : (p + 1) * long], books[p], before[:, p])
    return code, far


def totals(vectors: np.ndarray, code: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts, entries, part length) and counts (parts, entries) of the parts of each entry, exactly."""
    parts = code.shape[1]
    long = vectors.shape[1] // parts
    total, count = np.zeros((parts, entries, long), np.int64), np.zeros((parts, entries), np.int64)
    for p in range(parts):
        count[p] = np.bincount(code[:, p], minlength=entries)
        order = np.argsort(code[:, p], kind="stable")
        first = np.cumsum(count[p]) - count[p]
        used = np.flatnonzero(count[p])
        if len(used):
            total[p, used] = np.add.reduceat(vectors[order, p * long : (p + 1) * long], first[used], axis=0)
    return total, count


def moved(books: np.ndarray, total: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Every entry at the floor of its parts' mean; unused ones stay."""
    return np.where(count[:, :, None] > 0, total // np.maximum(count, 1).astype(object)[:, :, None], books)


def fingerprint(books: np.ndarray) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _started(whole: DataFrame, wide: int, parts: int, entries: int) -> np.ndarray:
    """The first codebooks, of the least ids: a bounded number of vectors."""
    numbers = F.transform("embedding", lambda x: F.floor(x.cast("double") * FACTOR))
    order = F.asc_nulls_last("vec_id")
    ids = [r.vec_id for r in whole.select("vec_id").distinct().orderBy(order).limit(entries).collect()]
    theirs = F.when(F.col("vec_id").isNull(), F.lit(None in ids)).otherwise(F.col("vec_id").isin([k for k in ids if k is not None]))
    firsts = whole.where(theirs).groupBy("vec_id").agg(F.min(numbers).alias("vector")).orderBy(order).collect()
    vectors = np.array([r.vector for r in firsts], np.int64).reshape(len(firsts), parts, wide // parts)
    return vectors.transpose(1, 0, 2).copy()


def vector_codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector."""
    spark = embeddings.sparkSession
    rows, wide = _vectors.finite(embeddings, [F.col("vec_id").cast("long").alias("vec_id"), "label"])
    if not wide:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    if wide % parts:
        raise ValueError(f"vectors of {wide} components cannot be cut into {parts} equal parts")
    # the square of a difference, summed over a part, and four times that fit a long
    most = int((((1 << 63) - 1) // (16 * (wide // parts))) ** 0.5)
    books = _started(rows, wide, parts, entries)
    size = books.shape[1]
    label = rows.schema["label"].dataType.simpleString()

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors.floors(batch.column("embedding"), wide, FACTOR)
            if np.abs(vectors).max(initial=0) > most:
                raise ValueError("a component of a vector is too large for exact distances")
            first = pa.array([bytes(parts)] * len(vectors), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _vectors.packed(vectors), first], ["vec_id", "label", "vector", "code"])

    def codes(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)

    def assigned(state: DataFrame, books: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                code, _ = coded(_vectors.unpacked(batch.column("vector"), wide), books, codes(batch.column("code")))
                raw = code.astype(np.uint8).tobytes()
                told = pa.array([raw[i : i + parts] for i in range(0, len(raw), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("vector"), told], ["vec_id", "label", "vector", "code"])

        return state.mapInArrow(run, f"vec_id long, label {label}, vector binary, code binary")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, count = totals(_vectors.unpacked(batch.column("vector"), wide), codes(batch.column("code")), size)
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    state = _tables.stored(rows.mapInArrow(begin, f"vec_id long, label {label}, vector binary, code binary"), "codes-state")
    for _ in range(rounds):
        state = _tables.stored(assigned(state, books), "codes-state", instead=state)
        partial = state.select("vector", "code").mapInArrow(summed, "part long, entry long, n long, total array<long>")
        each = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(wide // parts)]
        total, count = np.zeros(books.shape, object), np.zeros(books.shape[:2], np.int64)
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # a row for each entry
            count[r.part, r.entry] = r.n
            total[r.part, r.entry] = [int(r[f"t{i}"]) for i in range(wide // parts)]
        books = moved(books, total, count).astype(np.int64)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, far = coded(_vectors.unpacked(batch.column("vector"), wide), books, codes(batch.column("code")))
            told = pa.array(["".join(f"{k:02x}" for k in row) for row in code.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), told, pa.array(far.sum(axis=1))], ["vec_id", "label", "code", "error"])

    final = _tables.stored(state.mapInArrow(finish, f"vec_id long, label {label}, code string, error long"), "codes-final", instead=state)
    # labels may be few or as many as rows: Spark broadcasts their sums where the stored table is small, and splits a frequent label's rows where not
    by_label = final.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = _tables.stored(by_label, "codes-labels")
    out = final.join(by_label, final["label"].eqNullSafe(by_label["label"]))
    return out.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
