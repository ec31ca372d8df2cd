"""Toxicity by compression distance.

Two zstandard dictionaries are built from labelled text, one of ordinary writing
and one of toxic writing, which holds ordinary words too, at the same distance.  Every window (a word with its separators) is compressed
with both; a window that the toxic dictionary shortens by at least the
threshold calibrated for windows of its length is a hit.  A logistic curve,
fitted on documents that no dictionary has seen, turns a document's hits into
a probability.

Zstandard stores a block raw unless compression saves a few bytes, so a window
on its own never shows a gain.  Both dictionaries therefore end in the same
``CARRIER`` and every window starts with it: the block is then always
compressed, and the two lengths differ only by what the window itself costs.
Windows and dictionaries hold every byte twice, so that naming a match of four
letters costs less than the letters.

Defined results: null and empty texts have no window and get the probability
of a document without hits; repeated rows score alike; without labels of both
classes every document gets the share of toxic labels seen (0 without any).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pacegrid.llm import _tables, _text

#: Bounds of the training sample, in documents.
MOST_TOXIC, MOST_ORDINARY = 2500, 5000
CALIBRATION_FOLD = 1
LEVEL = 6
CARRIER = b"<0123456789abcdefghij|:>"
TRIM = ".,;:!?\"'()[]{}#$%&*|<>"
#: Starts of words, in code points, that may enter a dictionary, besides whole words.
STEMS = (4, 5, 6, 7)
#: A fragment enters the toxic dictionary when this likelihood ratio statistic of
#: its document counts is reached, which about ten toxic documents do if no ordinary one has it.
DISTINCT = 40.0
#: And when its rate in toxic documents is so many times that in ordinary ones.
APART = 50
#: And when it is in this share of the toxic documents.
FREQUENT = 0.01
DICTIONARY_BYTES = 4096
LONGEST = 24
#: Share of ordinary calibration documents that may hit at one window length.
STRAY = 0.0005
SLICE_BYTES = 8 << 20


@dataclass
class Model:
    toxic: bytes = b""
    ordinary: bytes = b""
    thresholds: np.ndarray = field(default_factory=lambda: np.full(LONGEST + 1, 127))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float = 0.0


def _windows(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct windows, the window of every word, and row offsets into the words."""
    raw, bounds = _text.text_bytes(column)
    folded = _text.strings(_text.fold_case(raw), bounds)
    split = pc.ascii_split_whitespace(folded)
    words = pc.ascii_trim(split.flatten(), characters=TRIM)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.asarray(split.offsets)


def _wide(plain: bytes) -> bytes:
    return np.repeat(np.frombuffer(plain, np.uint8), 2).tobytes()


def _lengths(windows: list[bytes], content: bytes) -> np.ndarray:
    if not windows:
        return np.zeros(0, np.int64)
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    shared.precompute_compress(level=LEVEL)
    compressor = zstandard.ZstdCompressor(dict_data=shared, level=LEVEL, write_content_size=False, write_dict_id=False)
    size = np.fromiter(map(len, windows), np.uint64, len(windows))
    segments = np.stack([np.cumsum(size) - size, size], axis=1).astype(np.uint64)
    packed = zstandard.BufferWithSegments(b"".join(windows), segments.tobytes())
    return np.fromiter(map(len, compressor.multi_compress_to_buffer(packed, threads=1)), np.int64, len(windows))


def _gains(words: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the toxic dictionary saves on each window, and length classes."""
    plain = [w.encode() for w in words.to_pylist()]
    size = np.minimum(np.fromiter(map(len, plain), np.int64, len(plain)), LONGEST)
    framed = [CARRIER + _wide(b" " + w + b" ") for w in plain]
    return _lengths(framed, model.ordinary) - _lengths(framed, model.toxic), size


def _features(column: pa.Array, model: Model) -> np.ndarray:
    """Per row: 1, whether any window hits, and log(1 + hits)."""
    words, codes, bounds = _windows(column)
    gain, size = _gains(words, model)
    hits = _text.row_sums((gain >= model.thresholds[size])[codes].astype(np.int64), bounds)
    return np.stack([np.ones(len(hits)), hits > 0, np.log1p(hits)], axis=1)


def _score(column: pa.Array, model: Model) -> np.ndarray:
    if not model.toxic:
        return np.full(len(column), model.prior)
    return 1 / (1 + np.exp(-np.clip(_features(column, model) @ model.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _surprise(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Likelihood ratio statistic of "a of n" against "b of m", 0 where b's rate is higher."""

    def part(k, of, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (of - k) * np.log(1 - p)

    pooled = (a + b) / (n + m)
    value = 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, pooled) - part(b, m, pooled))
    return np.where(a * m > b * n, value, 0.0)


def _fragments(column: pa.Array, label: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Word starts and words, with the number of toxic and of ordinary documents that have them."""
    words, codes, bounds = _windows(column)
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    pairs = np.unique(rows * len(words) + codes)
    row, code = pairs // len(words), pairs % len(words)
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    names, toxic, ordinary = [], [], []
    for n in (*STEMS, None):
        piece = words if n is None else pc.utf8_slice_codeunits(words, 0, n)
        gap, end, none = (pa.scalar(c, piece.type) for c in (" ", " " if n is None else "", ""))
        text = pc.binary_join_element_wise(gap, piece, end, none)
        coded = text.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        fits = size[code] >= (3 if n is None else n)
        seen = np.unique(row[fits] * len(coded.dictionary) + index[code[fits]])
        r, f = seen // len(coded.dictionary), seen % len(coded.dictionary)
        names += coded.dictionary.to_pylist()
        for into, value in ((toxic, 1), (ordinary, 0)):
            into.append(np.bincount(f[label[r] == value], minlength=len(coded.dictionary)))
    return names, np.concatenate(toxic), np.concatenate(ordinary)


def _apart(column: pa.Array) -> np.ndarray:
    """False for texts whose least-hashed long word an earlier text has: copies, near ones too.

    A group of copies would otherwise make its own words look like marks of a class.
    """
    words, codes, bounds = _windows(column)
    plain = [w.encode() for w in words.to_pylist()]
    keep = np.ones(len(column), bool)
    rows = np.repeat(np.arange(len(column)), np.diff(bounds))
    for seed in (1, 2):
        hashed = np.array([zlib.crc32(w, seed) if len(w) >= 8 else 1 << 32 for w in plain], np.int64)
        least = np.full(len(column), 1 << 32)
        np.minimum.at(least, rows, hashed[codes])
        first = np.unique(least, return_index=True)[1]
        once = np.isin(np.arange(len(column)), first)
        keep &= once | (least == 1 << 32)
    return keep


def _content(names: list[str], rank: np.ndarray, least: float) -> bytes:
    """The highest-ranked fragments, the best last, next to where windows begin."""
    order = np.lexsort((np.arange(len(names)), -rank))
    kept: list[str] = []
    seen, used = "", 0
    for i in order:
        if rank[i] < least or used >= DICTIONARY_BYTES // 2:
            break
        if names[i] not in seen:
            kept = [k for k in kept if k not in names[i]] + [names[i]]
            seen = "".join(kept)
            used += len(names[i].encode())
    return _wide("".join(reversed(kept)).encode())


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries from folds 2 to 4, thresholds and probabilities from fold 1."""
    sample = _tables.labelled_texts(docs, labels, "toxic", {1: MOST_TOXIC, 0: MOST_ORDINARY})
    label = np.asarray(sample["_label"]) if sample.num_rows else np.zeros(0, int)
    model = Model(prior=float(label.mean()) if len(label) else 0.0)
    text = pa.concat_arrays([pa.array([], pa.large_string()), *sample["text"].cast(pa.large_string()).chunks])
    ahead = np.asarray(sample["_fold"]) == CALIBRATION_FOLD if sample.num_rows else np.zeros(0, bool)
    if any(len(set(label[part])) < 2 for part in (ahead, ~ahead)):
        return model
    taught, taught_label = text.filter(pa.array(~ahead)), label[~ahead]
    apart = _apart(taught)
    taught, taught_label = taught.filter(pa.array(apart)), taught_label[apart]
    names, a, b = _fragments(taught, taught_label)
    n, m = int((taught_label == 1).sum()), int((taught_label == 0).sum())
    if not n or not m:
        return model
    model.ordinary = _content(names, np.where(a * m > 2 * b * n, 0, b).astype(float), 2) + CARRIER
    marks = (a * m > APART * (b + 0.5) * n) & (a >= FREQUENT * n)
    model.toxic = _content(names, np.where(marks, _surprise(a, n, b, m), 0.0), DISTINCT) + model.ordinary
    _calibrate(model, text.filter(pa.array(ahead)), label[ahead])
    del sample, text, taught, names, a, b, marks
    _tables.release()
    return model


def _calibrate(model: Model, text: pa.Array, label: np.ndarray) -> None:
    words, codes, bounds = _windows(text)
    gain, size = _gains(words, model)
    rows = np.repeat(np.arange(len(text)), np.diff(bounds))
    ordinary = label[rows] == 0
    clean = max(1, int((label == 0).sum()))
    for n in range(LONGEST + 1):
        here = size[codes] == n
        best = np.full(len(text), -127)
        np.maximum.at(best, rows[here & ordinary], gain[codes[here & ordinary]])
        over = np.sort(best)[::-1][int(STRAY * clean)]
        model.thresholds[n] = max(2, over + 1)
    x = _features(text, model)
    model.weights = _logistic(x, label.astype(float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``_score``, the probability of label 1 of the whole text."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text", SLICE_BYTES):
                value = pa.array(_score(part.column("text"), model))
                yield pa.RecordBatch.from_arrays([*part.columns, value], [*part.schema.names, "_score"])

    return docs.mapInArrow(_tables.tidy(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1) and predicted (0 or 1)."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select(
        "doc_id",
        (_tables.fold() == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_ordinary(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score 0.5 or more."""
    model = fit(docs, labels)

    def keep(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for part in _text.slices(batch, "text", SLICE_BYTES):
            yield part, pa.array(_score(part.column("text"), model) < 0.5)

    return _tables.filtered(docs, keep)
