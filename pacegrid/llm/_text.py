"""Array kernels over whole columns of text, shared by the corpus operators.

A batch of texts is one UTF-8 byte array plus row offsets; words are runs of
bytes outside ``WHITESPACE`` (space and 0x09-0x0D, i.e. the pattern
``[^\\x20\\x09-\\x0D]+``).  Nulls are empty texts here; callers that need to
tell the two apart read the validity of the Arrow column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WHITESPACE = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(WHITESPACE)] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

#: Rows of a batch are handed on in slices of about so many text bytes, which
#: bounds a Python worker's arrays; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets (n + 1); nulls are empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    bounds = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset :]
    raw = np.frombuffer(data, np.uint8, count=int(bounds[-1]))[int(bounds[0]) :]
    return raw, bounds - bounds[0]


def strings(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The rows as a new string column, from its first byte on, without nulls."""
    buffers = [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]
    return pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, buffers)


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in order, in runs of rows of about ``most`` text bytes."""
    if batch.num_rows == 0:
        return
    _, bounds = text_bytes(batch.column(text))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(bounds, bounds[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def fold_case(raw: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, other bytes as they are."""
    return _FOLD[raw]


def word_spans(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of each word, and row offsets (n + 1) into the words."""
    ink = np.zeros(len(raw) + 2, dtype=bool)
    np.logical_not(_IS_SPACE[raw], out=ink[1:-1])
    begins = ink[1:-1] & ~ink[:-2]
    edges = bounds[1:-1]
    edges = edges[edges < len(raw)]
    begins[edges] |= ink[1:-1][edges]
    ends = ink[1:-1] & ~ink[2:]
    before = edges[edges > 0] - 1
    ends[before] |= ink[1:-1][before]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words, the word of each place in the texts, and row offsets into the places."""
    raw, bounds = text_bytes(column)
    starts, ends, rows = word_spans(raw, bounds)
    ink = raw[~_IS_SPACE[raw]]
    coded = strings(ink, np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows


def ragged(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths: each element's group and place in it."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    return group, np.arange(len(group)) - (np.cumsum(lengths) - lengths)[group]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each row's run; empty runs give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def code_points(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return row_sums((raw & 0xC0) != 0x80, bounds)
