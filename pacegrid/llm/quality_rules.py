"""Quality rules: fixed base rules, then gradient-boosted trees over text statistics.

Statistics are counted over the whole text with array kernels; words are
``[^\\x20\\x09-\\x0D]+``.  The trees learn ``labels.quality`` and may only call a
document worse, never better, as symbols, repeats and repeated lines grow.

Defined results: a null or empty text has no words and fails the base rules;
repeated rows agree; without labels of both classes the trees reject nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _text, trees

LEAST_WORDS = 50
MOST_REPEAT_PERCENT = 50
#: Bounds of the training sample, in documents.
MOST_POOR, MOST_GOOD = 3000, 6000
SYMBOLS = b"#*$%&|<>"
WINDOW = 3
#: Name and constraint of each feature: -1 where more can only be worse.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1,
    "upper_share": 0, "digit_share": 0, "stop_share": 0, "exclaim_share": -1, "distinct_share": 0,
    "same_as_before": -1, "words_per_line": 0, "longest_word": 0,
}


def _repeats(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Words of each text that lie in windows of WINDOW words found twice or more in it.

    ``codes`` are equal where words are equal and only there, and so are the windows' keys.
    """
    size = np.maximum(np.diff(rows) - WINDOW + 1, 0)
    group, inside = _text.ragged(size)
    first = rows[:-1][group] + inside
    key = np.zeros(len(first), np.int64)
    for j in range(WINDOW if len(first) else 0):
        if int(key.max()) > (1 << 62) // (int(codes.max()) + 1):
            key = np.unique(key, return_inverse=True)[1]  # dense again: no overflow
        key = key * (int(codes.max()) + 1) + codes[first + j]
    order = np.lexsort((key, group))
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = (key[order][1:] == key[order][:-1]) & (group[order][1:] == group[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[order] = same[1:] | same[:-1]
    inked = np.zeros(len(codes) + WINDOW, bool)
    for j in range(WINDOW):
        inked[first[twice] + j] = True
    return _text.row_sums(inked[: len(codes)], rows)


def _repeated_lines(raw: np.ndarray, bounds: np.ndarray, ink: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word, and how many of them equal an earlier line."""
    n = len(bounds) - 1
    feeds = np.flatnonzero(raw == 10)
    # a text has one line more than line feeds; starts are text starts and places behind feeds
    per = _text.row_sums(raw == 10, bounds) + 1
    owner, nth = _text.ragged(per)
    before = np.cumsum(per) - per - np.arange(n)
    starts = np.where(nth == 0, bounds[:-1][owner], 0)
    later = nth > 0
    starts[later] = feeds[(before[owner] + nth - 1)[later]] + 1
    ends = np.where(nth == per[owner] - 1, bounds[1:][owner], 0)
    inner = nth < per[owner] - 1
    ends[inner] = feeds[(before[owner] + nth)[inner]]
    sums = np.concatenate([[0], np.cumsum(ink)])
    full = sums[ends] > sums[starts]
    owner, starts, ends = owner[full], starts[full], ends[full]
    size = ends - starts
    line, place = _text.ragged(size)
    lines = _text.strings(raw[starts[line] + place], np.concatenate([[0], np.cumsum(size)]))
    key = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((key, owner))
    again = np.zeros(len(order), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner, minlength=n), np.bincount(owner[order][again], minlength=n)


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of the contract, and the feature matrix of the trees."""
    raw, bounds = _text.text_bytes(column)
    ink = ~np.isin(raw, np.frombuffer(_text.WHITESPACE, np.uint8))
    _, codes, rows = _text.words(column)
    starts, ends, _ = _text.word_spans(raw, bounds)
    words = np.diff(rows)
    chars = _text.row_sums(ink & ((raw & 0xC0) != 0x80), bounds)
    symbols = _text.row_sums(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)), bounds)
    lines, again = _repeated_lines(raw, bounds, ink)
    repeats = _repeats(codes, rows)
    some, letters = np.maximum(words, 1), np.maximum(chars, 1)
    last = raw[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    owner = np.repeat(np.arange(len(words)), words)
    before = np.zeros(len(codes), bool)
    before[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
    order = np.lexsort((codes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (codes[order][1:] != codes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    longest = np.zeros(len(words), np.int64)
    np.maximum.at(longest, owner, ends - starts)
    matrix = [
        np.log1p(words), chars / some, symbols / some, again / np.maximum(lines, 1), repeats / some,
        _text.row_sums((raw >= 65) & (raw <= 90), bounds) / letters, _text.row_sums((raw >= 48) & (raw <= 57), bounds) / letters,
        _text.row_sums(np.isin(last, [46, 44, 59, 58]), rows) / some, _text.row_sums(np.isin(raw, [33, 63]), bounds) / some,
        np.bincount(owner[order][fresh], minlength=len(words)) / some, _text.row_sums(before, rows) / some, words / np.maximum(lines, 1), longest,
    ]
    counts = {"n_words": words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": again, "n_repeat_words": repeats}
    return counts, np.stack(matrix, axis=1).astype(float)


def fit(docs: DataFrame, labels: DataFrame) -> trees.Forest | None:
    """Trees from a bounded sample outside fold 0, weighted back to the labels' shares."""
    picked = _tables.labelled_rows(docs, labels, "quality", {0: MOST_POOR, 1: MOST_GOOD}, ["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                rows = statistics(part.column("text"))[1]
                yield pa.RecordBatch.from_arrays([part.column("_label"), part.column("_order"), pa.array(list(rows), pa.list_(pa.float64()))], ["_label", "_order", "_x"])

    # statistics alone come to the driver: a few numbers for each of at most MOST_POOR + MOST_GOOD documents
    sample = picked.mapInArrow(run, "_label int, _order long, _x array<double>").toArrow().to_pydict()
    order = sorted(range(len(sample["_order"])), key=lambda i: (sample["_order"][i], sample["_x"][i]))
    y = np.array([sample["_label"][i] for i in order], float)
    if len(set(y)) < 2:
        return None
    x = np.array([sample["_x"][i] for i in order])
    prior = float(labels.where(F.col("quality").isin(0, 1) & (_tables.fold() != 0)).agg(F.avg("quality")).first()[0])
    weight = np.where(y > 0.5, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return trees.fit(x, y, weight, np.array(list(FEATURES.values())))


def rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the trees' probability of good quality."""
    forest = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _text.slices(batch, "text"):
                counts, x = statistics(part.column("text"))
                score = forest.probability(x) if forest else np.ones(len(x))
                failed = (counts["n_words"] < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEAT_PERCENT * counts["n_words"])
                columns = [part.column("doc_id"), *map(pa.array, counts.values()), pa.array(failed), pa.array(~failed & (score >= 0.5)), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *counts, "base_failed", "kept", "score"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
