"""Language of whole texts by averaged hashed subword embeddings.

A text is its runs of letters in lower case with a blank on both sides.  Its subwords
are the runs of 1 to ``LONGEST`` bytes within a word and its blanks, and every whole word;
each is hashed to one of ``BUCKETS`` embeddings.  The mean of a text's embeddings goes
through a linear softmax.  Embeddings and weights are trained together by stochastic
gradient descent in numpy on a bounded sample, and the logits are divided by a
temperature that suits rows that the descent has not seen, so that scores are chances.
The same rows give the least score at which a text's language may be called known:
``rejected`` texts, of other languages or of junk, score less.

As the softmax is linear in the mean, what scoring needs of an embedding is its product with
the weights: a table of a few numbers for each bucket and language.

Training rows: at most ``EACH`` different texts of each language, the first by hash, of at
most ``_tables.MOST_BYTES`` bytes; one of ``UNSEEN`` of them only calibrates.  Every
text is scored whole.

Defined results: a null text or one without a letter is ``und``, score 0 and rejected;
without any training row all texts are ``und``.  Ties go to the first language by code point.
Equal texts get equal results, rows may repeat, ids may be null (those train, as their
remainder is not the held-out one, and are not held out).  Other columns than doc_id, text and lang are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _text

UNKNOWN = "und"
#: Training texts of a language, at most.
EACH = 1_000
UNSEEN = 4
BUCKETS, WIDE, LONGEST = 1 << 16, 16, 4
PASSES, BATCH, RATE = 6, 16, 8.0
#: Of calibration texts that are not rejected, at most this share may be wrong, and of the right ones this share is kept at least.
WRONG, KEPT = 0.005, 0.98
SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLANK = 32


def letters(column: pa.Array) -> pa.Array:
    """Runs of letters in lower case, each behind one blank, and a blank at the end; texts without a letter are one blank."""
    blank, none = (pa.scalar(x, pa.large_string()) for x in (" ", ""))
    framed = pc.binary_join_element_wise(blank, column.cast(pa.large_string()).fill_null(""), blank, none)
    return pc.utf8_lower(pc.replace_substring_regex(framed, r"[^\p{L}\p{M}]+", " "))


def _buckets(key: np.ndarray) -> np.ndarray:
    return ((key * _BASE) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def subwords(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, offsets of rows) for each length of runs, and for whole words."""
    raw, bounds = _text.text_bytes(letters(column))
    n = len(raw)
    space = raw == _BLANK
    padded = np.concatenate([raw, np.full(8, _BLANK, np.uint8)]).astype(np.uint64)
    within = np.ones(n, bool)
    key = np.zeros(n, np.uint64)
    for size in range(1, LONGEST + 1):
        key |= padded[size - 1 : size - 1 + n] << np.uint64(8 * (size - 1))
        if size > 2:  # a run may begin and end with a blank, but not hold one
            within &= ~space[np.minimum(np.arange(size - 2, size - 2 + n), n - 1)] if n else within
        good = within & (~space if size == 1 else True)
        good &= np.arange(n) + size <= np.repeat(bounds[1:], np.diff(bounds))
        at = np.flatnonzero(good)
        yield _buckets(key[at] + (np.uint64(size) << np.uint64(56))), np.searchsorted(at, bounds)
    starts, ends, rows = _text.word_spans(raw, bounds)
    # a word's key is the sum of its bytes times powers of an odd number
    power = np.cumprod(np.full(int((ends - starts).max(initial=0)) + 1, _BASE | np.uint64(1), np.uint64))
    group, place = _text.ragged(ends - starts)
    value = padded[starts[group] + place] * power[place] if len(group) else np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    begin = np.cumsum(ends - starts) - (ends - starts)
    yield _buckets(total[begin + (ends - starts)] - total[begin]), rows


@dataclass
class Model:
    """Logits of a text: the mean over its subwords of ``table``'s rows, plus ``bias``, over ``heat``."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    heat: float
    least: float

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages), and the number of each text's subwords."""
        total, count = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        for bucket, rows in subwords(column):
            some = np.flatnonzero(np.diff(rows))
            if len(some):
                total[some] += np.add.reduceat(self.table[bucket], rows[some], axis=0)
            count += np.diff(rows)
        return total / np.maximum(count, 1)[:, None] + self.bias, count

    def predicted(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Index of the likeliest language (-1: none) and its calibrated chance."""
        raw, count = self.logits(column)
        count[~np.asarray(pc.match_substring_regex(column, r"\p{L}").fill_null(False))] = 0  # marks alone are no letters
        chance = softmax(raw / self.heat)
        best = chance.argmax(axis=1)
        return np.where(count > 0, best, -1), np.where(count > 0, chance[np.arange(len(best)), best], 0.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _some(column: pa.Array) -> Iterator[pa.Array]:
    """The column in runs of about ``SLICE_BYTES / 4``, which bounds the driver's arrays while it trains."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for part in _text.slices(batch, "text", SLICE_BYTES // 4):
        yield part.column("text")


def _counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's different buckets and their share of its subwords."""
    out = []
    for part in _some(column):
        parts = list(subwords(part))
        for i in range(len(part)):
            bucket, n = np.unique(np.concatenate([b[r[i] : r[i + 1]] for b, r in parts]), return_counts=True)
            out.append((bucket.astype(np.uint16 if BUCKETS <= 1 << 16 else np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def descended(texts: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(embeddings, weights, bias) after ``PASSES`` over the texts in small batches, with a rate that falls to nothing."""
    rng = np.random.default_rng(seed)
    # buckets that no training text has stay 0: unknown subwords pull the mean to where nothing is certain
    seen = np.unique(np.concatenate([b for b, _ in texts]))
    embed = np.zeros((BUCKETS, WIDE), np.float32)
    embed[seen] = rng.uniform(-1 / WIDE, 1 / WIDE, (len(seen), WIDE))
    weight, bias = np.zeros((WIDE, languages), np.float32), np.zeros(languages, np.float32)
    steps, step = PASSES * -(-len(texts) // BATCH), 0
    for _ in range(PASSES):
        order = rng.permutation(len(texts))
        for start in range(0, len(order), BATCH):
            chosen = order[start : start + BATCH]
            rate = RATE * (1 - step / steps)
            step += 1
            bucket = np.concatenate([texts[i][0] for i in chosen])
            share = np.concatenate([texts[i][1] for i in chosen])
            size = np.array([len(texts[i][0]) for i in chosen])
            first = np.cumsum(size) - size
            mean = np.add.reduceat(embed[bucket] * share[:, None], first, axis=0)
            wrong = softmax(mean @ weight + bias)
            wrong[np.arange(len(chosen)), label[chosen]] -= 1
            wrong /= len(chosen)
            back = (wrong @ weight.T).astype(np.float32)
            weight -= rate * (mean.T @ wrong)
            bias -= rate * 0.1 * wrong.sum(axis=0)
            # buckets that several texts of the batch share get the sum of what each asks for
            np.add.at(embed, bucket, (-rate * share)[:, None] * back[np.repeat(np.arange(len(chosen)), size)])
    return embed, weight, bias


def calibrated(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """(temperature, least score): the temperature of least loss, and the score under which texts are rejected."""
    if not len(raw):
        return 1.0, 0.0
    loss = lambda heat: -np.log(np.maximum(softmax(raw / heat)[np.arange(len(raw)), label], 1e-12)).mean()
    heat = min(2.0 ** np.arange(-4, 4.01, 0.25), key=loss)
    chance = softmax(raw / heat)
    score, right = chance.max(axis=1), chance.argmax(axis=1) == label
    order = np.argsort(-score, kind="stable")
    wrong = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(wrong <= WRONG)
    strict = score[order][fine[-1]] if len(fine) else 1.0
    lenient = np.quantile(score[right], 1 - KEPT) if right.any() else 0.0
    return float(heat), float(min(strict, lenient))


def trained(texts: pa.Array, languages: list[str], label: np.ndarray) -> Model:
    """The model of labelled texts, the same for the same rows in the same order."""
    counted = _counted(texts)
    some = np.array([len(b) > 0 for b, _ in counted], bool)
    apart = np.arange(len(counted)) % UNSEEN == 0
    rows = np.flatnonzero(some & ~apart) if (some & ~apart).any() else np.flatnonzero(some)
    embed, weight, bias = descended([counted[i] for i in rows], label[rows], len(languages))
    model = Model(languages, (embed @ weight).astype(np.float64), bias.astype(np.float64), 1.0, 0.0)
    unseen = np.flatnonzero(some & apart)
    if len(unseen):
        raw = np.concatenate([model.logits(part)[0] for part in _some(texts.take(pa.array(unseen)))])
        model.heat, model.least = calibrated(raw, label[unseen])
    return model


def _held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, each: int) -> pa.Table:
    """(lang, text) of at most ``each`` different texts of each language, in a fixed order."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out() & (F.octet_length("text") <= _tables.MOST_BYTES))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("_hash"))
    first = Window.partitionBy("lang").orderBy("_hash")
    # of a language with many texts only those with the least hashes are ranked, some times ``each`` of them, so that no task gets a language whole
    many = rows.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("_many"))
    low = (F.col("_hash").cast("double") + 2.0**63) / 2.0**64 < 4 * each / F.col("_many")
    near = rows.select("lang", "_hash").join(F.broadcast(many), "lang").where(low).select("lang", "_hash")  # a row for each language
    chosen = near.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= each).drop("_n")
    # a broadcast of `each` pairs a language
    picked = rows.join(F.broadcast(chosen), ["lang", "_hash"]).groupBy("lang", "_hash").agg(F.min("text").alias("text"))
    return picked.toArrow().combine_chunks().sort_by([("_hash", "ascending"), ("lang", "ascending")])


def fit(docs: DataFrame, each: int = EACH) -> Model | None:
    rows = training_rows(docs, each)
    names = sorted(set(rows["lang"].to_pylist()))
    column = rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string())
    if not len(column) or not pc.any(pc.match_substring_regex(column, r"\p{L}")).as_py():
        return None
    at = {name: i for i, name in enumerate(names)}
    return trained(column, names, np.array([at[x] for x in rows["lang"].to_pylist()]))


def language_id(docs: DataFrame, each: int = EACH) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, each))  # BUCKETS numbers a language
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for batch in batches:
            for part in _text.slices(batch, "text", SLICE_BYTES):
                if known is None:
                    best, score, names, least = np.full(part.num_rows, -1), np.zeros(part.num_rows), [], 0.0
                else:
                    (best, score), names, least = known.predicted(part.column("text")), known.languages, known.least
                told = pa.array([*names, UNKNOWN], pa.string()).take(pa.array(np.where(best < 0, len(names), best)))
                rejected = pa.array((best < 0) | (score < least))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), told, pa.array(score), rejected], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return rows.select("doc_id", "text", _held_out().alias("held_out")).mapInArrow(_tables.tidy(run), schema)
