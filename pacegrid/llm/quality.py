"""Document quality by co-training on two views.

The text view sees the wording: square roots of hashed byte-trigram shares.
The metadata view sees the record and never the text: language, source and stated
length.  Each view is a logistic regression.  In every round both views score all
documents without a label on Spark; of those that a view is surest of, up to
``HANDED`` for each class and each of ``STRATA`` groups of language and source are
handed to the *other* view, which learns from them.  Afterwards each view is
calibrated on labelled documents that neither has learnt from, and a logistic curve
over both calibrated views scores every document.

Only feature vectors of a fixed size come to the driver: those of the bounded sample
of labelled documents and of the documents handed over.

Defined results: null texts are empty and empty texts have all-zero wording;
null metadata is a value of its own; repeated rows score alike; ties in confidence
go by a hash of doc_id; very long texts are one row of counts like others; without
labels of both classes every document gets the share of good labels seen (1 without
any), so nothing is rejected on no evidence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pacegrid.llm import _tables, _text

#: Bounds of the labelled sample, in documents.
MOST_POOR, MOST_GOOD = 1500, 2500
CALIBRATION_FOLD = 1
DIMENSIONS = 2048
ROUNDS = 3
#: Documents of each class and stratum that one view hands to the other in a round, and the least confidence.
HANDED, STRATA, SURE = 10, 16, 0.95
MOST_ROWS = 500
SLICE_BYTES = 2 << 20
METADATA = ("lang", "source", "n_chars")
_BUCKETS = 32
_OCTAVES = 24


@dataclass
class View:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    calibration: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0]))

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.spread) @ self.weights[1:] + self.weights[0]
        return self.calibration[0] + self.calibration[1] * z


@dataclass
class Model:
    text: View | None = None
    meta: View | None = None
    joint: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.5, 0.5]))
    prior: float = 1.0


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def wording(column: pa.Array) -> np.ndarray:
    """(rows, DIMENSIONS) square roots of hashed byte-trigram shares."""
    raw, bounds = _text.text_bytes(column)
    n = len(bounds) - 1
    if len(raw) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    wide = raw.astype(np.uint32)
    mixed = (wide[:-2] * np.uint32(0x9E3779B1)) ^ (wide[1:-1] * np.uint32(0x85EBCA6B)) ^ (wide[2:] * np.uint32(0xC2B2AE35))
    slot = ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
    size = np.maximum(np.diff(bounds) - 2, 0)
    group, place = _text.ragged(size)
    counts = np.bincount(group * DIMENSIONS + slot[bounds[:-1][group] + place], minlength=n * DIMENSIONS)
    return np.sqrt(counts.reshape(n, DIMENSIONS) / np.maximum(size, 1)[:, None]).astype(np.float32)


def record(batch: pa.RecordBatch) -> np.ndarray:
    """(rows, features) of the metadata columns; the text is not read."""
    columns = [np.ones(batch.num_rows)]
    for name in METADATA:
        if name not in batch.schema.names:
            continue
        values = batch.column(name).to_pylist()
        if name == "n_chars":
            size = np.log2(np.array([1.0 if v is None else 1.0 + max(0.0, float(v)) for v in values]))
            columns += [size, size * size, np.array([v is None for v in values])]
            columns += list((np.minimum(size, _OCTAVES - 1).astype(int)[None, :] == np.arange(_OCTAVES)[:, None]))
            continue
        known = {v: zlib.crc32(repr(v).encode()) % _BUCKETS for v in set(values)}
        columns += list(np.eye(_BUCKETS)[[known[v] for v in values]].T if values else np.zeros((_BUCKETS, 0)))
    return np.stack([np.asarray(c, np.float32) for c in columns], axis=1)


def _learn(x: np.ndarray, y: np.ndarray, start: View | None, steps: int, ridge: float = 3e-4) -> View:
    """Class-balanced logistic regression by Adam steps over all rows."""
    mean, spread = (x.mean(axis=0), x.std(axis=0) + 1e-3) if start is None else (start.mean, start.spread)
    z = x - mean
    z /= spread
    weight = np.where(y > 0.5, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32) if start is None else start.weights.copy()
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        slack = (_sigmoid(z @ w[1:] + w[0]) - y).astype(np.float32) * weight
        gradient = np.concatenate([[slack.sum()], z.T @ slack + ridge * w[1:]]).astype(np.float32)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient * gradient
        w = w - 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return View(mean, spread, w)


def _columns(docs: DataFrame) -> list[str]:
    return ["doc_id", "text", *[c for c in METADATA if c in docs.columns]]


def _vectors(rows: DataFrame, extra: str) -> dict:
    """On the driver: the feature vectors of ``rows`` (a bounded choice), with the columns ``extra``, by doc_id."""
    names = [e.split()[0] for e in extra.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                views = [pa.array([v.tobytes() for v in x(y)], pa.binary()) for x, y in ((wording, part.column("text")), (record, part))]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *views], [*names, "text_view", "meta_view"])

    found = rows.mapInArrow(_tables.tidy(run), f"{extra}, text_view binary, meta_view binary").toArrow().to_pydict()
    order = sorted(range(len(found["doc_id"])), key=lambda i: (found["doc_id"][i], found["text_view"][i]))
    out = {n: [found[n][i] for i in order] for n in names}
    for view in ("text", "meta"):
        vectors = [np.frombuffer(found[f"{view}_view"][i], np.float32) for i in order]
        out[view] = np.stack(vectors) if vectors else np.zeros((0, 1), np.float32)
    return out


def _confident(docs: DataFrame, unmarked: DataFrame, taught: dict[str, View], given: dict[str, dict]) -> DataFrame:
    """(doc_id, _view, _class) of what views hand over in a round: the surest documents of every stratum, of all documents without a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                p = [_sigmoid(taught["text"].logit(wording(part.column("text")))), _sigmoid(taught["meta"].logit(record(part)))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_stratum"), *(pa.array(x.astype(float)) for x in p)], ["doc_id", "_stratum", "text", "meta"])

    strata = [F.col(c).cast("string") for c in ("lang", "source") if c in docs.columns]
    rows = docs.select(*_columns(docs), F.pmod(F.xxhash64(*strata) if strata else F.lit(0).cast("long"), F.lit(STRATA)).alias("_stratum"))
    scored = rows.mapInArrow(_tables.tidy(run), "doc_id long, _stratum long, text double, meta double")
    each = scored.join(unmarked, "doc_id", "left_semi").select(
        "doc_id", "_stratum", F.explode(F.array(*[F.struct(F.lit(v).alias("view"), F.col(v).alias("p")) for v in taught])).alias("_x")
    )
    sure = each.select("doc_id", "_stratum", F.col("_x.view").alias("_view"), (F.col("_x.p") > 0.5).cast("int").alias("_class"), F.greatest("_x.p", 1 - F.col("_x.p")).alias("_sure")).where(F.col("_sure") >= SURE)
    spark = docs.sparkSession
    # rows handed over before: bounded by what all rounds may hand over
    before = [(k, {"text": "meta", "meta": "text"}[other]) for other, rows in given.items() for k in rows]
    sure = sure.join(F.broadcast(spark.createDataFrame(before, "doc_id long, _view string")), ["doc_id", "_view"], "left_anti")
    best = Window.partitionBy("_view", "_class", "_stratum").orderBy(F.desc("_sure"), F.xxhash64("doc_id"), "doc_id")
    return sure.distinct().withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= HANDED).select("doc_id", "_view", "_class")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Both views, taught in folds 2 to 4 and by each other, calibrated in fold 1."""
    picked = _tables.labelled_rows(docs, labels, "quality", {0: MOST_POOR, 1: MOST_GOOD}, _columns(docs)[1:])
    sample = _vectors(picked, "doc_id long, _label int, _fold int")
    y, ahead = np.array(sample["_label"], float), np.array(sample["_fold"], int) == CALIBRATION_FOLD
    # the sample takes classes in other shares than the labels have: the prior comes from all labels that may teach
    seen = labels.where(F.col("quality").isin(0, 1) & (_tables.fold() != 0)).agg(F.avg("quality")).first()[0]
    model = Model(prior=1.0 if seen is None else float(seen))
    if any(len(set(y[part])) < 2 for part in (ahead, ~ahead)):
        return model
    views = {"text": sample["text"], "meta": sample["meta"]}
    taught = {name: _learn(x[~ahead], y[~ahead], None, 150) for name, x in views.items()}
    marked = labels.where(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    unmarked = _tables.stored(docs.select("doc_id").where("doc_id IS NOT NULL").distinct().join(marked, "doc_id", "left_anti"), "quality-unmarked")
    given: dict[str, dict[int, tuple[float, np.ndarray]]] = {"text": {}, "meta": {}}
    for _ in range(ROUNDS):
        chosen = _tables.stored(_confident(docs, unmarked, taught, given), "quality-handed")
        # bounded: HANDED rows for each of 2 views, 2 classes and STRATA strata
        handed = _vectors(_tables.once(docs.select(*_columns(docs)).join(F.broadcast(chosen), "doc_id"), _columns(docs)[1:]), "doc_id long, _view string, _class int")
        if not handed["doc_id"]:
            break
        for i, (key, view, value) in enumerate(zip(handed["doc_id"], handed["_view"], handed["_class"])):
            other = "meta" if view == "text" else "text"
            given[other].setdefault(key, (float(value), handed[other][i]))
        for name, x in views.items():
            more = [given[name][k] for k in sorted(given[name])]
            if more:
                both = np.concatenate([x[~ahead], np.stack([v for _, v in more])])
                taught[name] = _learn(both, np.concatenate([y[~ahead], [value for value, _ in more]]), taught[name], 50)
    # calibration weights bring the sample back to the labels' own shares
    share = y[ahead].mean()
    draw = np.where(y[ahead] > 0.5, model.prior / share, (1 - model.prior) / (1 - share))
    for name, x in views.items():
        z = taught[name].logit(x[ahead])
        taught[name].calibration = _weighted(np.stack([np.ones(len(z)), z], axis=1), y[ahead], draw)
    z = np.stack([np.ones(int(ahead.sum())), *[taught[n].logit(views[n][ahead]) for n in ("text", "meta")]], axis=1)
    model.text, model.meta, model.joint = taught["text"], taught["meta"], _weighted(z, y[ahead], draw)
    del sample, views, given
    _tables.release()
    return model


def _weighted(x: np.ndarray, y: np.ndarray, draw: np.ndarray) -> np.ndarray:
    root = np.zeros(x.shape[1])
    for _ in range(60):
        p = _sigmoid(x @ root)
        hessian = (x * (draw * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(root))
        step = np.linalg.solve(hessian, x.T @ (draw * (y - p)) - 1e-2 * root)
        root += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return root


def _scores(part: pa.RecordBatch, model: Model) -> list[np.ndarray]:
    """Probabilities of good quality by the text view, the metadata view and both."""
    if model.text is None or model.meta is None:
        return [np.full(part.num_rows, model.prior)] * 3
    a, b = model.text.logit(wording(part.column("text"))), model.meta.logit(record(part))
    return [_sigmoid(z).astype(float) for z in (a, b, model.joint[0] + model.joint[1] * a + model.joint[2] * b)]


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for whole in _text.slices(batch, "text", SLICE_BYTES):
        for start in range(0, whole.num_rows, MOST_ROWS):
            yield whole.slice(start, MOST_ROWS)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, the two views' scores, score and kept (score of 0.5 or more)."""
    columns = _columns(docs)
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, _scores(part, model))], ["doc_id", "text_score", "meta_score", "score"])

    scored = docs.select(*columns).mapInArrow(_tables.tidy(run), "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", (_tables.fold() == 0).alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that score below 0.5."""
    model = fit(docs, labels)

    def keep(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        for part in _parts(batch):
            yield part, pa.array(_scores(part, model)[2] >= 0.5)

    return _tables.filtered(docs, keep)
