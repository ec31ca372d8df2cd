"""Reading and sampling shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDS = 5
#: Longest text that comes to the driver as a training row, in bytes.
MOST_BYTES = 32 << 10
#: With it, shuffle files go when the write that made them is done, and not when the driver happens to collect its garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file:///tmp/pacegrid-checkpoints"  # one machine, as in tests
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/pacegrid-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends here, and shuffle files of the way there go.

    ``instead`` is a stored table that nothing needs any more once this one is written.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    if instead is not None:
        drop(instead)
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that no later step reads; what is no stored table stays."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(key: str = "doc_id"):
    """crc32 of the key's text, modulo ``FOLDS``; null keys are in fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % FOLDS, F.lit(0)).cast("int")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int], columns: list[str]) -> DataFrame:
    """``columns`` of at most ``most[c]`` labelled documents of each class, outside fold 0, with _label, _fold and _order.

    The choice is by hash of doc_id, so it is the same at every run; of rows that
    repeat a doc_id one counts (``once``).  Labels
    other than the keys of ``most`` are ignored, the highest of a document's
    labels counts, and rows without a doc_id are no training rows.
    """
    marks = (
        labels.where(F.col(label).isin(list(most)) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .withColumn("_fold", fold())
        .where("_fold <> 0")
        .withColumn("_order", F.xxhash64("doc_id"))
    )
    chosen = None
    for value, bound in most.items():
        part = marks.where(F.col("_label") == value).orderBy("_order", "doc_id").limit(bound)
        chosen = part if chosen is None else chosen.unionByName(part)
    # bounded by sum(most.values()) rows of four numbers
    return once(docs.select("doc_id", *columns).join(F.broadcast(chosen), "doc_id"), columns)


def once(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row of ``rows`` for each value of its other columns: that of the least hash of ``columns``, folded before anything is dealt out."""
    keys = [c for c in rows.columns if c not in columns]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in columns])


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> pa.Table:
    """``labelled_rows`` on the driver with whole texts; texts of more than ``MOST_BYTES`` bytes are no training rows."""
    picked = labelled_rows(docs, labels, label, most, ["text"]).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MOST_BYTES)
    return picked.toArrow().combine_chunks().sort_by([("_order", "ascending"), ("doc_id", "ascending")])


def release() -> None:
    """Hands freed memory back to the system: workers live on between tasks and stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: its memory stays with the process


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with memory handed back behind every batch."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(iter([batch]))
            batch = None
            release()

    return wrapped


def tidy_all(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow over a task's batches together, with memory handed back behind the last."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], Iterator[tuple[pa.RecordBatch, pa.Array]]]) -> DataFrame:
    """Rows of ``docs`` that ``keep`` says stay; columns as they are, whatever their names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, stays in keep(batch):
                yield part.filter(stays)

    return docs.mapInArrow(tidy(run), docs.schema)
