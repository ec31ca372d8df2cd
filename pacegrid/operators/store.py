"""Tables that loops write to the shared folder: lineage ends there, and what is no longer needed goes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or "file:///tmp/pacegrid-checkpoints").rstrip("/")


def stored(df: DataFrame, name: str, instead: DataFrame | None = None, by: str | None = None) -> DataFrame:
    """The rows written, in a folder for each value of ``by``, and read back; ``instead`` is a stored table that nothing needs once this one is written."""
    path = f"{shared_dir(df.sparkSession)}/pacegrid-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    drop(instead)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes stored tables; what is no stored table stays."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
