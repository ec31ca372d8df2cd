"""Streams of position fixes: off-route detection with state, and windows with a watermark."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

C = F.col
OFF_M, OFF_MS = 200, 10_000
#: A session that is silent for so long is over; its state goes.
SILENT_MS = 3_600_000
LATE = "10 minutes"


def shared(spark: SparkSession, name: str) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or "file:///tmp/pacegrid-checkpoints"
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def source(spark: SparkSession, path: str) -> DataFrame:
    """The files of a table as a stream; a pattern, so that a table may be one file or a folder of them."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def off_route(fixes: DataFrame) -> DataFrame:
    """(session, t): the moment when an unbroken run off the route has lasted OFF_MS, once per run.

    ``fixes`` has session, t (ms), ts (the same, as event time) and off_m.  State: when the run began, and whether
    it has been told.  Fixes of a session within a batch are taken in order of t.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, told = state.get if state.exists else (None, False)
        rows = pd.concat(list(pdfs)).sort_values("t", kind="stable") if not state.hasTimedOut else pd.DataFrame()
        out = []
        for t, off in zip(rows.get("t", ()), rows.get("off_m", ())):
            if not off > OFF_M:
                since, told = None, False
                continue
            since = t if since is None else since
            if not told and t - since >= OFF_MS:
                out.append((key[0], t))
                told = True
        if state.hasTimedOut:
            state.remove()
        else:
            state.update((None if since is None else int(since), bool(told)))
            state.setTimeoutTimestamp(max(int(rows["t"].max()), state.getCurrentWatermarkMs()) + SILENT_MS)
        if out:
            yield pd.DataFrame(out, columns=["session", "t"])

    kept = fixes.withWatermark("ts", LATE)
    return kept.groupBy("session").applyInPandasWithState(step, "session long, t long", "since long, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    """Events and mean value per window of event time and kind; later than LATE is dropped.

    In append mode a window is given out when the watermark has passed it, and its state goes.
    """
    kept = events.withWatermark("ts", LATE)
    return kept.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


def drained(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """All that the stream yields now, written to the shared folder and read back."""
    spark = stream.sparkSession
    path = shared(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    try:
        return spark.read.parquet(f"{path}/out").drop("batch")
    except Exception as none:  # no batch has written anything
        if "PATH_NOT_FOUND" not in str(none) and "UNABLE_TO_INFER" not in str(none):
            raise
        return spark.createDataFrame([], stream.schema)
