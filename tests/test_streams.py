"""The sender's queue against a plain simulation, in one batch and in many; the ray march against single rays."""

import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pacegrid.operators import raster
from pacegrid.streaming import fixes, senders


def simulated(calls, ready, end):
    """Deliveries up to ``end``, millisecond events in order: a clock with one timer."""
    queue, retry, timer, out = [], 0, None, []
    todo = sorted(calls)
    while todo or (timer is not None and timer <= end):
        if timer is not None and (not todo or timer <= todo[0][0]):
            now, timer, retry = timer, None, retry + 1
            if now >= ready:
                out += [(e, now) for e in queue]
                queue = []
            elif retry == 5:
                queue = []
            else:
                timer = now + 1000 * 2**retry
        else:
            now, event = todo.pop(0)
            if now >= ready:
                out += [(e, now) for e in queue] + [(event, now)]
                queue = []
                continue
            if len(queue) < 32:
                queue.append(event)
            if timer is None and retry < 5:
                timer = now + 1000 * 2**retry
    return sorted(out)


@given(st.lists(st.integers(0, 60_000), max_size=60), st.integers(0, 70_000), st.integers(0, 90_000))
@settings(max_examples=150, deadline=None)
def test_queue_equals_a_simulation(times, ready, end):
    calls = [(t, i) for i, t in enumerate(sorted(times))]
    line, out = senders.Line([], 0, None), []
    for t, event in calls:
        out += line.until(t, ready)
        out += line.call(event, t, ready)
    out += line.until(end, ready)
    assert sorted(out) == simulated(calls, ready, end) and len(line.waiting) <= 32


def test_stream_delivers_the_same_in_many_batches(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(int(s), 1000 * int(s) + i, int(t), int(1000 * s % 40_000)) for s in range(12) for i, t in enumerate(sorted(rng.integers(0, 50_000, 45)))]
    # a late call of another session moves the watermark past all retries
    rows += [(99, 99_000, 2_000_000, 0)]
    for k, part in enumerate(np.array_split(np.array(sorted(rows, key=lambda r: r[2])), 5)):
        spark.createDataFrame([tuple(map(int, r)) for r in part], "session long, event_id long, t long, ready long").coalesce(1).write.parquet(f"file://{tmp_path}/calls/{k}.parquet")
    want = set()
    for s in range(12):
        own = [(t, e) for session, e, t, _ in rows if session == s]
        want |= {(s, e, at) for e, at in simulated(own, 1000 * s % 40_000, 10**6)}
    want.add((99, 99_000, 2_000_000))
    schema = "session long, event_id long, t long, ready long"
    for each in (1, 100):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", each).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/calls")
        out = fixes.drained(senders.delivered(stream.withColumn("ts", F.timestamp_millis("t"))), "append", "test-deliveries")
        assert {tuple(r) for r in out.select("session", "event_id", "at").collect()} == want


def test_march_by_single_rays(spark):
    rng = np.random.default_rng(3)
    z = rng.random((60, 50)) * 3
    z[30, 20:30], z[10:14, 40] = 25, 40
    z[5, 5] = np.nan
    cells = spark.createDataFrame([(i, j, None if math.isnan(z[i, j]) else float(z[i, j])) for i in range(60) for j in range(50)], "row long, col long, z double").cache()

    def plain(azimuth, elevation, ground):
        steps, size, rise = raster.march(elevation, ground)
        right, down = math.sin(math.radians(azimuth)) * size, -math.cos(math.radians(azimuth)) * size
        out = np.zeros(z.shape, bool)
        for i in range(60):
            for j in range(50):
                for k in range(1, steps + 1):
                    y, x = math.floor(i + 0.5 + k * down), math.floor(j + 0.5 + k * right)
                    if math.isnan(z[i, j]) or not (0 <= y < 60 and 0 <= x < 50):
                        break
                    if z[y, x] > z[i, j] + 0.05 + k * rise:
                        out[i, j] = True
                        break
        return out

    for azimuth, elevation, tile in ((215.0, 30.0, 16), (10.0, 12.0, 64), (290.0, 50.0, 7)):
        found = raster.marched(cells, azimuth, elevation, 2.0, tile).toPandas()
        assert len(found) == z.size and (found.pivot(index="row", columns="col", values="shaded").to_numpy() == plain(azimuth, elevation, 2.0)).all()
    assert raster.marched(cells, 100.0, -3.0, 2.0).where("NOT shaded").isEmpty()
    assert raster.march(1.0, 0.5)[:2] == (400, 2.0) and raster.march(30.0, 1.0)[:2] == (104, 1.0)
    # not the running horizon: its rays go on beyond the reach
    whole = raster.shadows(cells.where("z IS NOT NULL"), 215.0, 30.0, 2.0).where("shaded").count()
    assert whole != raster.marched(cells, 215.0, 30.0, 2.0).where("shaded").count()
