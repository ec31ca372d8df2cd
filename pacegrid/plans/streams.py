"""Queries over streams, run until their input is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.registry import query
from pacegrid.streaming import fixes, senders

C = F.col


@query("""WITH f AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS t, value > 200 AS off_route FROM events), g AS (SELECT *, sum(CASE WHEN off_route THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY t) AS back FROM f),
    r AS (SELECT *, min(t) OVER (PARTITION BY session, back) AS since FROM g WHERE off_route) SELECT session, min(t) AS t FROM r WHERE t - since >= 10000 GROUP BY session, back""")
def stream_off_route(spark, sf_dir):
    """When sessions have been off their route long enough, by keyed state."""
    events = fixes.source(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    t = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 1000)
    return fixes.drained(fixes.off_route(events.select(C("user_id").alias("session"), t.alias("t"), C("ts").cast("timestamp").alias("ts"), C("value").alias("off_m"))), "append", "off-route")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Hourly windows over the events as they come, each given out once, when the watermark has passed it."""
    events = fixes.source(spark, f"{sf_dir.rstrip('/')}/events.parquet")
    out = fixes.drained(fixes.windows(events.withColumn("ts", C("ts").cast("timestamp"))), "append", "windows")
    return out.select(C("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


@query("SELECT user_id AS session, min(epoch_us(ts) // 1000) AS asked_from, max(epoch_us(ts) // 1000) AS asked_to, count(*) FILTER (event_type = 'error') > 0 AS failed, arg_max(event_type, ts) AS last_action FROM events GROUP BY user_id")
def session_demand(spark, sf_dir):
    """The span that a session asks for, its last action, and whether it failed."""
    e = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet")
    t = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 1000)
    return e.groupBy(C("user_id").alias("session")).agg(
        F.min(t).alias("asked_from"), F.max(t).alias("asked_to"), (F.count(F.when(C("event_type") == "error", 1)) > 0).alias("failed"), F.max(F.struct("ts", "event_type"))["event_type"].alias("last_action"),
    )


#: An hour of the table stands for a second of the queue's clock.
_CALLS = """calls AS (SELECT user_id AS session, event_id, epoch_us(ts) // 3600000 AS t FROM events),
    ready AS (SELECT session, min(t) + session * 37 % 50 * 1000 AS ready FROM calls GROUP BY session), c AS (SELECT calls.*, ready FROM calls JOIN ready USING (session)),
    first AS (SELECT session, min(t) AS t0, any_value(ready) AS ready FROM c WHERE t < ready GROUP BY session),
    due AS (SELECT session, min(t0 + 1000 * (2 ** k - 1)::BIGINT) FILTER (t0 + 1000 * (2 ** k - 1)::BIGINT >= ready) AS sent, max(t0 + 31000) AS given_up FROM first, unnest(range(1, 6)) r(k) GROUP BY session),
    waits AS (SELECT c.*, sent, given_up, row_number() OVER (PARTITION BY c.session, sent IS NULL AND t >= given_up ORDER BY t, event_id) AS place FROM c JOIN due ON due.session = c.session WHERE t < ready),
    up AS (SELECT session, min(t) AS up FROM c WHERE t >= ready GROUP BY session),
    sent AS (SELECT session, event_id, t AS moment FROM c WHERE t >= ready UNION ALL SELECT w.session, event_id, CASE WHEN sent IS NULL THEN up WHEN sent <= coalesce(up, sent) THEN sent ELSE up END FROM waits w LEFT JOIN up ON up.session = w.session WHERE place <= 32 AND (sent IS NOT NULL OR t >= given_up))"""


@query(f"WITH {_CALLS} SELECT session, event_id, moment FROM sent WHERE moment IS NOT NULL AND (moment + 1 < (SELECT max(t) FROM calls) - 600000 OR EXISTS (SELECT 1 FROM calls c WHERE c.session = sent.session AND c.t >= moment))")
def stream_deliveries(spark, sf_dir):
    """Calls that reach a sender which is not there at first: 32 wait at most, five retries with doubling delays, then what waits is given up."""
    path = f"{sf_dir.rstrip('/')}/events.parquet"
    t = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 3_600_000)
    held = spark.read.parquet(path).select(C("user_id").alias("session"), t.alias("t"))
    ready = held.groupBy("session").agg((F.min("t") + C("session") * 37 % 50 * 1000).alias("ready"))
    calls = fixes.source(spark, path).select(C("user_id").alias("session"), "event_id", t.alias("t")).join(ready, "session")
    out = fixes.drained(senders.delivered(calls.withColumn("ts", F.timestamp_millis("t"))), "append", "deliveries")
    return out.select("session", "event_id", C("at").alias("moment"))
