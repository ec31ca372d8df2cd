"""The walking-network views that the queries run on, derived from the given tables.

No geodata comes with the tables, so a street grid is derived: parts are nodes of
a 50-wide grid with 100 m spacing, edges join neighbours in both directions, and
attributes are modular arithmetic on the end nodes.  Orders are walks of eight
edges along a row, at a departure minute; origins are spread over all rows.  The same definitions stand in
``VIEWS`` as SQL, for oracles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDE = 50
#: Shade buckets: start minute, step and number.
START_MIN, STEP_MIN, BUCKETS = 480, 15, 50
LEG = 8
SPEED = 4000 / 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y in metres."""
    node = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(node.alias("node"), ((node % WIDE) * 100).alias("x"), (F.floor(node / WIDE) * 100).alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed grid edges; eid orders by (u, v): four places for each source node.

    The join is a merge: what Spark takes a column of nodes for by the size of its file is small enough to be broadcast long after its rows are too many for the driver.
    """
    own = nodes(spark, sf_dir).select(F.col("node").alias("u"))
    ends = nodes(spark, sf_dir).select(F.col("node").alias("v"))
    ways = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for k, d in enumerate((-WIDE, -1, 1, WIDE))])
    same_row = F.floor(F.col("u") / WIDE) == F.floor((F.col("u") + F.col("w.d")) / WIDE)
    out = (
        own.withColumn("w", F.explode(ways))
        .where(F.col("w.d").isin(-WIDE, WIDE) | same_row)
        .select("u", (F.col("u") + F.col("w.d")).alias("v"), (F.col("u") * 4 + F.col("w.k")).alias("eid"))
        .join(ends.hint("merge"), "v")
    )
    s = F.col("u") + F.col("v")
    return out.select(
        "eid", "u", "v",
        (500 + s * 37 % 1000).alias("len_dm"), (s * 53 % 256).alias("noise_q"), (s * 29 % 256).alias("surface_q"),
        (s * 71 % 256).alias("green_q"), (s * 101 % 256).alias("flags"), ((F.col("u") * 5 + F.col("v") * 3) % 256).alias("acc"),
        ((F.col("u") * 3 + F.col("v") * 11) % 41 - 20).alias("slope"),
    )


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trip, depart (minute of day) and origin node of every order's walk."""
    key = F.col("o_orderkey").cast("long")
    rows = table(spark, sf_dir, "part").agg((F.floor((F.max("p_partkey") + 1) / WIDE)).cast("long").alias("rows"))  # one row
    origin = (F.floor(key / 40) % F.col("rows")) * WIDE + key % 40
    return table(spark, sf_dir, "orders").crossJoin(F.broadcast(rows)).select(key.alias("trip"), (key * 7 % 1440).alias("depart"), origin.alias("origin"))


def steps(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(trip, depart, seq, eid): the edges of each walk in order; of the trips of ``only`` (trip) if it is given."""
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LEG - 1).cast("long"))).alias("seq")
    asked = walks(spark, sf_dir) if only is None else walks(spark, sf_dir).join(only, "trip", "left_semi")
    return asked.select("*", seq).select("trip", "depart", "seq", ((F.col("origin") + F.col("seq")) * 4 + 2).alias("eid"))


def trodden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip, depart, origin, copies) of every walk; rows that repeat a trip tread its edges as often."""
    return walks(spark, sf_dir).groupBy("trip", "depart", "origin").agg(F.count(F.lit(1)).alias("copies"))


def ways(walked: DataFrame) -> DataFrame:
    """(origin, copies, seq, eid): the edges of ``trodden`` walks in order, once for all walks that tread the same."""
    each = lambda n, name: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias(name)
    way = walked.select("origin", "copies").distinct().select("*", each(F.lit(LEG).cast("long"), "_seq")).select("*", each(F.col("copies"), "_copy"))
    return way.select("origin", "copies", (F.col("_seq") - 1).alias("seq"), ((F.col("origin") + F.col("_seq") - 1) * 4 + 2).alias("eid"))


def shade(eid, bucket):
    """The shade byte of an edge in a bucket."""
    return (eid * 37 + bucket * 11) % 256


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Street pieces with tags, of line items and their parts."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    kinds = F.create_map(*[F.lit(x) for pair in HIGHWAY_OF.items() for x in pair])
    stone = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(len(SURFACE_OF)))
    smooth = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(len(SMOOTH_OF)))
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("long").alias("way"), F.col("l_partkey").cast("long").alias("node"),
        F.nullif(pick(SURFACE_OF, stone), F.lit("")).alias("surface"), F.nullif(pick(SMOOTH_OF, smooth), F.lit("")).alias("smoothness"),
        kinds[F.col("l_returnflag")].alias("highway"),
        (F.col("l_orderkey") % 7 == 0).alias("informal"), F.col("l_quantity").cast("double").alias("length"), (F.col("l_partkey") % 25).cast("long").alias("district"),
    )


#: Tag values that line items stand for.
HIGHWAY_OF = {"A": "track", "N": "residential", "R": "path"}
SURFACE_OF = ["asphalt", "", "sett", "ground", "gravel", "cobblestone", "grass", "unheard_of"]
SMOOTH_OF = ["", "good", "bad", "horrible", "odd"]


def _choice(values: list[str], index: str) -> str:
    return "(CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"


#: The same views as SQL, in order of need.
VIEWS = {
    "nodes": "SELECT p_partkey::BIGINT AS node, (p_partkey % 50) * 100 AS x, (p_partkey // 50) * 100 AS y FROM part",
    "edges": """SELECT e.u * 4 + e.k AS eid, e.u, e.u + e.d AS v, 500 + (2 * e.u + e.d) * 37 % 1000 AS len_dm,
        (2 * e.u + e.d) * 53 % 256 AS noise_q, (2 * e.u + e.d) * 29 % 256 AS surface_q, (2 * e.u + e.d) * 71 % 256 AS green_q,
        (2 * e.u + e.d) * 101 % 256 AS flags, (e.u * 5 + (e.u + e.d) * 3) % 256 AS acc, (e.u * 3 + (e.u + e.d) * 11) % 41 - 20 AS slope
        FROM (SELECT n.node AS u, w.k, w.d FROM nodes n, (VALUES (0, -50), (1, -1), (2, 1), (3, 50)) w(k, d)
              WHERE w.d IN (-50, 50) OR n.node // 50 = CAST(floor((n.node + w.d) / 50.0) AS BIGINT)) e
        JOIN nodes m ON m.node = e.u + e.d""",
    "walks": "SELECT o_orderkey::BIGINT AS trip, o_orderkey * 7 % 1440 AS depart, (o_orderkey // 40 % (SELECT (max(p_partkey) + 1) // 50 FROM part)) * 50 + o_orderkey % 40 AS origin FROM orders",
    "steps": "SELECT trip, depart, seq, (origin + seq) * 4 + 2 AS eid FROM walks, (SELECT unnest(range(0, 8)) AS seq) s",
    "tagged": f"""SELECT l_orderkey::BIGINT AS way, l_partkey::BIGINT AS node,
        nullif({_choice(SURFACE_OF, f'(l_partkey + l_suppkey) % {len(SURFACE_OF)}')}, '') AS surface,
        nullif({_choice(SMOOTH_OF, f'(l_orderkey + l_linenumber) % {len(SMOOTH_OF)}')}, '') AS smoothness,
        CASE l_returnflag WHEN 'A' THEN 'track' WHEN 'N' THEN 'residential' WHEN 'R' THEN 'path' END AS highway,
        l_orderkey % 7 = 0 AS informal, l_quantity::DOUBLE AS length, (l_partkey % 25)::BIGINT AS district
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "cells": "SELECT vec_id AS row, (i - 1)::BIGINT AS col, embedding[i]::DOUBLE AS z FROM embeddings, (SELECT unnest(range(1, 65)) AS i) s",
    "park_nodes": "SELECT p_partkey::BIGINT AS node, p_partkey % 50 * 100 + p_partkey * 37 % 61 - 30 AS x, p_partkey // 50 * 100 + p_partkey * 53 % 61 - 30 AS y FROM part",
    "park_paths": """SELECT a.node * 2 + w.k AS eid, a.node AS u, c.node AS v, a.x AS x1, a.y AS y1, c.x AS x2, c.y AS y2,
        CAST(floor(sqrt(((c.x - a.x) * (c.x - a.x) + (c.y - a.y) * (c.y - a.y))::DOUBLE) * 10 + 0.5) AS BIGINT) AS len_dm,
        (a.node + c.node) * 53 % 256 AS noise, (a.node * 29 + c.node * 13) % 256 AS deep, 199 + (a.node * 17 + c.node * 5) % 57 AS green, (a.node + c.node * 3) * 31 % 120 AS surface,
        (a.node * 11 + c.node * 7) % 10 = 0 AS street
        FROM park_nodes a JOIN (VALUES (0, 1), (1, 50)) w(k, d) ON w.d = 50 OR a.node % 50 < 49 JOIN park_nodes c ON c.node = a.node + w.d
        WHERE (a.node * 7919 + c.node * 104729) % 997 % 100 < 80""",
    "fixes": "SELECT user_id AS session, event_id, epoch_us(ts) // 1000 AS t, value::DOUBLE AS off_m, event_type AS action, ts FROM events",
}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster cells (row, col, z), one raster row per embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "z")).select("row", F.col("col").cast("long"), F.col("z").cast("double"))


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position fixes (session, event_id, t in ms, off_m, action, ts), one per event."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("t"), F.col("value").cast("double").alias("off_m"), F.col("event_type").alias("action"), "ts"
    )


def park_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, x, y in metres: grid nodes moved by up to 30 m, so that no two faces are alike and no two paths cross."""
    node = F.col("p_partkey").cast("long")
    return table(spark, sf_dir, "part").select(node.alias("node"), (node % WIDE * 100 + node * 37 % 61 - 30).alias("x"), (F.floor(node / WIDE) * 100 + node * 53 % 61 - 30).alias("y"))


def park_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of a park, each once: grid neighbours, four of five of them, with straight lengths and weights in 0 to 255."""
    n = park_nodes(spark, sf_dir)
    ways = F.explode(F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for k, d in ((0, 1), (1, WIDE))])).alias("w")
    a = n.select(F.col("node").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"), ways).where((F.col("w.d") == WIDE) | (F.col("u") % WIDE < WIDE - 1))
    a = a.select("u", "x1", "y1", (F.col("u") + F.col("w.d")).alias("v"), (F.col("u") * 2 + F.col("w.k")).alias("eid"))
    e = a.join(n.toDF("v", "x2", "y2"), "v").where((F.col("u") * 7919 + F.col("v") * 104729) % 997 % 100 < 80)
    u, v = F.col("u"), F.col("v")
    apart = F.sqrt((F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)).cast("double"))
    return e.select(
        "eid", "u", "v", "x1", "y1", "x2", "y2", F.floor(apart * 10 + 0.5).alias("len_dm"), ((u + v) * 53 % 256).alias("noise"), ((u * 29 + v * 13) % 256).alias("deep"),
        (199 + (u * 17 + v * 5) % 57).alias("green"), ((u + v * 3) * 31 % 120).alias("surface"), ((u * 11 + v * 7) % 10 == 0).alias("street"),
    )


def park_tags(paths: DataFrame) -> DataFrame:
    """``paths`` with the tags that access modes read: surface, smoothness and highway, and the share in a wood."""
    u, v = F.col("u"), F.col("v")
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return paths.withColumns({
        "ground": pick(["asphalt", "ground", "", "gravel", "woodchips"], (u * 3 + v) % 5), "wood": ((u * 13 + v * 5) % 40 == 0).cast("double"),
        "smoothness": F.when((u * 19 + v * 3) % 97 == 0, "bad").otherwise("good"), "highway": F.when((u * 23 + v * 7) % 89 == 0, "steps").when(F.col("street"), "residential").otherwise("path"),
    })


def with_views(sql: str) -> str:
    """``sql`` with the views it names as common table expressions."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                need(VIEWS[name])

    need(sql)
    head = ", ".join(f"{n} AS ({v})" for n, v in VIEWS.items() if n in wanted)
    body = sql.strip()
    if not head:
        return body
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
