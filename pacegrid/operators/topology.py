"""Edits of a street network: nodes split where a street forks into its carriageways.

A node at the tip of a fork lets walkers cross a street that is split there for nothing.  What lies on
one side of the street gets a node of its own, and a link that counts as crossing without a crossing
joins both.  Which node is split, on what axis and what is rewired are rows; new numbers are the old
ones beyond the highest, so that no task has to count.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

C = F.col
# --- fixed values -----------------------------------------------------------
STREETS = ["residential", "unclassified", "living_street", "primary", "secondary", "tertiary", "trunk", "primary_link", "secondary_link", "tertiary_link", "trunk_link"]
#: Degrees between two carriageways, and between a street and its continuation; how much to one side a street must leave.
PAIR_DEG, ON_DEG, CLEAR = 40, 50, 0.05
SAME_NAME, ONE_WAYS, APART_M, LINK_M = 3, 2, 1.5, 15.0


def between(a: Column, b: Column) -> Column:
    """The angle between two bearings, 0 to pi."""
    d = F.pmod(F.abs(a - b), F.lit(2 * math.pi))
    return F.least(d, 2 * math.pi - d)


def incident(nodes: DataFrame, streets: DataFrame) -> DataFrame:
    """(node, eid, bearing, highway, name, oneway, crossing): every street at both of its ends, leaving there; loops have no direction."""
    rest = ["eid", "highway", "name", "oneway", "crossing"]
    ends = streets.where("u <> v").select(C("u").alias("node"), C("v").alias("_to"), *rest).unionByName(streets.where("u <> v").select(C("v").alias("node"), C("u").alias("_to"), *rest))
    at = ends.join(nodes.select("node", "x", "y"), "node").join(nodes.select(C("node").alias("_to"), C("x").alias("_x"), C("y").alias("_y")), "_to")
    return at.select("node", F.atan2(C("_y") - C("y"), C("_x") - C("x")).alias("bearing"), *rest)


def forks(nodes: DataFrame, streets: DataFrame) -> DataFrame:
    """(node, axis, moved): nodes to be split, the direction in which the street goes on, and the streets that move to the new node.

    A fork has three streets of one name, two of them one-way, and two that leave within ``PAIR_DEG``.  A node that is a
    crossing, or where a crossing ends, stays whole; so does one where a street leaves to neither side, or all to one.
    """
    every = incident(nodes, streets)
    crossed = every.where("crossing").select("node").unionByName(nodes.where("crossing").select("node")).distinct()
    free = every.join(crossed, "node", "left_anti")
    named = free.where(C("highway").isin(STREETS) & C("name").isNotNull() & (C("name") != ""))
    group = named.groupBy("node", "name").agg(F.array_sort(F.collect_list(F.struct("eid", "bearing"))).alias("own"), F.sum(F.when(C("oneway"), 1).otherwise(0)).alias("_ways"), F.min("eid").alias("first"))
    group = group.where((F.size("own") >= SAME_NAME) & (C("_ways") >= ONE_WAYS))
    # the first two, in order, that leave nearly the same way
    near = F.transform("own", lambda a, i: F.transform(F.filter("own", lambda b: (b["eid"] > a["eid"]) & (between(a["bearing"], b["bearing"]) < math.radians(PAIR_DEG))), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    paired = group.withColumn("pair", F.get(F.flatten(near), F.lit(0))).where("pair IS NOT NULL")
    a, b = C("pair.a.bearing"), C("pair.b.bearing")
    axis = F.atan2(F.sin(a) + F.sin(b), F.cos(a) + F.cos(b)) + math.pi
    held = paired.select("node", "first", "pair", axis.alias("axis")).join(free.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("eid", "bearing"))).alias("all")), "node")
    of_pair = lambda s: (s["eid"] == C("pair.a.eid")) | (s["eid"] == C("pair.b.eid"))
    off = F.filter("all", lambda s: of_pair(s) | (between(s["bearing"], C("axis")) >= math.radians(ON_DEG)))
    sided = held.withColumn("off", F.transform(off, lambda s: F.struct(s["eid"].alias("eid"), (F.cos("axis") * F.sin(s["bearing"]) - F.sin("axis") * F.cos(s["bearing"])).alias("side"))))
    clear = sided.where(F.forall("off", lambda s: F.abs(s["side"]) >= CLEAR)).withColumn("moved", F.transform(F.filter("off", lambda s: s["side"] < 0), lambda s: s["eid"]))
    good = clear.where((F.size("moved") > 0) & (F.size("moved") < F.size("all")))
    return good.groupBy("node").agg(F.min_by(F.struct("axis", "moved"), "first").alias("f")).select("node", "f.axis", "f.moved")


def split(nodes: DataFrame, streets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (node, x, y, crossing) and ``streets`` (eid, u, v, highway, name, oneway, crossing, metres) with forks split: (nodes, streets and ``link``).

    A node's twin has its number plus one more than the highest, and so has the link the number
    of its node beyond the highest street: no end of a street is without a node, and no number is taken twice.
    """
    found = forks(nodes, streets)
    top = nodes.agg((F.max("node") + 1).alias("_nodes")).join(streets.agg((F.max("eid") + 1).alias("_streets")))  # one row
    numbered = found.join(F.broadcast(top)).withColumns({"twin": C("node") + C("_nodes"), "link": C("node") + C("_streets")})
    place = nodes.join(numbered, "node").select(C("twin").alias("node"), (C("x") - F.sin("axis") * APART_M).alias("x"), (C("y") + F.cos("axis") * APART_M).alias("y"), "crossing")
    moved = numbered.select("node", "twin", F.explode("moved").alias("eid"))
    end = lambda c: moved.select(C("node").alias(c), "eid", C("twin").alias(f"_{c}"))
    rewired = streets.join(end("u"), ["u", "eid"], "left").join(end("v"), ["v", "eid"], "left").withColumns({"u": F.coalesce("_u", "u"), "v": F.coalesce("_v", "v")})
    columns = ["eid", "u", "v", "highway", "name", "oneway", "crossing", "metres"]
    kept = rewired.select(*columns, F.lit(False).alias("link"))
    new = numbered.select(C("link").alias("eid"), C("node").alias("u"), C("twin").alias("v"), F.lit("residential").alias("highway"), F.lit(None).cast("string").alias("name"), F.lit(False).alias("oneway"), F.lit(False).alias("crossing"), F.lit(LINK_M).alias("metres"), F.lit(True).alias("link"))
    return nodes.select("node", "x", "y", "crossing").unionByName(place), kept.unionByName(new)
