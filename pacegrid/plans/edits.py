"""Queries on edits of the street network."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.operators import topology
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col


def streets(spark, sf_dir):
    """Nodes and named streets of a town: the paths of the parks and short cuts across every fifth block."""
    n = b.park_nodes(spark, sf_dir).select("node", C("x").cast("double").alias("x"), C("y").cast("double").alias("y"), (C("node") * 13 % 29 == 0).alias("crossing"))
    paths = b.park_paths(spark, sf_dir).select("eid", "u", "v", "len_dm")
    top = 4 * b.table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 4
    cut = n.where((C("node") % 5 < 3) & (C("node") % b.WIDE < b.WIDE - 1)).select((C("node") + top).alias("eid"), C("node").alias("u"), (C("node") + b.WIDE + 1).alias("v"), F.lit(1414).cast("long").alias("len_dm"))
    both = paths.unionByName(cut.join(n.select(C("node").alias("v")), "v", "left_semi"))
    k = C("eid")
    kind = F.when(k * 7 % 11 == 0, "footway").when(k * 3 % 5 == 0, "primary").otherwise("residential")
    name = F.concat(F.lit("street "), (F.floor(C("u") / 4) % 3).cast("string"))
    return n, both.select("eid", "u", "v", kind.alias("highway"), name.alias("name"), (k % 3 > 0).alias("oneway"), (k * 5 % 37 == 0).alias("crossing"), (C("len_dm") / 10).alias("metres"))


@query()
def split_forks(spark, sf_dir):
    """The streets of a town whose nodes at the tips of forks are split, with the links between the halves."""
    _, ways = topology.split(*streets(spark, sf_dir))
    return ways.select("eid", "u", "v", "highway", "oneway", "link", F.round("metres", 6).alias("metres"))
