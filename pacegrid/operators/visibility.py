"""Ways across open areas: every straight line between two corners or nodes that stays inside.

An area is an outer ring and holes.  A line is cut where it meets sides; it stays inside if every piece
does, or leaves by ``BUFFER_M`` at most.  Lines meet sides in cells of the plane and points meet
sides in bands, so a long ring is many keys and no task holds an area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pacegrid.operators import spatial
from pacegrid.operators.store import stored

C = F.col
# --- fixed values -----------------------------------------------------------
#: How far a line may leave an area, vertices of an area between which all lines are tried, and the shortest line.
BUFFER_M, MOST_VERTICES, SHORTEST_M = 0.5, 160, 1.0
CELL_M = 100.0
_AT = (0.25, 0.5, 0.75)


def sides(rings: DataFrame) -> DataFrame:
    """(area, ring, x1, y1, x2, y2) of corners (area, ring, i, x, y)."""
    whole = spatial.sides(rings.withColumn("_key", F.struct("area", "ring")), "_key")
    return whole.select(C("_key.area").alias("area"), C("_key.ring").alias("ring"), "x1", "y1", "x2", "y2").where("x1 <> x2 OR y1 <> y2")


def vertices(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area, vertex, x, y, corner): nodes (area, node, x, y) and the corners that stand on none of them; ``corner`` is the struct (ring, i) or null."""
    own = nodes.select("area", F.concat(F.lit("n"), C("node").cast("string")).alias("vertex"), "x", "y", F.lit(None).cast("struct<ring:bigint,i:bigint>").alias("corner"))
    free = rings.join(nodes.select("area", "x", "y"), ["area", "x", "y"], "left_anti")
    corner = F.struct(C("ring").cast("bigint").alias("ring"), C("i").cast("bigint").alias("i"))
    return own.unionByName(free.select("area", F.concat_ws("-", F.lit("c"), C("ring").cast("string"), C("i").cast("string")).alias("vertex"), "x", "y", corner.alias("corner")))


def meetings(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """(line, t): where lines (line, area, ax, ay, bx, by) meet sides of their area, as a share of the line; both ends of a side that lies along it."""
    a = lines.select("line", "area", "ax", "ay", "bx", "by", spatial.covered(C("ax"), C("ay"), C("bx"), C("by"), CELL_M).alias("_cell"))
    s = edges.select("area", "x1", "y1", "x2", "y2", spatial.covered(C("x1"), C("y1"), C("x2"), C("y2"), CELL_M).alias("_cell"))
    dx, dy, ex, ey = C("bx") - C("ax"), C("by") - C("ay"), C("x2") - C("x1"), C("y2") - C("y1")
    cross = dx * ey - dy * ex
    px, py = C("x1") - C("ax"), C("y1") - C("ay")
    t, u = (px * ey - py * ex) / cross, (px * dy - py * dx) / cross
    along = lambda x, y: ((x - C("ax")) * dx + (y - C("ay")) * dy) / (dx * dx + dy * dy)
    apart = F.when((cross != 0) & t.between(0, 1) & u.between(0, 1), F.array(t))
    same = F.when((cross == 0) & (px * dy == py * dx), F.array(along(C("x1"), C("y1")), along(C("x2"), C("y2"))))
    met = a.join(s, ["area", "_cell"]).select("line", F.explode(F.coalesce(apart, same)).alias("t"))
    return met.where((C("t") > 0) & (C("t") < 1)).distinct()


def within(points: DataFrame, edges: DataFrame, reach: float) -> DataFrame:
    """(point) of points (point, area, px, py) in their area by the parity of sides to the right, or within ``reach`` of a side."""
    low, high = F.floor(F.least("y1", "y2") / CELL_M), F.floor(F.greatest("y1", "y2") / CELL_M)
    banded = edges.where("y1 <> y2").select("*", F.explode(F.sequence(low, high)).alias("_band"))
    right = ((C("y1") > C("py")) != (C("y2") > C("py"))) & (C("px") < (C("x2") - C("x1")) * (C("py") - C("y1")) / F.nullif(C("y2") - C("y1"), F.lit(0)) + C("x1"))
    inside = points.withColumn("_band", F.floor(C("py") / CELL_M)).join(banded, ["area", "_band"]).where(right).groupBy("point").agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select("point")
    from pacegrid.functions.geo import project

    s = edges.select("*", spatial.covered(C("x1"), C("y1"), C("x2"), C("y2"), CELL_M, reach).alias("_cell"))
    t = project(*map(C, ("px", "py", "x1", "y1", "x2", "y2")))
    off = F.hypot(C("px") - C("x1") - t * (C("x2") - C("x1")), C("py") - C("y1") - t * (C("y2") - C("y1")))
    near = points.withColumn("_cell", spatial.cell(C("px"), C("py"), CELL_M)).join(s, ["area", "_cell"]).where(off <= reach).select("point")
    return inside.unionByName(near).distinct()


def mesh(rings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(area, a, b, kind, metres): the rings' own sides and every visible line between two vertices of an area, each once.

    Coordinates are doubles.  All lines are tried in areas of up to ``MOST_VERTICES`` vertices, the rule's limit; larger
    ones have to be simplified before, and get their sides only.
    """
    edges = stored(sides(rings), "sides")
    every = stored(vertices(rings, nodes), "vertices")
    n = every.groupBy("area").agg(F.count(F.lit(1)).alias("_n"))
    one = every.join(n.where(C("_n") <= MOST_VERTICES).select("area"), "area")
    ends = lambda v, x, y: [C("vertex").alias(v), C("x").alias(x), C("y").alias(y)]
    size = F.hypot(C("bx") - C("ax"), C("by") - C("ay"))
    # within one area, of a bounded number of vertices
    pairs = one.select("area", *ends("a", "ax", "ay")).join(one.select("area", *ends("b", "bx", "by")), "area").where("a < b").withColumn("metres", size).where(C("metres") >= SHORTEST_M)
    at = every.select("area", "x", "y", "vertex")
    own = edges.join(at.toDF("area", "x1", "y1", "p"), ["area", "x1", "y1"]).join(at.toDF("area", "x2", "y2", "q"), ["area", "x2", "y2"])
    ring = own.select("area", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.hypot(C("x2") - C("x1"), C("y2") - C("y1")).alias("metres")).where(C("metres") >= SHORTEST_M).distinct()
    tried = stored(pairs.join(ring.select("area", "a", "b"), ["area", "a", "b"], "left_anti").withColumn("line", F.monotonically_increasing_id()), "lines")
    cuts = meetings(tried, edges).groupBy("line").agg(F.array_sort(F.collect_list("t")).alias("cuts"))
    held = tried.join(cuts, "line", "left").withColumn("cuts", F.concat(F.array(F.lit(0.0)), F.coalesce("cuts", F.array().cast("array<double>")), F.array(F.lit(1.0))))
    piece = F.explode(F.transform(F.sequence(F.lit(1), F.size("cuts") - 1), lambda i: F.struct(C("cuts")[i - 1].alias("s"), C("cuts")[i].alias("e")))).alias("c")
    spot = F.explode(F.array(*map(F.lit, _AT))).alias("w")
    spots = held.select("line", "area", "ax", "ay", "bx", "by", piece).where("c.e - c.s > 1e-12").select("*", spot).withColumn("t", C("c.s") + (C("c.e") - C("c.s")) * C("w"))
    spots = spots.select("line", "area", (C("ax") + (C("bx") - C("ax")) * C("t")).alias("px"), (C("ay") + (C("by") - C("ay")) * C("t")).alias("py")).withColumn("point", F.struct("line", "px", "py"))
    out_ = spots.join(within(spots, edges, BUFFER_M), "point", "left_anti").select("line").distinct()
    seen = tried.join(out_, "line", "left_anti").select("area", "a", "b", F.lit("chord").alias("kind"), "metres")
    return ring.select("area", "a", "b", F.lit("ring").alias("kind"), "metres").unionByName(seen)
