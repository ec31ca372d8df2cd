"""Queries over joins in space: cells, nearest, radius, covers, crossings, geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.functions import cost, geo
from pacegrid.operators import spatial
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col

#: Points around the grid, of suppliers.
_POINTS = "points AS (SELECT s_suppkey AS id, (s_suppkey * 337 % 4900)::DOUBLE + 0.5 AS px, (s_suppkey * 211 % 900)::DOUBLE + 0.25 AS py FROM supplier)"
_SEGMENTS = "segments AS (SELECT e.eid, a.x AS ax, a.y AS ay, c.x AS bx, c.y AS b_y FROM edges e JOIN nodes a ON a.node = e.u JOIN nodes c ON c.node = e.v)"
#: Five-sided districts along the grid, of nations.
_RINGS = """rings AS (SELECT n_nationkey AS district, v.i, (n_nationkey % 5) * 1000 + v.x AS x, (n_nationkey // 5) * 800 + v.y AS y FROM nation, (VALUES (0, 0, 0), (1, 900, 50), (2, 950, 500), (3, 400, 790), (4, 20, 600)) v(i, x, y))"""


def points(spark, sf_dir):
    k = C("s_suppkey")
    return b.table(spark, sf_dir, "supplier").select(k.alias("id"), (k * 337 % 4900 + 0.5).cast("double").alias("px"), (k * 211 % 900 + 0.25).cast("double").alias("py"))


def segments(spark, sf_dir):
    n = b.nodes(spark, sf_dir)
    a, c = n.toDF("u", "ax", "ay"), n.toDF("v", "bx", "by")
    return b.edges(spark, sf_dir).select("eid", "u", "v").join(a, "u").join(c, "v").select("eid", "ax", "ay", "bx", "by")


def rings(spark, sf_dir):
    k = C("n_nationkey").cast("long")
    corners = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (900, 50), (950, 500), (400, 790), (20, 600))])
    return b.table(spark, sf_dir, "nation").select(k.alias("district"), F.posexplode(corners).alias("i", "c")).select(
        "district", C("i").cast("long").alias("i"), (C("district") % 5 * 1000 + C("c.x")).alias("x"), (F.floor(C("district") / 5) * 800 + C("c.y")).alias("y"),
    )


@query(f"""WITH {_POINTS}, t AS (SELECT id, node, (px - x) * (px - x) + (py - y) * (py - y) AS d2 FROM points, nodes)
    SELECT id, node, round(sqrt(d2), 4) AS metres FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, node) AS r FROM t) WHERE r = 1 AND d2 <= 250 * 250""")
def nearest_node(spark, sf_dir):
    """The nearest node within 250 m, by cells and their neighbours."""
    return spatial.nearest(points(spark, sf_dir), ("id", "px", "py"), b.nodes(spark, sf_dir), ("node", "x", "y"), 250.0)


@query(f"""WITH {_POINTS}, {_SEGMENTS}, t AS (SELECT *, greatest(0, least(1, ((px - ax) * (bx - ax) + (py - ay) * (b_y - ay)) / ((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay))::DOUBLE)) AS t FROM points, segments WHERE abs(px - ax) <= 400 AND abs(py - ay) <= 400),
    d AS (SELECT *, round(sqrt(pow(px - ax - t * (bx - ax), 2) + pow(py - ay - t * (b_y - ay), 2)), 6) AS d FROM t)
    SELECT id, eid, round(t, 6) AS t, d AS metres, t > 0.5 AS far_end FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, eid) AS r FROM d WHERE d <= 200) WHERE r = 1""")
def snap_to_edge(spark, sf_dir):
    """The nearest segment of a point, the place on it, and its nearer end."""
    return spatial.snap(points(spark, sf_dir), segments(spark, sf_dir), 200.0)


@query(f"""WITH {_POINTS} SELECT id, count(*) AS n, round(avg((eid * 37 + 24 * 11) % 256 / 255::DOUBLE) * 100, 4) AS shade FROM points, nodes JOIN edges ON node = u WHERE sqrt((px - x) * (px - x) + (py - y) * (py - y)) <= 150 GROUP BY id""")
def shade_around(spark, sf_dir):
    """Mean shade at 14:00 of edges whose source is within 150 m; null if any is missing."""
    near = spatial.within(points(spark, sf_dir), ("id", "px", "py"), b.nodes(spark, sf_dir), ("node", "x", "y"), 150.0)
    shade = b.shade(C("eid"), F.lit(24)) / 255
    mean = F.when(~F.bool_or(C("shade").isNull()), F.round(F.avg("shade") * 100, 4))
    e = b.edges(spark, sf_dir).select(C("u").alias("node"), "eid")
    return near.join(e, "node").withColumn("shade", shade).groupBy("id").agg(F.count(F.lit(1)).alias("n"), mean.alias("shade"))


@query(f"""WITH {_RINGS}, sides AS (SELECT district, x AS x1, y AS y1, lead(x, 1, fx) OVER w AS x2, lead(y, 1, fy) OVER w AS y2 FROM (SELECT *, first(x) OVER (PARTITION BY district ORDER BY i) AS fx, first(y) OVER (PARTITION BY district ORDER BY i) AS fy FROM rings) WINDOW w AS (PARTITION BY district ORDER BY i))
    SELECT district, node FROM nodes, sides WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1)::DOUBLE + x1 GROUP BY district, node HAVING count(*) % 2 = 1""")
def nodes_in_districts(spark, sf_dir):
    """Points in polygons by the even-odd rule with half-open edges."""
    return spatial.inside(b.nodes(spark, sf_dir), ("node", "x", "y"), rings(spark, sf_dir), "district")


@query(f"""WITH {_RINGS}, s AS (SELECT *, lead(x, 1, fx) OVER w AS x2, lead(y, 1, fy) OVER w AS y2 FROM (SELECT *, first(x) OVER (PARTITION BY district ORDER BY i) AS fx, first(y) OVER (PARTITION BY district ORDER BY i) AS fy FROM rings) WINDOW w AS (PARTITION BY district ORDER BY i))
    SELECT district, sum(x * y2 - x2 * y) / 2::DOUBLE AS area, round(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 4) AS length, round(4 * pi() * abs(sum(x * y2 - x2 * y) / 2::DOUBLE) / pow(sum(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))), 2), 5) AS roundness,
    min(x) AS w, min(y) AS s, max(x) AS e, max(y) AS n FROM s GROUP BY district""")
def ring_measures(spark, sf_dir):
    """Signed area, length, roundness and box of each ring."""
    sides = spatial.sides(rings(spark, sf_dir), "district")
    area = F.sum(C("x1") * C("y2") - C("x2") * C("y1")) / 2
    length = F.sum(F.sqrt((C("x2") - C("x1")) * (C("x2") - C("x1")) + (C("y2") - C("y1")) * (C("y2") - C("y1"))))
    return sides.groupBy("district").agg(
        area.alias("area"), F.round(length, 4).alias("length"), F.round(geo.roundness(F.abs(area), length), 5).alias("roundness"),
        F.min("x1").alias("w"), F.min("y1").alias("s"), F.max("x1").alias("e"), F.max("y1").alias("n"),
    )


@query("""SELECT e.eid, coalesce(min(r.eid), -1) AS twin FROM edges e LEFT JOIN edges r ON r.u = e.v AND r.v = e.u AND r.len_dm = e.len_dm GROUP BY e.eid""")
def reverse_edges(spark, sf_dir):
    """The twin of each edge: the other way, equally long; -1 if there is none."""
    e = b.edges(spark, sf_dir).select("eid", "u", "v", "len_dm")
    r = e.select(C("eid").alias("back"), C("u").alias("v"), C("v").alias("u"), "len_dm")
    return e.join(r, ["u", "v", "len_dm"], "left").groupBy("eid").agg(F.coalesce(F.min("back"), F.lit(-1)).alias("twin"))


@query("""WITH own AS (SELECT * FROM edges WHERE eid % 3 <> 0) SELECT u, v, len_dm, false AS added FROM own UNION ALL SELECT v, u, len_dm, true FROM own o WHERE NOT EXISTS (SELECT 1 FROM own r WHERE r.u = o.v AND r.v = o.u)""")
def with_reverse(spark, sf_dir):
    """Missing reverse edges added, ends swapped."""
    own = b.edges(spark, sf_dir).where("eid % 3 <> 0").select("u", "v", "len_dm")
    missing = own.join(own.select(C("v").alias("u"), C("u").alias("v")), ["u", "v"], "left_anti")
    return own.withColumn("added", F.lit(False)).unionByName(missing.select(C("v").alias("u"), C("u").alias("v"), "len_dm", F.lit(True).alias("added")))


@query("""SELECT eid, n, list_transform(range(0, n), lambda i: round(i * len / (n - 1), 4)) AS places FROM (SELECT eid, len_dm / 10::DOUBLE AS len, greatest(3, floor(len_dm / 10::DOUBLE / 10)::BIGINT + 1) AS n FROM edges)""")
def sample_places(spark, sf_dir):
    """G1: places along each edge every 10 m, three at least, both ends included."""
    n = F.greatest(F.lit(3), F.floor(C("len_dm") / 10 / 10) + 1)
    e = b.edges(spark, sf_dir).select("eid", (C("len_dm") / 10).alias("len"), n.alias("n"))
    return e.select("eid", "n", F.transform(F.sequence(F.lit(0).cast("long"), C("n") - 1), lambda i: F.round(i * C("len") / (C("n") - 1), 4)).alias("places"))


@query(f"""WITH {_SEGMENTS}, lines AS (SELECT s_suppkey AS id, (s_suppkey * 337 % 4900)::DOUBLE + 20.5 AS cx, (s_suppkey * 211 % 900)::DOUBLE + 10.25 AS cy, (s_suppkey * 337 % 4900)::DOUBLE + 90.5 AS dx, (s_suppkey * 211 % 900)::DOUBLE + 140.25 AS dy FROM supplier),
    o AS (SELECT id, eid, (bx - ax) * (cy - ay) - (b_y - ay) * (cx - ax) AS o1, (bx - ax) * (dy - ay) - (b_y - ay) * (dx - ax) AS o2, (dx - cx) * (ay - cy) - (dy - cy) * (ax - cx) AS o3, (dx - cx) * (b_y - cy) - (dy - cy) * (bx - cx) AS o4 FROM lines, segments)
    SELECT id, eid FROM o WHERE o1 * o2 < 0 AND o3 * o4 < 0""")
def crossing_lines(spark, sf_dir):
    """Which lines cross which edges, within both."""
    k = C("s_suppkey")
    x, y = k * 337 % 4900, k * 211 % 900
    lines = b.table(spark, sf_dir, "supplier").select(k.alias("id"), (x + 20.5).cast("double").alias("cx"), (y + 10.25).cast("double").alias("cy"), (x + 90.5).cast("double").alias("dx"), (y + 140.25).cast("double").alias("dy"))
    return spatial.crossings(lines, segments(spark, sf_dir), 200.0)


@query(f"""WITH {_RINGS}, {_POINTS} SELECT id, round(min(sqrt((px - x) * (px - x) + (py - y) * (py - y))), 4) AS metres FROM points JOIN supplier ON s_suppkey = id JOIN rings ON district = s_nationkey GROUP BY id""")
def distance_to_border(spark, sf_dir):
    """Metres from each point to the nearest corner of its own district's border."""
    own = b.table(spark, sf_dir, "supplier").select(C("s_suppkey").alias("id"), C("s_nationkey").alias("district"))
    d = F.sqrt((C("px") - C("x")) * (C("px") - C("x")) + (C("py") - C("y")) * (C("py") - C("y")))
    return points(spark, sf_dir).join(own, "id").join(rings(spark, sf_dir), "district").groupBy("id").agg(F.round(F.min(d), 4).alias("metres"))


@query(f"""WITH {_POINTS}, {_SEGMENTS}, near AS (SELECT id, avg((eid * 37 + 24 * 11) % 256 / 255::DOUBLE) AS shade, count(*) AS n FROM points JOIN segments ON least(ax, bx) <= px + 150 AND greatest(ax, bx) >= px - 150 AND least(ay, b_y) <= py + 150 AND greatest(ay, b_y) >= py - 150 GROUP BY id),
    crop AS (SELECT id, avg(z) AS z, count(*) AS n_cells FROM points JOIN cells ON col * 20 BETWEEN px % 1200 - 200 AND px % 1200 + 200 AND row * 20 BETWEEN py - 200 AND py + 200 GROUP BY id)
    SELECT n.id, n, round(shade * 100, 4) AS edges, n_cells, round(z * 100, 4) AS raster FROM near n LEFT JOIN crop c ON c.id = n.id""")
def shade_beside_raster(spark, sf_dir):
    """Mean shade of the edges that meet the box of 150 m around a point, beside the raster's mean over a crop of 400 m."""
    p = points(spark, sf_dir)
    s = segments(spark, sf_dir).select("eid", *[C(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")])
    cell = s.select("*", spatial.covered(C("ax"), C("ay"), C("bx"), C("by"), 300.0).alias("_cell"))
    met = p.select("*", spatial.covered(C("px"), C("py"), C("px"), C("py"), 300.0, 150.0).alias("_cell")).join(cell, "_cell")
    box = (F.least("ax", "bx") <= C("px") + 150) & (F.greatest("ax", "bx") >= C("px") - 150) & (F.least("ay", "by") <= C("py") + 150) & (F.greatest("ay", "by") >= C("py") - 150)
    near = met.where(box).select("id", "eid").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(b.shade(C("eid"), F.lit(24)) / 255) * 100, 4).alias("edges"))
    # cells of the raster are 20 m wide: a crop is the blocks of 400 m that it touches, and then the cells in it
    q = p.select("id", (C("px") % 1200).alias("qx"), C("py").alias("qy"))
    z = b.cells(spark, sf_dir).select((C("col") * 20).cast("double").alias("x"), (C("row") * 20).cast("double").alias("y"), "z").withColumn("_cell", spatial.cell(C("x"), C("y"), 400.0))
    inside = C("x").between(C("qx") - 200, C("qx") + 200) & C("y").between(C("qy") - 200, C("qy") + 200)
    crop = q.select("*", spatial.covered(C("qx"), C("qy"), C("qx"), C("qy"), 400.0, 200.0).alias("_cell")).join(z, "_cell").where(inside)
    mean = crop.groupBy("id").agg(F.count(F.lit(1)).alias("n_cells"), F.round(F.avg("z") * 100, 4).alias("raster"))
    return near.join(mean, "id", "left").select("id", "n", "edges", "n_cells", "raster")


@query(f"""WITH {_SEGMENTS} SELECT eid, CASE WHEN ax + ay > bx + b_y THEN [bx, b_y, ax, ay] ELSE [ax, ay, bx, b_y] END AS line FROM segments""")
def oriented_lines(spark, sf_dir):
    """Lines turned so that they start at their lower end."""
    start, end = F.array("ax", "ay"), F.array("bx", "by")
    turned = C("ax") + C("ay") > C("bx") + C("by")
    return segments(spark, sf_dir).select("eid", F.when(turned, F.concat(end, start)).otherwise(F.concat(start, end)).alias("line"))


@query("""WITH m AS (SELECT x1.eid, x1.u, x1.v FROM edges x1 SEMI JOIN (SELECT u FROM edges WHERE (flags & 32) <> 0) f ON x1.v = f.u) SELECT eid, u, v FROM m""")
def edges_to_major(spark, sf_dir):
    """Edges that end at a node of a major road, by a semi join on nodes."""
    e = b.edges(spark, sf_dir)
    major = e.where(cost.bit(C("flags"), 32)).select(C("u").alias("v")).distinct()
    return e.join(major, "v", "left_semi").select("eid", "u", "v")


@query("""SELECT e.eid, coalesce(w.n, 0) AS trips, coalesce(w.first_trip, -1) AS first_trip FROM edges e LEFT JOIN (SELECT eid, count(*) AS n, min(trip) AS first_trip FROM steps GROUP BY eid) w ON w.eid = e.eid""")
def edge_facts(spark, sf_dir):
    """Facts joined to edges with defaults, by an inverted index of walks."""
    use = b.steps(spark, sf_dir).groupBy("eid").agg(F.count(F.lit(1)).alias("n"), F.min("trip").alias("first_trip"))
    return b.edges(spark, sf_dir).select("eid").join(use, "eid", "left").select("eid", F.coalesce("n", F.lit(0)).alias("trips"), F.coalesce("first_trip", F.lit(-1)).alias("first_trip"))
