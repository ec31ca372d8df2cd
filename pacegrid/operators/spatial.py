"""Joins in the plane as equi-joins on grid cells, with exact tests behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def cell(x: Column, y: Column, size: float) -> Column:
    return F.struct(F.floor(x / size).alias("i"), F.floor(y / size).alias("j"))


def around(x: Column, y: Column, size: float) -> Column:
    """The cell of a point and the eight around it, one row each."""
    return F.explode(F.array(*[F.struct((F.floor(x / size) + i).alias("i"), (F.floor(y / size) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))


def covered(ax: Column, ay: Column, bx: Column, by: Column, size: float, reach: float = 0.0) -> Column:
    """The cells of a box, grown by ``reach``, one row each."""
    low = lambda p, q: F.floor((F.least(p, q) - reach) / size)
    high = lambda p, q: F.floor((F.greatest(p, q) + reach) / size)
    cells = F.transform(F.sequence(low(ax, bx), high(ax, bx)), lambda i: F.transform(F.sequence(low(ay, by), high(ay, by)), lambda j: F.struct(i.alias("i"), j.alias("j"))))
    return F.explode(F.flatten(cells))


def within(left: DataFrame, a: tuple[str, str, str], right: DataFrame, b: tuple[str, str, str], metres: float) -> DataFrame:
    """(left id, right id, d2) of points within ``metres``: cells of that size and their neighbours."""
    p = left.select(*a, around(C(a[1]), C(a[2]), metres).alias("_cell"))
    q = right.select(*b, cell(C(b[1]), C(b[2]), metres).alias("_cell"))
    d2 = (C(a[1]) - C(b[1])) * (C(a[1]) - C(b[1])) + (C(a[2]) - C(b[2])) * (C(a[2]) - C(b[2]))
    return p.join(q, "_cell").select(a[0], b[0], d2.alias("d2")).where(F.sqrt("d2") <= metres)


def nearest(left: DataFrame, a: tuple[str, str, str], right: DataFrame, b: tuple[str, str, str], metres: float) -> DataFrame:
    """The nearest right point of each left one within ``metres``; the lower id on ties."""
    found = within(left, a, right, b, metres).groupBy(a[0]).agg(F.min(F.struct("d2", b[0])).alias("_n"))
    return found.select(a[0], C(f"_n.{b[0]}"), F.round(F.sqrt("_n.d2"), 4).alias("metres"))


def snap(points: DataFrame, segments: DataFrame, metres: float) -> DataFrame:
    """The nearest segment within ``metres`` of each point (id, px, py), by cells that segments cover."""
    from pacegrid.functions.geo import project

    p = points.select("id", "px", "py", cell(C("px"), C("py"), metres).alias("_cell"))
    s = segments.select("*", covered(C("ax"), C("ay"), C("bx"), C("by"), metres, metres).alias("_cell"))
    t = project(*map(C, ("px", "py", "ax", "ay", "bx", "by")))
    d = F.round(F.sqrt(F.pow(C("px") - C("ax") - C("t") * (C("bx") - C("ax")), 2) + F.pow(C("py") - C("ay") - C("t") * (C("by") - C("ay")), 2)), 6)
    near = p.join(s, "_cell").withColumn("t", t).withColumn("d", d).where(C("d") <= metres)
    best = near.groupBy("id").agg(F.min(F.struct("d", "eid", "t")).alias("_n"))
    return best.select("id", "_n.eid", F.round("_n.t", 6).alias("t"), C("_n.d").alias("metres"), (C("_n.t") > 0.5).alias("far_end"))


def sides(rings: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2): the sides of rings of corners (key, i, x, y), closed."""
    order = Window.partitionBy(key).orderBy("i")
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rings.select(
        key, C("x").alias("x1"), C("y").alias("y1"), F.coalesce(F.lead("x").over(order), first("x")).alias("x2"), F.coalesce(F.lead("y").over(order), first("y")).alias("y2")
    )


def inside(points: DataFrame, p: tuple[str, str, str], rings: DataFrame, key: str, size: float = 500.0) -> DataFrame:
    """(key, point) of points in rings: cells of the ring's box, then the parity of sides to the right.

    Sides and points of a ring meet in bands of y, so that a large ring is many keys.
    """
    edge = sides(rings, key)
    bands = F.explode(F.sequence(F.floor(F.least("y1", "y2") / size), F.floor(F.greatest("y1", "y2") / size)))
    edge = edge.where("y1 <> y2").withColumn("_band", bands)
    box = rings.groupBy(key).agg(F.min("x").alias("w"), F.min("y").alias("s"), F.max("x").alias("e"), F.max("y").alias("n"))
    near = points.select(*p, cell(C(p[1]), C(p[2]), size).alias("_cell")).join(box.select(key, "w", "s", "e", "n", covered(C("w"), C("s"), C("e"), C("n"), size).alias("_cell")), "_cell")
    near = near.where(C(p[1]).between(C("w"), C("e")) & C(p[2]).between(C("s"), C("n"))).select(key, *p, F.floor(C(p[2]) / size).alias("_band"))
    right = ((C("y1") > C(p[2])) != (C("y2") > C(p[2]))) & (C(p[1]) < (C("x2") - C("x1")) * (C(p[2]) - C("y1")) / F.nullif(C("y2") - C("y1"), F.lit(0)) + C("x1"))
    return near.join(edge, [key, "_band"]).where(right).groupBy(key, p[0]).agg(F.count(F.lit(1)).alias("_n")).where("_n % 2 = 1").select(key, p[0])


def crossings(lines: DataFrame, segments: DataFrame, size: float) -> DataFrame:
    """(id, eid) of lines (id, cx, cy, dx, dy) that cross segments within both."""
    cross = lambda ox, oy, px, py, qx, qy: (C(px) - C(ox)) * (C(qy) - C(oy)) - (C(py) - C(oy)) * (C(qx) - C(ox))
    a = lines.select("*", covered(C("cx"), C("cy"), C("dx"), C("dy"), size).alias("_cell"))
    s = segments.select("*", covered(C("ax"), C("ay"), C("bx"), C("by"), size).alias("_cell"))
    o1, o2 = cross("ax", "ay", "bx", "by", "cx", "cy"), cross("ax", "ay", "bx", "by", "dx", "dy")
    o3, o4 = cross("cx", "cy", "dx", "dy", "ax", "ay"), cross("cx", "cy", "dx", "dy", "bx", "by")
    return a.join(s, "_cell").where((o1 * o2 < 0) & (o3 * o4 < 0)).select("id", "eid").distinct()
