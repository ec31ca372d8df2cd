"""Queries over rasters."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from pacegrid.operators import raster, spatial
from pacegrid.plans import spatial as plane
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col
_AROUND = "(VALUES (-1), (0), (1)) di(i), (VALUES (-1), (0), (1)) dj(j)"


@query("SELECT row // 4 AS row, col // 4 AS col, round(max(z), 6) AS top, round(avg(z), 6) AS mean FROM cells GROUP BY ALL HAVING count(*) = 16")
def block_values(spark, sf_dir):
    """Largest and mean value of blocks of 4 x 4 cells."""
    top = raster.blocks(b.cells(spark, sf_dir), 4, F.round(F.max("z"), 6), "top")
    return top.join(raster.blocks(b.cells(spark, sf_dir), 4, F.round(F.avg("z"), 6), "mean"), ["row", "col"])


#: Point classes that are no surface.
NOISE_CLASSES = (7, 9, 18)


@query("SELECT floor((row * 0.7::DOUBLE + 3) / 2)::BIGINT AS cell_y, floor(col * 1.3::DOUBLE / 2)::BIGINT AS cell_x, max(z) AS top, count(*) AS n FROM cells WHERE (row * 5 + col) % 19 NOT IN (7, 9, 18) GROUP BY ALL")
def binned_points(spark, sf_dir):
    """Points without those of noise classes, each moved to the raster's frame, the highest of each cell of 2 m."""
    p = b.cells(spark, sf_dir).select((C("row") * 0.7 + 3).alias("y"), (C("col") * 1.3).alias("x"), "z", ((C("row") * 5 + C("col")) % 19).alias("cls"))
    p = p.where(~C("cls").isin(*NOISE_CLASSES))
    return p.groupBy(F.floor(C("y") / 2).alias("cell_y"), F.floor(C("x") / 2).alias("cell_x")).agg(F.max("z").alias("top"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT c.row, c.col, round(avg(n.z), 6) AS mean, count(*) AS n, sum(CASE WHEN n.z > 0 THEN 1 ELSE 0 END) >= 5 AS most FROM cells c, {_AROUND}, cells n WHERE n.row = c.row + i AND n.col = c.col + j GROUP BY c.row, c.col""")
def neighbourhoods(spark, sf_dir):
    """3 x 3 mean and majority."""
    stats = F.struct(F.round(F.avg("z"), 6).alias("mean"), F.count(F.lit(1)).alias("n"), (F.sum(F.when(C("z") > 0, 1).otherwise(0)) >= 5).alias("most"))
    return raster.spread(b.cells(spark, sf_dir), raster.square(), stats, "s").select("row", "col", "s.*")


@query("""SELECT c.row, c.col, max(n.z) AS z FROM cells c, (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4) d, cells n WHERE n.row = c.row + i AND n.col = c.col + j GROUP BY c.row, c.col""")
def dilated(spark, sf_dir):
    """The largest value in a disc of two cells."""
    return raster.spread(b.cells(spark, sf_dir), raster.disc(2), F.max("z"))


@query("""SELECT row, col, coalesce(max(z + col * tan(radians(26.57))) OVER (PARTITION BY row ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - col * tan(radians(26.57)) > z + 0.01, false) AS shaded FROM cells""")
def shadows_from_west(spark, sf_dir):
    """Shadow of a sun due west, as a running horizon."""
    return raster.lined_shadow(b.cells(spark, sf_dir), 26.57)


@query("""WITH k AS (SELECT abs(cos(radians(230.0))) AS d, abs(sin(radians(230.0))) AS r), e AS (SELECT min(col) AS c0, max(row) AS r1 FROM cells),
    v AS (SELECT row, col, z * 20 AS z, col - c0 AS along, r1 - row - round_even((d / r) * (col - c0), 0) AS ray, tan(radians(40.0)) * sqrt(1 + (d / r) * (d / r)) AS fall FROM cells, k, e)
    SELECT row, col, coalesce(max(z + along * fall) OVER (PARTITION BY ray ORDER BY along ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - along * fall > z + 0.01, false) AS shaded FROM v""")
def shadows_oblique(spark, sf_dir):
    """Shadow of an oblique sun, a running horizon along each ray."""
    return raster.shadows(b.cells(spark, sf_dir).withColumn("z", C("z") * 20), 230.0, 40.0)


#: A sun for the ray march: azimuth and elevation, and metres a cell.
SUN, CELL_M = (215.0, 30.0), 4.0
_STEPS, _SIZE, _RISE = raster.march(SUN[1], CELL_M)
_RIGHT, _DOWN = math.sin(math.radians(SUN[0])) * _SIZE, -math.cos(math.radians(SUN[0])) * _SIZE


@query(f"""WITH h AS (SELECT row, col, CASE WHEN (row * 7 + col * 3) % 53 > 0 THEN z * 40 END AS z FROM cells), r AS (SELECT row, col, z, k, CAST(floor(row + 0.5 + k * {_DOWN!r}::DOUBLE) AS BIGINT) AS y, CAST(floor(col + 0.5 + k * {_RIGHT!r}::DOUBLE) AS BIGINT) AS x FROM h, unnest(range(1, {_STEPS + 1})) t(k) WHERE z IS NOT NULL),
    s AS (SELECT DISTINCT r.row, r.col FROM r JOIN h ON h.row = r.y AND h.col = r.x WHERE h.z > (r.z + 0.05::DOUBLE) + r.k * {_RISE!r}::DOUBLE) SELECT h.row, h.col, s.row IS NOT NULL AS shaded FROM h LEFT JOIN s ON s.row = h.row AND s.col = h.col""")
def shadows_marched(spark, sf_dir):
    """R2: shadow by rays that climb towards the sun step by step, within the reach of what stands there; not equal to R1."""
    z = F.when((C("row") * 7 + C("col") * 3) % 53 > 0, C("z") * 40)
    return raster.marched(b.cells(spark, sf_dir).withColumn("z", z), *SUN, CELL_M)


@query("""SELECT row, col, round(180 * (1 - least(1, sqrt(gx * gx + gy * gy))), 5) AS hill FROM (SELECT row, col, (lead(z) OVER (PARTITION BY row ORDER BY col) - lag(z) OVER (PARTITION BY row ORDER BY col)) / 2 AS gx,
    (lead(z) OVER (PARTITION BY col ORDER BY row) - lag(z) OVER (PARTITION BY col ORDER BY row)) / 2 AS gy FROM cells) WHERE gx IS NOT NULL AND gy IS NOT NULL""")
def hillshade(spark, sf_dir):
    """Brightness by gradient on both axes."""
    step = lambda a, o: (F.lead("z").over(Window.partitionBy(a).orderBy(o)) - F.lag("z").over(Window.partitionBy(a).orderBy(o))) / 2
    g = b.cells(spark, sf_dir).withColumns({"gx": step("row", "col"), "gy": step("col", "row")}).where("gx IS NOT NULL AND gy IS NOT NULL")
    return g.select("row", "col", F.round(180 * (1 - F.least(F.lit(1.0), F.sqrt(C("gx") * C("gx") + C("gy") * C("gy")))), 5).alias("hill"))


_TILES = "tiles AS (SELECT row % 100 AS row, col, z, row // 100 AS tile FROM cells)"


@query(f"WITH {_TILES} SELECT row, col, arg_min(z, tile) AS first_z, arg_max(z, tile) AS last_z, max(z) AS top, CASE WHEN arg_max(z, tile) < 0 THEN 0 ELSE floor(arg_max(z, tile) * 100)::BIGINT END AS stored FROM tiles GROUP BY row, col")
def mosaics(spark, sf_dir):
    """Tiles laid over each other: first wins, last wins, highest wins; stored scaled, negatives cut."""
    t = b.cells(spark, sf_dir).select((C("row") % 100).alias("row"), "col", "z", F.floor(C("row") / 100).alias("tile"))
    last = F.max(F.struct("tile", "z"))["z"]
    return t.groupBy("row", "col").agg(F.min(F.struct("tile", "z"))["z"].alias("first_z"), last.alias("last_z"), F.max("z").alias("top"), F.when(last < 0, 0).otherwise(F.floor(last * 100)).alias("stored"))


@query("""SELECT row, count(*) AS n, CASE WHEN count(z) > 40 THEN round(quantile_cont(z, 0.1), 6) END AS bank, round(quantile_cont(z, 0.5), 6) AS mid, round(quantile_cont(z, 0.99), 6) AS p99 FROM (SELECT row, CASE WHEN (row + col) % 5 <> 0 THEN z END AS z FROM cells) GROUP BY row""")
def row_levels(spark, sf_dir):
    """Quantiles of rows, a bank level only where enough cells are known."""
    z = F.when((C("row") + C("col")) % 5 != 0, C("z"))
    p = lambda q: F.round(F.percentile("z", F.lit(q)), 6)
    return b.cells(spark, sf_dir).withColumn("z", z).groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.when(F.count("z") > 40, p(0.1)).alias("bank"), p(0.5).alias("mid"), p(0.99).alias("p99"))


@query("""WITH t AS (SELECT row // 16 AS ty, col // 16 AS tx, max(z) AS top, count(*) AS n FROM cells GROUP BY ALL) SELECT 0 AS level, ty, tx, top, n FROM t UNION ALL SELECT 1, ty // 2, tx // 2, max(top), sum(n)::BIGINT FROM t GROUP BY ALL
    UNION ALL SELECT 2, ty // 4, tx // 4, max(top), sum(n)::BIGINT FROM t GROUP BY ALL""")
def tile_pyramid(spark, sf_dir):
    """Tiles of 16 cells and two coarser levels, highest value kept."""
    t = b.cells(spark, sf_dir).groupBy(F.floor(C("row") / 16).alias("ty"), F.floor(C("col") / 16).alias("tx")).agg(F.max("z").alias("top"), F.count(F.lit(1)).alias("n"))
    # the finest level is aggregated once; coarser ones grow from its few rows
    level = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("level")
    side = F.pow(F.lit(2), C("level"))
    return t.select("*", level).groupBy("level", F.floor(C("ty") / side).alias("ty"), F.floor(C("tx") / side).alias("tx")).agg(F.max("top").alias("top"), F.sum("n").alias("n"))


@query("""SELECT row, col, CASE WHEN row BETWEEN 0 AND 399 AND col BETWEEN 8 AND 55 THEN z END AS z FROM cells""")
def clipped(spark, sf_dir):
    """A raster clipped to a box, no data outside."""
    keep = C("row").between(0, 399) & C("col").between(8, 55)
    return b.cells(spark, sf_dir).select("row", "col", F.when(keep, C("z")).alias("z"))


#: Noise bands: each district's ring, and a louder one of half its size at the same corner.
_BANDS = f"""{plane._RINGS}, bands AS (SELECT district * 2 + b AS band, i, CASE b WHEN 0 THEN x ELSE (district % 5 * 1000 + x) / 2.0 END AS x, CASE b WHEN 0 THEN y ELSE (district // 5 * 800 + y) / 2.0 END AS y FROM rings, (VALUES (0), (1)) v(b)),
    placed AS (SELECT row, col, col * 75 + 0.5 AS px, row * 20 + 0.25 AS py FROM cells),
    sides AS (SELECT band, x AS x1, y AS y1, lead(x, 1, fx) OVER w AS x2, lead(y, 1, fy) OVER w AS y2 FROM (SELECT *, first(x) OVER (PARTITION BY band ORDER BY i) AS fx, first(y) OVER (PARTITION BY band ORDER BY i) AS fy FROM bands) WINDOW w AS (PARTITION BY band ORDER BY i)),
    hits AS (SELECT band, row, col FROM placed, sides WHERE (y1 > py) <> (y2 > py) AND px < (x2 - x1) * (py - y1) / (y2 - y1)::DOUBLE + x1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


def band_hits(spark, sf_dir):
    """(band, row, col) of cells whose centre lies in a band's ring."""
    b2 = F.explode(F.array(F.lit(0), F.lit(1))).alias("b")
    x = F.when(C("b") == 0, C("x").cast("double")).otherwise((C("district") % 5 * 1000 + C("x")) / 2)
    y = F.when(C("b") == 0, C("y").cast("double")).otherwise((F.floor(C("district") / 5) * 800 + C("y")) / 2)
    bands = plane.rings(spark, sf_dir).select("*", b2).select((C("district") * 2 + C("b")).alias("band"), "i", x.alias("x"), y.alias("y"))
    # one id for each cell, so that the join in the plane carries a single key
    at = b.cells(spark, sf_dir).select((C("row") * 64 + C("col")).alias("at"), (C("col") * 75 + 0.5).cast("double").alias("px"), (C("row") * 20 + 0.25).cast("double").alias("py"))
    return spatial.inside(at, ("at", "px", "py"), bands, "band").select("band", F.floor(C("at") / 64).alias("row"), (C("at") % 64).alias("col"))


@query(f"WITH {_BANDS} SELECT c.row, c.col, coalesce(max(40 + 5 * (band // 2 % 5) + 10 * (band % 2)), 0)::BIGINT AS db, count(band) > 0 AS within FROM cells c LEFT JOIN hits USING (row, col) GROUP BY c.row, c.col")
def loudest_cells(spark, sf_dir):
    """Polygons on the raster, the loudest wins; cells outside every ring are masked."""
    db = (40 + 5 * F.pmod(F.floor(C("band") / 2), F.lit(5)) + 10 * (C("band") % 2)).cast("long")
    top = band_hits(spark, sf_dir).groupBy("row", "col").agg(F.max(db).alias("db"))
    cells = b.cells(spark, sf_dir).select("row", "col")
    return cells.join(top, ["row", "col"], "left").select("row", "col", F.coalesce("db", F.lit(0).cast("long")).alias("db"), C("db").isNotNull().alias("within"))


@query(f"""WITH {_BANDS}, green AS (SELECT DISTINCT row, col FROM hits), marked AS (SELECT c.row, c.col, CASE WHEN g.row IS NULL THEN 0 ELSE 1 END AS z FROM cells c LEFT JOIN green g ON g.row = c.row AND g.col = c.col),
    d AS (SELECT i, j FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j) WHERE i * i + j * j <= 4)
    SELECT c.row, c.col, sum(n.z) = 13 AS deep, max(n.z) = 1 AS near FROM marked c, d, marked n WHERE n.row = c.row + i AND n.col = c.col + j GROUP BY c.row, c.col""")
def eroded_green(spark, sf_dir):
    """Dissolved areas on cells, eroded (deep) and buffered (near) by a disc; beyond the raster nothing is green."""
    green = band_hits(spark, sf_dir).select("row", "col").distinct().withColumn("_in", F.lit(1.0))
    marked = b.cells(spark, sf_dir).select("row", "col").join(green, ["row", "col"], "left").select("row", "col", F.coalesce("_in", F.lit(0.0)).alias("z"))
    disc = raster.disc(2)
    return raster.spread(marked, disc, F.struct((F.sum("z") == len(disc)).alias("deep"), (F.max("z") == 1).alias("near")), "s").select("row", "col", "s.*")


@query(f"""WITH {plane._SEGMENTS}, tries AS (SELECT eid, f, (ax + bx) / 2.0 - (b_y - ay) / len * 90 * f AS px, (ay + b_y) / 2.0 + (bx - ax) / len * 90 * f AS py FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (b_y - ay) * (b_y - ay)) AS len FROM segments), (VALUES (1.0), (0.6), (0.3), (0.0)) v(f)),
    seen AS (SELECT eid, t.f::DOUBLE AS f, c.z FROM tries t LEFT JOIN cells c ON c.row = floor(py / 20) AND c.col = floor(px / 75))
    SELECT eid, CASE WHEN max(CASE WHEN f = 0 THEN z END) IS NULL THEN 1.0::DOUBLE ELSE max(CASE WHEN z - z0 <= 0.05 THEN f END) END AS factor FROM (SELECT *, max(CASE WHEN f = 0 THEN z END) OVER (PARTITION BY eid) AS z0 FROM seen) GROUP BY eid""")
def side_samples(spark, sf_dir):
    """The widest offset to the left that does not stand on a roof; the full one where the centre has no height."""
    length = F.sqrt((C("bx") - C("ax")) * (C("bx") - C("ax")) + (C("by") - C("ay")) * (C("by") - C("ay")))
    f = F.explode(F.array(*[F.lit(v) for v in (1.0, 0.6, 0.3, 0.0)])).alias("f")
    tries = plane.segments(spark, sf_dir).select("*", length.alias("len"), f).select(
        "eid", "f", F.floor(((C("ay") + C("by")) / 2 + (C("bx") - C("ax")) / C("len") * 90 * C("f")) / 20).alias("row"),
        F.floor(((C("ax") + C("bx")) / 2 - (C("by") - C("ay")) / C("len") * 90 * C("f")) / 75).alias("col"),
    )
    seen = tries.join(b.cells(spark, sf_dir), ["row", "col"], "left")
    # four samples for each edge
    own = seen.groupBy("eid").agg(F.max(F.when(C("f") == 0, C("z"))).alias("z0"), F.collect_list(F.struct("f", "z")).alias("tries"))
    level = F.array_max(F.transform(F.filter("tries", lambda t: t["z"] - C("z0") <= 0.05), lambda t: t["f"]))
    return own.select("eid", F.when(C("z0").isNull(), 1.0).otherwise(level).alias("factor"))
