"""Rasters as rows (row, col, z): neighbourhoods and blocks as joins and groups, shadows as a kernel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def blocks(cells: DataFrame, size: int, how: Column, name: str = "z") -> DataFrame:
    """One value per block of ``size`` x ``size`` cells; blocks that the raster cuts off go."""
    out = cells.groupBy(F.floor(C("row") / size).alias("row"), F.floor(C("col") / size).alias("col"))
    return out.agg(how.alias(name), F.count(F.lit(1)).alias("_n")).where(C("_n") == size * size).drop("_n")


def spread(cells: DataFrame, offsets: list[tuple[int, int]], how: Column, name: str = "z") -> DataFrame:
    """Each cell's value over its neighbours at ``offsets``: cells send their value there.

    Offsets are a fixed few, so rows grow by their number; the shuffle is one, on cells.
    """
    to = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i, j in offsets])).alias("o")
    sent = cells.select("row", "col", "z", to).select((C("row") + C("o.i")).alias("row"), (C("col") + C("o.j")).alias("col"), "z", ((C("o.i") == 0) & (C("o.j") == 0)).alias("own"))
    return sent.groupBy("row", "col").agg(how.alias(name), F.bool_or("own").alias("_own")).where("_own").drop("_own")


def square(reach: int = 1) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]


def disc(reach: int) -> list[tuple[int, int]]:
    return [(i, j) for i, j in square(reach) if i * i + j * j <= reach * reach]


def lined_shadow(cells: DataFrame, elevation: float, size: float = 1.0, slack: float = 0.01) -> DataFrame:
    """Cells in shadow of a sun due west: the horizon that earlier columns raise, falling with distance."""
    drop = math.tan(math.radians(elevation)) * size
    before = Window.partitionBy("row").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)
    horizon = F.max(C("z") + C("col") * drop).over(before) - C("col") * drop
    return cells.select("row", "col", F.coalesce(horizon > C("z") + slack, F.lit(False)).alias("shaded"))


def shadows(cells: DataFrame, azimuth: float, elevation: float, size: float = 1.0, slack: float = 0.01) -> DataFrame:
    """(row, col, shaded): cells of a height field that a sun in any direction leaves in shadow.

    A ray away from the sun goes one cell along the steeper axis and ``slope`` cells
    aside, so cells of one ``aside - rint(slope * along)`` are on one ray.  The sun's ray
    over a cell of height z is at ``z + fall * along`` above the cells' own places:
    a cell is in shadow if an earlier one of its ray stands higher.  Rays are windows,
    as many as the raster has rows and columns; places count from the side the sun is on.
    """
    if elevation <= 0:
        return cells.select("row", "col", F.lit(True).alias("shaded"))
    right, down = -math.sin(math.radians(azimuth)), math.cos(math.radians(azimuth))
    by_column = abs(right) > abs(down)
    names, steps = (("col", "row"), (right, down)) if by_column else (("row", "col"), (down, right))
    ends = cells.agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(f"_{n}") for n in ("row", "col")])  # one row
    along, aside = (C(n) - C(f"_{n}.lo") if step >= 0 else C(f"_{n}.hi") - C(n) for n, step in zip(names, steps))
    slope = abs(steps[1]) / abs(steps[0])
    fall = math.tan(math.radians(elevation)) * size * math.hypot(1, slope)
    rays = cells.crossJoin(F.broadcast(ends)).select("row", "col", "z", along.alias("_along"), (aside - F.rint(slope * along)).alias("_ray"))
    before = Window.partitionBy("_ray").orderBy("_along").rowsBetween(Window.unboundedPreceding, -1)
    higher = F.max(C("z") + C("_along") * fall).over(before) - C("_along") * fall > C("z") + slack
    return rays.select("row", "col", F.coalesce(higher, F.lit(False)).alias("shaded"))


#: Fixed values of the ray march: what stands on the ground at most, how far it is looked for, steps, and how much higher counts.
MAX_H, MAX_REACH_M, MAX_STEPS, EPS = 60.0, 400.0, 400, 0.05


def march(elevation: float, ground: float) -> tuple[int, float, float]:
    """(steps, cells a step, metres the ray climbs a step) towards a sun above the horizon; beyond ``MAX_STEPS`` a step is longer."""
    rise = math.tan(math.radians(elevation))
    steps, size = math.ceil(min(MAX_REACH_M, MAX_H / rise) / ground), 1.0
    if steps > MAX_STEPS:
        steps, size = MAX_STEPS, steps / MAX_STEPS
    return steps, size, rise * size * ground


def marched(cells: DataFrame, azimuth: float, elevation: float, ground: float, tile: int = 64) -> DataFrame:
    """(row, col, shaded) of a height field (row, col, z; null: no data) by rays that climb from each cell towards the sun, row 0 in the north.

    Not the shadow of ``shadows``: the ray starts ``EPS`` above the cell, looks no farther than what
    stands ``MAX_H`` high can throw, and takes the cell under each step, so that what lies
    between two steps is missed.  Without a sun all is shaded; cells without data are not, and shade none.

    A tile's rays need the tiles within their reach on the sun's side: cells are sent there, so every tile is
    a task of its own, with a grid of bounded size.  A tile's march ends when its lowest ray is above all that stands there.
    """
    if elevation <= 0:
        return cells.select("row", "col", F.lit(True).alias("shaded"))
    steps, size, rise = march(elevation, ground)
    right, down = math.sin(math.radians(azimuth)) * size, -math.cos(math.radians(azimuth)) * size
    far = [math.ceil(abs(d) * steps) + 1 for d in (down, right)]

    def tiles(c: str, step: float, reach: int) -> Column:
        """Tiles along an axis whose rays may look at a cell: its own and those from which the sun lies behind it."""
        low, high = (C(c) - reach, C(c)) if step >= 0 else (C(c), C(c) + reach)
        return F.explode(F.sequence(F.floor(low / tile), F.floor(high / tile)))

    sent = cells.withColumn("_i", tiles("row", down, far[0])).withColumn("_j", tiles("col", right, far[1]))

    def shade(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(key[0]), int(key[1])
        own = pdf[(pdf.row // tile == i) & (pdf.col // tile == j)]
        if own.empty:
            return pd.DataFrame({"row": [], "col": [], "shaded": []}).astype({"row": "int64", "col": "int64", "shaded": bool})
        top, left = int(pdf.row.min()), int(pdf.col.min())
        grid = np.full((int(pdf.row.max()) - top + 1, int(pdf.col.max()) - left + 1), -np.inf)
        grid[pdf.row.to_numpy() - top, pdf.col.to_numpy() - left] = pdf.z.fillna(-np.inf).to_numpy(float)
        row, col, z = own.row.to_numpy(), own.col.to_numpy(), own.z.to_numpy(float)
        dark = np.zeros(len(own), bool)
        known, highest = ~np.isnan(z), grid.max()
        for k in range(1, steps + 1):
            rest = np.flatnonzero(known & ~dark & ((z + EPS) + k * rise < highest))
            if not len(rest):
                break
            y = np.floor(row[rest] + 0.5 + k * down).astype(int) - top
            x = np.floor(col[rest] + 0.5 + k * right).astype(int) - left
            within = (y >= 0) & (x >= 0) & (y < grid.shape[0]) & (x < grid.shape[1])
            seen = np.full(len(rest), -np.inf)
            seen[within] = grid[y[within], x[within]]
            dark[rest] = seen > (z[rest] + EPS) + k * rise
        return pd.DataFrame({"row": row, "col": col, "shaded": dark})

    return sent.groupBy("_i", "_j").applyInPandas(shade, "row long, col long, shaded boolean")
