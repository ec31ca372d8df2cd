"""Angles, distances, tiles and encodings as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000
#: Metres of a degree in the local frame, and the latitude it is made for.
LAT_M, LNG_M, LAT0 = 110_574, 111_320, 50.1109
SECTORS = 16


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def to_xy(lng: Column, lat: Column, lat0: float = LAT0) -> tuple[Column, Column]:
    return lng * (LNG_M * math.cos(math.radians(lat0))), lat * LAT_M


def bearing(dx: Column, dy: Column) -> Column:
    """Compass degrees of a step in metres east and north."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def line_bearing(dx: Column, dy: Column) -> Column:
    """Bearing of a line whose direction doesn't matter: 0 to 180."""
    return F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0))


def delta_deg(a: Column, b: Column) -> Column:
    """Turn from a to b, in (-180, 180]."""
    d = F.pmod(b - a, F.lit(360.0))
    return F.when(d > 180, d - 360).otherwise(d)


def sector(dx: Column, dy: Column, sectors: int = SECTORS) -> Column:
    return F.pmod(F.floor((F.atan2(dy, dx) + math.pi) / (2 * math.pi) * sectors), F.lit(sectors))


def sector_distance(a: Column, b: Column, sectors: int = SECTORS) -> Column:
    d = F.abs(a - b) % sectors
    return F.least(d, sectors - d)


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Place of the nearest point of a segment, 0 at a to 1 at b."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, ((px - ax) * dx + (py - ay) * dy) / F.when(size > 0, size)).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def mercator_tile(lng: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    n = 1 << zoom
    rad = F.radians(lat)
    return F.floor((lng + 180) / 360 * n), F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * n)


def terrarium(z: Column) -> tuple[Column, Column, Column]:
    """Red, green, blue of an elevation in quarter metres."""
    v = F.rint(z * 4) / 4 + 32768
    return F.floor(v / 256), F.floor(v) % 256, F.floor((v - F.floor(v)) * 256)


def from_terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def roundness(area: Column, length: Column) -> Column:
    """Isoperimetric quotient."""
    return 4 * math.pi * area / F.when(length > 0, length * length)


def walk_key(eids: Column) -> Column:
    """The number of edges and a 32-bit FNV-1a hash over whole edge ids, in base 36."""
    hashed = F.aggregate(eids, F.lit(2166136261).cast("long"), lambda h, e: h.bitwiseXOR(e.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) * 16777619 % (1 << 32))
    return F.concat(F.size(eids).cast("string"), F.lit(":"), F.lower(F.conv(hashed.cast("string"), 10, 36)))
