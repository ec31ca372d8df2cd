"""Position of the sun (the published NOAA equations) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elevation at which the sun's rim meets the horizon.
HORIZON = -0.833
MARGIN_MIN, STEP_MIN = 8, 15


def position(days: Column, minute_utc: Column, lat: Column, lng: Column) -> tuple[Column, Column]:
    """Azimuth and elevation in degrees; ``days`` since 1970-01-01, minutes in UTC (may be past midnight)."""
    sin, cos, rad = (lambda x: F.sin(F.radians(x))), (lambda x: F.cos(F.radians(x))), F.radians
    century = (days + minute_utc / 1440 + 2440587.5 - 2451545) / 36525
    mean_lng = F.pmod(280.46646 + century * (36000.76983 + century * 0.0003032), F.lit(360.0))
    anomaly = 357.52911 + century * (35999.05029 - 0.0001537 * century)
    eccentric = 0.016708634 - century * (0.000042037 + 0.0000001267 * century)
    centre = sin(anomaly) * (1.914602 - century * (0.004817 + 0.000014 * century)) + sin(2 * anomaly) * (0.019993 - 0.000101 * century) + sin(3 * anomaly) * 0.000289
    node = 125.04 - 1934.136 * century
    seen = mean_lng + centre - 0.00569 - 0.00478 * sin(node)
    tilt = 23 + (26 + (21.448 - century * (46.815 + century * (0.00059 - century * 0.001813))) / 60) / 60 + 0.00256 * cos(node)
    declination = F.asin(sin(tilt) * sin(seen))
    y = F.pow(F.tan(rad(tilt / 2)), 2)
    equation = 4 * F.degrees(
        y * sin(2 * mean_lng) - 2 * eccentric * sin(anomaly) + 4 * eccentric * y * sin(anomaly) * cos(2 * mean_lng)
        - 0.5 * y * y * sin(4 * mean_lng) - 1.25 * eccentric * eccentric * sin(2 * anomaly)
    )
    hour = rad(F.pmod(minute_utc + equation + 4 * lng, F.lit(1440.0)) / 4 - 180)
    one = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    zenith = F.acos(one(F.sin(rad(lat)) * F.sin(declination) + F.cos(rad(lat)) * F.cos(declination) * F.cos(hour)))
    side = F.degrees(F.acos(one((F.sin(rad(lat)) * F.cos(zenith) - F.sin(declination)) / (F.cos(rad(lat)) * F.sin(zenith)))))
    azimuth = F.when(hour > 0, F.pmod(side + 180, F.lit(360.0))).otherwise(F.pmod(540 - side, F.lit(360.0)))
    return azimuth, 90 - F.degrees(zenith)


def position_sql(days: str, minute: str, lat: str, lng: str) -> str:
    """A SELECT list (az, el) with the same equations, over a table that has these columns."""
    c = f"(({days} + {minute} / 1440.0::DOUBLE + 2440587.5 - 2451545) / 36525)"
    return f"""SELECT *, CASE WHEN ha > 0 THEN (side + 180) % 360 ELSE (540 - side) % 360 END AS az, 90 - degrees(zen) AS el FROM (SELECT *,
        degrees(acos(greatest(-1, least(1, (sin(radians({lat})) * cos(zen) - sin(decl)) / (cos(radians({lat})) * sin(zen)))))) AS side FROM (SELECT *,
        acos(greatest(-1, least(1, sin(radians({lat})) * sin(decl) + cos(radians({lat})) * cos(decl) * cos(ha)))) AS zen FROM (SELECT *,
        radians((({minute} + 4 * degrees(y * sin(2 * radians(l0)) - 2 * ec * sin(radians(mm)) + 4 * ec * y * sin(radians(mm)) * cos(2 * radians(l0)) - 0.5 * y * y * sin(4 * radians(l0))
            - 1.25 * ec * ec * sin(2 * radians(mm))) + 4 * {lng}) % 1440 + 1440) % 1440 / 4 - 180) AS ha FROM (SELECT *,
        asin(sin(radians(eps)) * sin(radians(l0 + ctr - 0.00569 - 0.00478 * sin(radians(om))))) AS decl, pow(tan(radians(eps / 2)), 2) AS y FROM (SELECT *,
        sin(radians(mm)) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + sin(radians(2 * mm)) * (0.019993 - 0.000101 * jc) + sin(radians(3 * mm)) * 0.000289 AS ctr,
        23 + (26 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60) / 60 + 0.00256 * cos(radians(om)) AS eps FROM (SELECT *,
        (280.46646 + jc * (36000.76983 + jc * 0.0003032)) % 360 AS l0, 357.52911 + jc * (35999.05029 - 0.0001537 * jc) AS mm,
        0.016708634 - jc * (0.000042037 + 0.0000001267 * jc) AS ec, 125.04 - 1934.136 * jc AS om FROM (SELECT *, {c} AS jc FROM src)))))))"""


def window(sunrise: Column, sunset: Column) -> tuple[Column, Column]:
    """First bucket minute, snapped up to the grid, and the number of buckets."""
    start = F.ceil((sunrise + MARGIN_MIN) / STEP_MIN) * STEP_MIN
    return start, F.greatest(F.lit(1), F.floor((sunset - MARGIN_MIN - start) / STEP_MIN) + 1)
