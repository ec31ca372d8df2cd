"""Queries over scalar functions: angles, tiles, sun, links, events, validators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pacegrid.functions import cost, geo, sun
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col

#: Cities: id, latitude, longitude, time zone, and borders west, south, east, north.
CITIES = [
    ("frankfurt", 50.1109, 8.6821, "Europe/Berlin", 8.47, 50.01, 8.80, 50.23), ("berlin", 52.52, 13.405, "Europe/Berlin", 13.08, 52.33, 13.77, 52.68),
    ("paris", 48.8566, 2.3522, "Europe/Paris", 2.22, 48.81, 2.47, 48.91), ("london", 51.5074, -0.1278, "Europe/London", -0.25, 51.40, 0.05, 51.62),
    ("new_york", 40.7128, -74.006, "America/New_York", -74.26, 40.49, -73.70, 40.92),
]
_CITY_SQL = "(VALUES " + ", ".join(str(c) for c in CITIES) + ") c(city, lat, lng, tz, w, s, e, n)"


def cities(spark):
    return spark.createDataFrame(CITIES, "city string, lat double, lng double, tz string, w double, s double, e double, n double")


def places(spark, sf_dir):
    """Customers as points around Europe."""
    k = C("c_custkey")
    return b.table(spark, sf_dir, "customer").select(k.alias("id"), (48.5 + (k * 37 % 400) / 100).alias("lat"), (k * 53 % 1400 / 100).alias("lng"))


_PLACES = "places AS (SELECT c_custkey AS id, 48.5 + (c_custkey * 37 % 400) / 100::DOUBLE AS lat, c_custkey * 53 % 1400 / 100::DOUBLE AS lng FROM customer)"


@query(f"""WITH {_PLACES} SELECT id, round(2 * 6371000 * asin(sqrt(pow(sin(radians(50.1109 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(50.1109)) * pow(sin(radians(8.6821 - lng) / 2), 2))), 2) AS metres,
    round(((degrees(atan2((8.6821 - lng) * 71.4, (50.1109 - lat) * 110.574)) % 360) + 360) % 360, 4) AS bearing, floor((lng + 180) / 360 * 4096)::BIGINT AS tx,
    floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096)::BIGINT AS ty, printf('%.4f', lng) || ',' || printf('%.4f', lat) AS point_key FROM places""")
def point_geometry(spark, sf_dir):
    """Distance and bearing to a centre, tile, point key."""
    tx, ty = geo.mercator_tile(C("lng"), C("lat"), 12)
    return places(spark, sf_dir).select(
        "id", F.round(geo.haversine(C("lat"), C("lng"), F.lit(50.1109), F.lit(8.6821)), 2).alias("metres"),
        F.round(geo.bearing((8.6821 - C("lng")) * 71.4, (50.1109 - C("lat")) * 110.574), 4).alias("bearing"), tx.alias("tx"), ty.alias("ty"),
        F.format_string("%.4f,%.4f", "lng", "lat").alias("point_key"),
    )


@query("""SELECT eid, ((45 * (eid % 9) - 170) % 360 + 360) % 360 AS norm, CASE WHEN d > 180 THEN d - 360 ELSE d END AS delta, abs(CASE WHEN d > 180 THEN d - 360 ELSE d END) >= 30 AS turned,
    least(abs(eid % 16 - eid // 16 % 16), 16 - abs(eid % 16 - eid // 16 % 16)) AS sectors FROM (SELECT eid, ((slope * 25 - noise_q * 2) % 360 + 360) % 360 AS d FROM edges)""")
def heading_math(spark, sf_dir):
    """Normalised headings, signed turns, distance of sectors."""
    d = geo.delta_deg(C("noise_q") * 2, C("slope") * 25).cast("long")
    e = C("eid")
    return b.edges(spark, sf_dir).select(
        "eid", F.pmod(45 * (e % 9) - 170, F.lit(360)).alias("norm"), d.alias("delta"), (F.abs(d) >= 30).alias("turned"),
        geo.sector_distance(e % 16, F.floor(e / 16) % 16).alias("sectors"),
    )


@query("""SELECT row, col, r, g, bl, r * 256 + g + bl / 256::DOUBLE - 32768 AS back FROM (SELECT row, col, floor(v / 256)::BIGINT AS r, floor(v)::BIGINT % 256 AS g, floor((v - floor(v)) * 256)::BIGINT AS bl
    FROM (SELECT row, col, round_even(z * 1000 * 4, 0) / 4 + 32768 AS v FROM cells))""")
def terrarium_codes(spark, sf_dir):
    """Elevations as three bytes and back."""
    r, g, bl = geo.terrarium(C("z") * 1000)
    out = b.cells(spark, sf_dir).select("row", "col", r.alias("r"), g.alias("g"), bl.alias("bl"))
    return out.withColumn("back", geo.from_terrarium(C("r"), C("g"), C("bl")))


_SUN_SRC = f"src AS (SELECT city, lat, lng, d AS days, m AS minute FROM {_CITY_SQL}, (SELECT DISTINCT epoch_us(ts) // 86400000000 AS d FROM events) dd, (SELECT unnest(range(0, 1440, 15)) AS m) mm)"


def days_of_cities(spark, sf_dir):
    """Every day that has an event, at every city: the registry is a handful of rows."""
    day = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 86_400_000_000)
    days = b.table(spark, sf_dir, "events").select(day.alias("days")).distinct()
    return days.join(F.broadcast(cities(spark).select("city", "lat", "lng")))


@query(f"WITH {_SUN_SRC} SELECT city, days, minute, round(az, 3) AS az, round(el, 3) AS el FROM ({sun.position_sql('days', 'minute', 'lat', 'lng')})")
def sun_table(spark, sf_dir):
    """Azimuth and elevation per city, day and quarter of an hour (UTC)."""
    az, el = sun.position(C("days"), C("minute"), C("lat"), C("lng"))
    grid = days_of_cities(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(1425), F.lit(15))).alias("minute"))
    return grid.select("city", "days", "minute", F.round(az, 3).alias("az"), F.round(el, 3).alias("el"))


_MINUTES = _SUN_SRC.replace("range(0, 1440, 15)", "range(0, 1440)")


@query(f"""WITH {_MINUTES}, p AS ({sun.position_sql('days', 'minute', 'lat', 'lng')}), t AS (SELECT city, days, coalesce(min(CASE WHEN minute <= 720 AND el > -0.833 THEN minute END), 1439) AS sunrise,
    coalesce(min(CASE WHEN minute > 720 AND el <= -0.833 THEN minute END), 1439) AS sunset FROM p GROUP BY city, days)
    SELECT *, CAST(ceil((sunrise + 8) / 15::DOUBLE) AS BIGINT) * 15 AS start_min, greatest(1, floor((sunset - 8 - CAST(ceil((sunrise + 8) / 15::DOUBLE) AS BIGINT) * 15) / 15::DOUBLE)::BIGINT + 1) AS buckets FROM t""")
def daylight(spark, sf_dir):
    """Sunrise, sunset and the shade window of each day; 1439 where there is none."""
    _, el = sun.position(C("days"), C("minute"), C("lat"), C("lng"))
    grid = days_of_cities(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(1439))).alias("minute"))
    t = grid.withColumn("el", el).groupBy("city", "days").agg(
        F.coalesce(F.min(F.when((C("minute") <= 720) & (C("el") > sun.HORIZON), C("minute"))), F.lit(1439)).alias("sunrise"),
        F.coalesce(F.min(F.when((C("minute") > 720) & (C("el") <= sun.HORIZON), C("minute"))), F.lit(1439)).alias("sunset"),
    )
    start, n = sun.window(C("sunrise"), C("sunset"))
    return t.withColumn("start_min", start).withColumn("buckets", n)


@query(f"""WITH {_PLACES}, t AS (SELECT id, city, CASE WHEN lng BETWEEN w AND e AND p.lat BETWEEN s AND n THEN 0 ELSE 1 END AS outside, k,
    round(2 * 6371000 * asin(sqrt(pow(sin(radians(c.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(c.lat)) * pow(sin(radians(c.lng - p.lng) / 2), 2))), 2) AS d
    FROM (SELECT id, lat, lng AS plng FROM places) p0, (SELECT id AS i2, lat, lng FROM places) p, (SELECT *, row_number() OVER () AS k FROM {_CITY_SQL}) c WHERE p.i2 = p0.id)
    SELECT id, city, outside = 0 AS inside, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY outside, CASE WHEN outside = 0 THEN k ELSE d END, k) AS r FROM t WHERE outside = 0 OR d <= 150000) WHERE r = 1""".replace("WHEN lng BETWEEN", "WHEN p.lng BETWEEN"))
def city_of_point(spark, sf_dir):
    """The city whose box holds a point (first in order), else the nearest within 150 km."""
    c = cities(spark).select("city", C("lat").alias("clat"), C("lng").alias("clng"), "w", "s", "e", "n")
    order = F.create_map(*[F.lit(x) for i, row in enumerate(CITIES) for x in (row[0], i + 1)])
    inside = C("lng").between(C("w"), C("e")) & C("lat").between(C("s"), C("n"))
    d = F.round(geo.haversine(C("lat"), C("lng"), C("clat"), C("clng")), 2)
    # the registry is a handful of rows: each point looks at all of them
    looked = places(spark, sf_dir).join(F.broadcast(c)).withColumns({"inside": inside, "d": d, "k": order[C("city")]})
    rank = Window.partitionBy("id").orderBy(F.desc("inside"), F.when(C("inside"), C("k").cast("double")).otherwise(C("d")), "k")
    return looked.where(C("inside") | (C("d") <= 150_000)).withColumn("r", F.row_number().over(rank)).where("r = 1").select("id", "city", "inside", "d")


#: Zones of customers: those of the registry, and one that no city has.
_ZONES = [c[3] for c in CITIES] + ["Pacific/Apia"]


@query("WITH z AS (SELECT c_custkey AS id, CASE c_custkey % " + str(len(_ZONES)) + " " + " ".join(f"WHEN {i} THEN '{z}'" for i, z in enumerate(_ZONES)) + " END AS tz FROM customer), u AS (SELECT tz, min(city) AS city FROM (VALUES " + ", ".join(str((c[0], c[3])) for c in CITIES) + ") c(city, tz) GROUP BY tz HAVING count(*) = 1) SELECT id, z.tz, city FROM z LEFT JOIN u ON u.tz = z.tz")
def city_of_zone(spark, sf_dir):
    """The city of each customer's time zone, only where it is the one city there."""
    only = cities(spark).groupBy("tz").agg(F.min("city").alias("city"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    zone = F.element_at(F.array(*map(F.lit, _ZONES)), (C("c_custkey") % len(_ZONES) + 1).cast("int"))
    return b.table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), zone.alias("tz")).join(F.broadcast(only), "tz", "left").select("id", "tz", "city")


@query("""SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)(\\.html|/|$)', 1), '') AS BIGINT) AS number, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/]*/([a-z]{2})/', 1), ''), 'none') AS lang, lower(regexp_extract(url, '\\.([a-z]+)$', 1)) AS ending, length(url) AS size FROM pages""")
def url_parts(spark, sf_dir):
    """Parts of links by pattern, with safe defaults."""
    u = C("url")
    return b.table(spark, sf_dir, "pages").select(
        "page_id", F.nullif(F.regexp_extract(u, r"/([0-9]+)(\.html|/|$)", 1), F.lit("")).cast("long").alias("number"), F.regexp_extract(u, "^[a-z]+://([^/?#]*)", 1).alias("host"),
        F.coalesce(F.nullif(F.regexp_extract(u, "^[a-z]+://[^/]*/([a-z]{2})/", 1), F.lit("")), F.lit("none")).alias("lang"), F.lower(F.regexp_extract(u, r"\.([a-z]+)$", 1)).alias("ending"), F.length(u).cast("long").alias("size"),
    )


@query("""SELECT trip, lpad((depart // 60)::VARCHAR, 2, '0') || lpad((depart % 60)::VARCHAR, 2, '0') AS hhmm, CAST(floor(depart / 5::DOUBLE + 0.5) AS BIGINT) * 5 AS snapped,
    least(1439, greatest(0, depart + 20)) AS clamped, CASE WHEN depart < 300 THEN 'night' WHEN depart < 720 THEN 'am' ELSE 'pm' END AS bucket,
    greatest(depart, 480) AS priced_from, least(depart + 600, 1215) AS priced_to, CASE WHEN least(depart + 600, 1215) > greatest(depart, 480) THEN least(depart + 600, 1215) // 60 - greatest(depart, 480) // 60 + 1 ELSE 0 END AS n_hours FROM walks""")
def clock_math(spark, sf_dir):
    """HHMM, snapping, clamping, priced daylight and its hours."""
    m = C("depart")
    start, end = F.greatest(m, F.lit(480)), F.least(m + 600, F.lit(1215))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return b.walks(spark, sf_dir).select(
        "trip", F.concat(two(F.floor(m / 60)), two(m % 60)).alias("hhmm"), (cost.js_round(m / 5) * 5).alias("snapped"), F.least(F.lit(1439), F.greatest(F.lit(0), m + 20)).alias("clamped"),
        F.when(m < 300, "night").when(m < 720, "am").otherwise("pm").alias("bucket"), start.alias("priced_from"), end.alias("priced_to"),
        F.when(end > start, F.size(F.sequence(F.floor(start / 60), F.greatest(F.floor(start / 60), F.floor(end / 60))))).otherwise(0).cast("long").alias("n_hours"),
    )


@query("""WITH RECURSIVE codes AS (SELECT trip, list(eid ORDER BY seq) AS l FROM steps GROUP BY trip),
    h AS (SELECT trip, l, 1 AS i, 2166136261::BIGINT AS k FROM codes UNION ALL SELECT trip, l, i + 1, (xor(k, l[i]) * 16777619) % 4294967296 FROM h WHERE i <= len(l))
    SELECT trip, len(l) || ':' || lower(to_base(k, 36)) AS key FROM h WHERE i = len(l) + 1""")
def walk_keys(spark, sf_dir):
    """The key of each walk's edges."""
    eids = F.transform(F.array_sort(F.collect_list(F.struct("seq", "eid"))), lambda s: s["eid"])
    return b.steps(spark, sf_dir).groupBy("trip").agg(geo.walk_key(eids).alias("key"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL AND TRY_CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 10 AND 90 THEN TRY_CAST(json_extract_string(props, '$.k') AS INT) END AS k,
    CASE WHEN action IN ('click', 'view') THEN action ELSE 'other' END AS kind, coalesce(value, 0) AS value, '/' || action AS page FROM (SELECT *, event_type AS action FROM events)""")
def event_scrub(spark, sf_dir):
    """Fields of event records, kept only in their range, else the safe default."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    a = C("event_type")
    return b.table(spark, sf_dir, "events").select(
        "event_id", F.when(k.between(10, 90), k).alias("k"), F.when(a.isin("click", "view"), a).otherwise("other").alias("kind"), F.coalesce("value", F.lit(0.0)).alias("value"), F.concat(F.lit("/"), a).alias("page"),
    )


@query(f"""WITH {_PLACES} SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'noRoute' WHEN p.lat > 52 THEN 'outsideOrigin' WHEN p.lng > 13 THEN 'outsideDest' END AS reason,
    CASE WHEN c_acctbal IS NULL THEN 'none' WHEN c_acctbal < 0 THEN 'retry' WHEN c_acctbal < 1000 THEN 'wait' ELSE 'run' END AS phase,
    concat_ws('|', lower(c_mktsegment), c_nationkey::VARCHAR, CASE WHEN c_acctbal >= 1000 THEN 'job' ELSE '' END) AS question FROM customer JOIN places p ON p.id = c_custkey""")
def plan_states(spark, sf_dir):
    """Reasons, phases and the identity of a question, by first match."""
    bal = C("c_acctbal")
    joined = b.table(spark, sf_dir, "customer").join(places(spark, sf_dir), C("id") == C("c_custkey"))
    return joined.select(
        "id", F.when(bal < 0, "noRoute").when(C("lat") > 52, "outsideOrigin").when(C("lng") > 13, "outsideDest").alias("reason"),
        F.when(bal.isNull(), "none").when(bal < 0, "retry").when(bal < 1000, "wait").otherwise("run").alias("phase"),
        F.concat_ws("|", F.lower("c_mktsegment"), C("c_nationkey").cast("string"), F.when(bal >= 1000, "job").otherwise("")).alias("question"),
    )


#: A legend's colours by class from the quietest, how far a colour may be off, what counts as opaque, and the colours (with opacity) of classes 1 to 8.
LEGEND, TOLERANCE, OPAQUE = [(226, 242, 191), (243, 198, 131), (205, 70, 62), (117, 8, 92), (67, 10, 74)], 8, 128
RAMP = [(0, 0, 0, 0), (0, 0, 0, 0), (255, 214, 130, 0), (255, 214, 130, 40), (250, 170, 90, 60), (236, 112, 78, 80), (205, 70, 95, 95), (150, 45, 110, 110)]

_PIXELS = "px AS (SELECT row, col, " + ", ".join(f"[{', '.join(str(c[i]) for c in LEGEND)}][((row + col) % 5 + 1)::INT] + (row * {k} + col * {j}) % {m} - {m // 2} AS {n}" for i, (n, k, j, m) in enumerate([("r", 3, 1, 11), ("g", 5, 2, 7), ("bl", 2, 7, 9)])) + ", (row * 7 + col) % 256 AS alpha, 1 + (row * 31 + col * 17) % 760 / 100.0::DOUBLE AS v FROM cells)"
_OFF = "[" + ", ".join(f"abs(r - {r}) + abs(g - {g}) + abs(bl - {bl})" for r, g, bl in LEGEND) + "]"


@query(f"""WITH {_PIXELS}, o AS (SELECT *, {_OFF} AS off, least(greatest(v, 1), 8) AS c FROM px), p AS (SELECT *, floor(c)::INT AS c0, least(floor(c)::INT + 1, 8) AS c1, c - floor(c) AS f FROM o)
    SELECT row, col, CASE WHEN alpha > 0 THEN coalesce(list_position(list_transform(off, lambda x: x <= 8), true), 0) ELSE 0 END::BIGINT AS within, CASE WHEN alpha > 128 THEN list_position(off, list_min(off)) ELSE 0 END::BIGINT AS nearest,
    {', '.join(f"round_even([{', '.join(f'{c[i]}::DOUBLE' for c in RAMP)}][c0] * (1 - f) + [{', '.join(f'{c[i]}::DOUBLE' for c in RAMP)}][c1] * f, 0)::BIGINT AS {n}" for i, n in enumerate(("red", "green", "blue", "opacity")))} FROM p""")
def palette_class(spark, sf_dir):
    """The class of each pixel by the first colour of the legend within the tolerance, and by the nearest one; and the colour of a level between two classes."""
    r, c = C("row"), C("col")
    at = ((r + c) % 5 + 1).cast("int")
    channel = lambda i, k, j, m: F.element_at(F.array(*[F.lit(x[i]) for x in LEGEND]), at) + (r * k + c * j) % m - m // 2
    px = b.cells(spark, sf_dir).select("row", "col", channel(0, 3, 1, 11).alias("r"), channel(1, 5, 2, 7).alias("g"), channel(2, 2, 7, 9).alias("bl"), ((r * 7 + c) % 256).alias("alpha"), (1 + (r * 31 + c * 17) % 760 / 100).alias("v"))
    off = F.array(*[F.abs(C("r") - x) + F.abs(C("g") - y) + F.abs(C("bl") - z) for x, y, z in LEGEND])
    level = F.least(F.greatest(C("v"), F.lit(1.0)), F.lit(8.0))
    low = F.floor(level).cast("int")
    part = level - low
    ramp = lambda i, k: F.element_at(F.array(*[F.lit(float(x[i])) for x in RAMP]), k)
    blend = [F.rint(ramp(i, low) * (1 - part) + ramp(i, F.least(low + 1, F.lit(8))) * part).cast("long").alias(n) for i, n in enumerate(("red", "green", "blue", "opacity"))]
    found = px.withColumn("off", off)
    within = F.when(C("alpha") > 0, F.array_position(F.transform("off", lambda x: x <= TOLERANCE), F.lit(True))).otherwise(0)
    nearest = F.when(C("alpha") > OPAQUE, F.array_position("off", F.array_min("off"))).otherwise(0)
    return found.select("row", "col", within.cast("long").alias("within"), nearest.cast("long").alias("nearest"), *blend)


@query("""SELECT eid, (greatest(l, r) >> 4) * 17 AS shade16, l > r AS left_side FROM (SELECT eid, (eid * 37) % 256 AS l, (eid * 91) % 256 AS r FROM edges)""")
def shade_block(spark, sf_dir):
    """The shadier side in 16 levels, and which side it is."""
    left, right = C("eid") * 37 % 256, C("eid") * 91 % 256
    return b.edges(spark, sf_dir).select("eid", (F.shiftright(F.greatest(left, right), 4) * 17).alias("shade16"), (left > right).alias("left_side"))
