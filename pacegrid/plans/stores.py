"""Queries over sources and sinks: artifacts, bands, manifests, text grids, tolerant records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pacegrid.registry import query
from pacegrid.sources import artifact
from pacegrid.sources import bindings as b
from pacegrid.streaming.fixes import shared

C = F.col
#: Buckets of a band.
BAND_WIDE = 8


@query("SELECT u // 1000 AS city, count(*) AS n, sum(len_dm)::BIGINT AS len_dm, bit_xor(eid * 7 + flags) AS mark FROM edges GROUP BY 1")
def artifact_round_trip(spark, sf_dir):
    """Edges packed per city, written, read, checked and unpacked."""
    e = b.edges(spark, sf_dir).withColumn("city", F.floor(C("u") / 1000))
    path = shared(spark, "artifact")
    artifact.packed(e).write.parquet(path)
    back = artifact.unpacked(spark.read.parquet(path))
    return back.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.sum("len_dm").alias("len_dm"), F.bit_xor(C("eid") * 7 + C("flags")).alias("mark"))


@query("""SELECT k // 8 AS band, count(*) AS n, sum((eid * 37 + k * 11) % 256)::BIGINT AS shade FROM edges, (SELECT unnest(range(0, 50)) AS k) s WHERE k // 8 IN (2, 3) GROUP BY 1""")
def band_read(spark, sf_dir):
    """Shade written by band, and the bands of a walk alone read back."""
    # one row of bytes for each edge and band, as long as the band: not a row for each byte
    band = lambda first: F.array(*[b.shade(C("eid"), F.lit(k).cast("long")).cast("short") for k in range(first, min(first + BAND_WIDE, b.BUCKETS))])
    bands = F.posexplode(F.array(*map(band, range(0, b.BUCKETS, BAND_WIDE)))).alias("band", "shade")
    path = shared(spark, "bands")
    b.edges(spark, sf_dir).select("eid", bands).write.partitionBy("band").parquet(path)
    back = spark.read.parquet(path).where(C("band").isin(2, 3)).select(C("band").cast("long").alias("band"), F.explode("shade").alias("shade"))
    return back.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("shade").alias("shade"))


@query("""WITH f AS (SELECT event_type AS stem, value FROM events UNION ALL SELECT 'all', value FROM events) SELECT stem, count(*) AS files, round(sum(value), 2) AS bytes, greatest(1, round(sum(value) / 100000, 1)) AS mb FROM f GROUP BY stem""")
def manifest(spark, sf_dir):
    """Sizes summed under two keys per file."""
    e = b.table(spark, sf_dir, "events")
    f = e.select(C("event_type").alias("stem"), "value").unionByName(e.select(F.lit("all").alias("stem"), "value"))
    total = F.sum("value")
    return f.groupBy("stem").agg(F.count(F.lit(1)).alias("files"), F.round(total, 2).alias("bytes"), F.greatest(F.lit(1.0), F.round(total / 100000, 1)).alias("mb"))


_LINES = """lines AS (SELECT l_orderkey::BIGINT AS file, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice) AS n, CASE WHEN l_partkey % 3 = 0 THEN '<Klasse>' || l_linenumber || '</Klasse>' ELSE '<posList>' || l_partkey || ' ' || l_suppkey || '</posList>' END AS line FROM lineitem)"""


@query(f"""WITH {_LINES}, p AS (SELECT file, n, nullif(regexp_extract(line, '<posList>([0-9]+) ([0-9]+)', 1), '') AS x, nullif(regexp_extract(line, '<posList>([0-9]+) ([0-9]+)', 2), '') AS y, nullif(regexp_extract(line, '<Klasse>([0-9]+)', 1), '') AS k FROM lines)
    SELECT file, n, x::BIGINT AS x, y::BIGINT AS y, cls::BIGINT AS class FROM (SELECT *, last_value(k IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cls FROM p) WHERE x IS NOT NULL AND cls IS NOT NULL""")
def classed_points(spark, sf_dir):
    """Points of a text file, each with the class that the last class line before it states."""
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    line = F.when(C("l_partkey") % 3 == 0, F.concat(F.lit("<Klasse>"), "l_linenumber", F.lit("</Klasse>"))).otherwise(F.concat(F.lit("<posList>"), "l_partkey", F.lit(" "), "l_suppkey", F.lit("</posList>")))
    lines = b.table(spark, sf_dir, "lineitem").select(C("l_orderkey").cast("long").alias("file"), F.row_number().over(order).cast("long").alias("n"), line.alias("line"))
    part = lambda pattern, i: F.nullif(F.regexp_extract("line", pattern, i), F.lit("")).cast("long")
    p = lines.select("file", "n", part("<posList>([0-9]+) ([0-9]+)", 1).alias("x"), part("<posList>([0-9]+) ([0-9]+)", 2).alias("y"), part("<Klasse>([0-9]+)", 1).alias("k"))
    seen = F.last("k", ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("class", seen).where("x IS NOT NULL AND class IS NOT NULL").drop("k")


@query("""WITH xyz AS (SELECT (1000 + col * 2)::DOUBLE AS x, (5000 - row * 2)::DOUBLE AS y, z FROM cells), s AS (SELECT median(d) AS step FROM (SELECT x - lag(x) OVER (ORDER BY x) AS d FROM (SELECT DISTINCT x FROM xyz)))
    SELECT CAST(round((mx - y) / step) AS BIGINT) AS row, CAST(round((x - nx) / step) AS BIGINT) AS col, round(z, 6) AS z FROM xyz, s, (SELECT min(x) AS nx, max(y) AS mx FROM xyz)""")
def text_grid(spark, sf_dir):
    """Lines "x y z" to rows and columns of a grid whose step is the median difference."""
    text = b.cells(spark, sf_dir).select(F.concat_ws(" ", (1000 + C("col") * 2).cast("double").cast("string"), (5000 - C("row") * 2).cast("double").cast("string"), C("z").cast("string")).alias("line"))
    f = F.split("line", " ")
    xyz = text.select(*[f[i].cast("double").alias(n) for i, n in enumerate("xyz")])
    # distinct columns of one tile: a few thousand numbers
    steps = xyz.select("x").distinct().withColumn("d", C("x") - F.lag("x").over(Window.orderBy("x")))
    frame = steps.agg(F.percentile("d", F.lit(0.5)).alias("step")).join(xyz.agg(F.min("x").alias("w"), F.max("y").alias("n")))
    return xyz.join(F.broadcast(frame)).select(F.floor((C("n") - C("y")) / C("step") + 0.5).alias("row"), F.floor((C("x") - C("w")) / C("step") + 0.5).alias("col"), F.round("z", 6).alias("z"))


@query("""SELECT conv_id, turn, length(trim(text)) > 0 AND role IN ('user', 'assistant') AS valid, left(trim(text), 40) AS text, coalesce(nullif(trim(role), ''), 'unknown') AS role FROM conversations""")
def reports(spark, sf_dir):
    """Records checked, trimmed and bounded field by field."""
    t = F.trim("text")
    return b.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", ((F.length(t) > 0) & C("role").isin("user", "assistant")).alias("valid"), F.left(t, F.lit(40)).alias("text"), F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown")).alias("role"),
    )


@query("""SELECT user_id, coalesce(theme, 'light') AS theme, coalesce(pace, 4.0) AS pace FROM (SELECT user_id, arg_max(CASE WHEN event_type IN ('click', 'view') THEN event_type END, event_id) AS theme, arg_max(CASE WHEN value BETWEEN 1 AND 6 THEN round(value, 2) END, event_id) AS pace FROM events GROUP BY user_id)""")
def settings(spark, sf_dir):
    """The newest valid value of each setting over its default."""
    e = b.table(spark, sf_dir, "events")
    newest = lambda when, value: F.max(F.when(when, F.struct("event_id", value.alias("v"))))["v"]
    return e.groupBy("user_id").agg(
        F.coalesce(newest(C("event_type").isin("click", "view"), C("event_type")), F.lit("light")).alias("theme"), F.coalesce(newest(C("value").between(1, 6), F.round("value", 2)), F.lit(4.0)).alias("pace"),
    )


#: The minutes that are asked for.
ASKED_MIN = (780.0, 900.0)


@query("""SELECT e.u // 1000 AS city, eid, bucket, (eid * 37 + bucket * 11) % 256 AS shade FROM edges e, (SELECT unnest(range(16, 32)) AS bucket) k WHERE e.u // 1000 = e.v // 1000""")
def rebanded_shade(spark, sf_dir):
    """Files of whole days split into bands without working shade out again, checked to be the same, and only the bands of an afternoon read back."""
    from pacegrid.operators import store
    from pacegrid.plans import networks
    from pacegrid.sources import bands

    files = store.stored(bands.whole(networks.placed(spark, sf_dir).select("city", "eid", "shade")), "shade-days")
    split = store.stored(bands.rebanded(files, b.BUCKETS, BAND_WIDE), "shade-bands", by="band")
    if not bands.differing(files, split, b.BUCKETS, BAND_WIDE).isEmpty():
        raise ValueError("the bands differ from the days")
    store.drop(files)
    return bands.read(split, bands.needed(*ASKED_MIN, b.START_MIN, b.STEP_MIN, b.BUCKETS, BAND_WIDE), b.BUCKETS, BAND_WIDE)
