"""Queries that classify street pieces by their tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.functions import cost
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col

#: Side tags of a piece, derived from the line's numbers; sql twin below.
_SIDES = """sides AS (SELECT l_orderkey::BIGINT AS way, l_linenumber::BIGINT AS n, l_partkey::BIGINT AS part, l_suppkey::BIGINT AS supp, l_extendedprice AS price, CASE (l_partkey % 4) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'separate' END AS s_left,
    CASE (l_suppkey % 3) WHEN 0 THEN 'both' WHEN 1 THEN NULL ELSE 'left' END AS s_plain, CASE (l_linenumber % 3) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS s_right, CASE (l_orderkey % 4) WHEN 0 THEN 'private' WHEN 1 THEN 'no' WHEN 2 THEN 'yes' END AS access,
    CASE (l_partkey % 3) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS foot, l_quantity AS len, CASE l_returnflag WHEN 'A' THEN 'track' WHEN 'N' THEN 'residential' WHEN 'R' THEN 'path' END AS highway FROM lineitem)"""


def sides(spark, sf_dir):
    def pick(key, values):
        out = F.when(F.lit(False), F.lit(""))
        for i, v in enumerate(values):
            if v:
                out = out.when(C(key) % len(values) == i, v)
        return out

    kinds = F.create_map(*[F.lit(x) for pair in b.HIGHWAY_OF.items() for x in pair])
    return b.table(spark, sf_dir, "lineitem").select(
        C("l_orderkey").cast("long").alias("way"), C("l_linenumber").cast("long").alias("n"), C("l_partkey").cast("long").alias("part"), C("l_suppkey").cast("long").alias("supp"), C("l_extendedprice").alias("price"),
        pick("l_partkey", ["yes", "no", "separate", ""]).alias("s_left"), pick("l_suppkey", ["both", "", "left"]).alias("s_plain"), pick("l_linenumber", ["yes", "no", ""]).alias("s_right"),
        pick("l_orderkey", ["private", "no", "yes", ""]).alias("access"), pick("l_partkey", ["yes", "no", ""]).alias("foot"), C("l_quantity").alias("len"), kinds[C("l_returnflag")].alias("highway"),
    )


KEYS = ["way", "n", "part", "supp", "price"]


@query(f"""WITH {_SIDES} SELECT way, n, part, supp, price, coalesce(s_left, CASE WHEN s_plain = 'both' THEN 'yes' WHEN s_plain = 'left' THEN 'yes' END, '?') AS l, coalesce(s_right, CASE WHEN s_plain = 'both' THEN 'yes' WHEN s_plain = 'left' THEN 'no' END, '?') AS r,
    highway IN ('track', 'pedestrian') OR coalesce(access IN ('no', 'private'), false) AS car_free, NOT coalesce(access IN ('no', 'private'), false) OR coalesce(foot IN ('yes', 'designated', 'permissive'), false) AS walkable,
    CASE WHEN foot = 'yes' AND len > 40 THEN 'walkway' WHEN foot = 'yes' THEN 'crossing' WHEN highway = 'path' AND foot IS NULL THEN 'cycle' ELSE 'street' END AS kind FROM sides""")
def side_states(spark, sf_dir):
    """Sidewalk states, car-free and walkable pieces, crossings by length."""
    plain = C("s_plain")
    barred = F.coalesce(C("access").isin("no", "private"), F.lit(False))
    allowed = F.coalesce(C("foot").isin("yes", "designated", "permissive"), F.lit(False))
    left = F.coalesce("s_left", F.when(plain.isin("both", "left"), "yes"), F.lit("?"))
    right = F.coalesce("s_right", F.when(plain == "both", "yes").when(plain == "left", "no"), F.lit("?"))
    kind = F.when((C("foot") == "yes") & (C("len") > 40), "walkway").when(C("foot") == "yes", "crossing").when((C("highway") == "path") & C("foot").isNull(), "cycle").otherwise("street")
    return sides(spark, sf_dir).select(*KEYS, left.alias("l"), right.alias("r"), (C("highway").isin("track", "pedestrian") | barred).alias("car_free"), (~barred | allowed).alias("walkable"), kind.alias("kind"))


@query(f"""WITH {_SIDES} SELECT way, n, part, supp, price, (CASE WHEN highway = 'residential' AND NOT coalesce(access = 'no', false) THEN 1 ELSE 0 END | CASE WHEN s_left = 'separate' THEN 2 ELSE 0 END | CASE WHEN foot = 'yes' THEN 4 ELSE 0 END
    | CASE WHEN s_left = 'yes' OR s_right = 'yes' THEN 8 ELSE 0 END | CASE WHEN n > 4 THEN 16 ELSE 0 END | CASE WHEN highway = 'primary' THEN 32 ELSE 0 END | CASE WHEN highway = 'path' THEN 64 ELSE 0 END | CASE WHEN access = 'private' THEN 128 ELSE 0 END) AS flags,
    (CASE WHEN part % 11 = 0 THEN 1 ELSE 0 END | CASE WHEN supp % 5 = 0 THEN 2 ELSE 0 END | CASE WHEN supp % 7 = 0 THEN 4 ELSE 0 END | CASE WHEN len > 47 THEN 8 ELSE 0 END | CASE WHEN foot = 'no' THEN 16 ELSE 0 END | CASE WHEN len BETWEEN 30 AND 40 THEN 32 ELSE 0 END
    | CASE WHEN access = 'no' THEN 64 ELSE 0 END | CASE WHEN highway = 'path' AND s_plain IS NULL THEN 128 ELSE 0 END) AS acc FROM sides""")
def flag_bytes(spark, sf_dir):
    """The two flag bytes of a piece."""
    h, none = C("highway"), F.lit(False)
    flags = cost.flags_byte(
        street=(h == "residential") & ~F.coalesce(C("access") == "no", none), mapped=C("s_left") == "separate", crossing=C("foot") == "yes", evidence=F.coalesce(C("s_left") == "yes", none) | F.coalesce(C("s_right") == "yes", none),
        strong=C("n") > 4, major=h == "primary", cycle=h == "path", centred=C("access") == "private",
    )
    parts = [C("part") % 11 == 0, C("supp") % 5 == 0, C("supp") % 7 == 0, C("len") > 47, C("foot") == "no", C("len").between(30, 40), C("access") == "no", (h == "path") & C("s_plain").isNull()]
    acc = F.lit(0)
    for place, part in enumerate(parts):
        acc = acc.bitwiseOR(F.shiftleft(F.coalesce(part, none).cast("int"), place))
    return sides(spark, sf_dir).select(*KEYS, flags.alias("flags"), acc.alias("acc"))


@query(f"""WITH {_SIDES}, w AS (SELECT *, CASE (n % 4) WHEN 0 THEN '12 cm' WHEN 1 THEN '12cm' WHEN 2 THEN '0.9 m' ELSE 'wide' END AS width FROM sides)
    SELECT way, n, part, supp, price, TRY_CAST(trim(replace(replace(width, 'm', ''), 'cm', '')) AS DOUBLE) AS plain, CASE WHEN width LIKE '%cm' THEN NULL ELSE TRY_CAST(nullif(regexp_extract(width, '^([0-9.]+) ?m$', 1), '') AS DOUBLE) END AS metres FROM w""")
def widths(spark, sf_dir):
    """Widths parsed from text; the unit m goes before cm, so that '12 cm' keeps a letter and has no value."""
    width = F.when(C("n") % 4 == 0, "12 cm").when(C("n") % 4 == 1, "12cm").when(C("n") % 4 == 2, "0.9 m").otherwise("wide")
    plain = F.trim(F.replace(F.replace("width", F.lit("m"), F.lit("")), F.lit("cm"), F.lit(""))).try_cast("double")
    metres = F.when(C("width").like("%cm"), None).otherwise(F.nullif(F.regexp_extract("width", "^([0-9.]+) ?m$", 1), F.lit("")).try_cast("double"))
    return sides(spark, sf_dir).withColumn("width", width).select(*KEYS, plain.alias("plain"), metres.alias("metres"))


@query("""SELECT p_partkey AS part, CASE WHEN p_name LIKE '%ring%' THEN 'round' WHEN p_name LIKE '%widget%' THEN 'small' WHEN p_type IN ('ECONOMY', 'PROMO') THEN 'other' END AS kind, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49) AS known FROM part""")
def obstacle_kinds(spark, sf_dir):
    """The kind of an obstacle by the first rule that fits, and membership in a set of ids."""
    kind = F.when(C("p_name").like("%ring%"), "round").when(C("p_name").like("%widget%"), "small").when(C("p_type").isin("ECONOMY", "PROMO"), "other")
    known = b.table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(C("l_partkey").alias("p_partkey"), F.lit(True).alias("known")).distinct()
    return b.table(spark, sf_dir, "part").join(known, "p_partkey", "left").select(C("p_partkey").alias("part"), kind.alias("kind"), F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT district, count(*) AS n, round(sum(CASE WHEN surface IS NULL THEN length ELSE 0 END) / sum(length), 6) AS share, max_by_class AS most FROM (SELECT *, first(surface) OVER (PARTITION BY district ORDER BY c DESC, surface) AS max_by_class FROM
    (SELECT *, count(surface) OVER (PARTITION BY district, surface) AS c FROM tagged)) GROUP BY district, max_by_class""")
def class_shares(spark, sf_dir):
    """Length-weighted share and the most frequent class of each district."""
    t = b.tagged(spark, sf_dir)
    counts = t.where("surface IS NOT NULL").groupBy("district", "surface").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy("district").agg(F.min(F.struct((-C("c")).alias("c"), "surface")).alias("m")).select("district", C("m.surface").alias("most"))
    share = F.round(F.sum(F.when(C("surface").isNull(), C("length")).otherwise(0.0)) / F.sum("length"), 6)
    return t.groupBy("district").agg(F.count(F.lit(1)).alias("n"), share.alias("share")).join(most, "district", "left")


_STAGES = """t AS (SELECT *, flags & 2 <> 0 AS walk, surface_q / 255::DOUBLE AS cost, flags & 128 <> 0 AS mesh, CASE WHEN noise_q < 51 THEN 'A' WHEN noise_q < 102 THEN 'B' WHEN noise_q < 153 THEN 'C' WHEN noise_q < 204 THEN 'D' ELSE 'E' END AS letter, green_q / 255::DOUBLE AS green, green_q // 2 / 255::DOUBLE AS deep,
    CASE WHEN acc % 16 <> 3 THEN slope / 2::DOUBLE END AS steep, (eid * 37 + 20 * 11) % 256 AS noon, eid * 37 % 256 AS morning, (eid * 37 + 8 * 11) % 256 AS lft, (eid * 53 + 8 * 11) % 256 AS rgt FROM edges)"""


@query(f"""WITH {_STAGES}, l AS (SELECT max(n) / sum(n) AS most FROM (SELECT letter, count(*) AS n FROM t GROUP BY letter)) SELECT avg(CASE WHEN walk THEN 1 ELSE 0 END) BETWEEN 0.05 AND 0.6 AS sidewalks, sum(CASE WHEN mesh THEN 1 ELSE 0 END) < 2.0 * sum(CASE WHEN mesh THEN 0 ELSE 1 END) AND max(CASE WHEN mesh THEN len_dm / 10 END) <= 150 + 1 AS mesh,
    min(cost) >= 0 AND max(cost) <= 1 AND avg(cost) < 0.4 AS costs, sum(CASE WHEN cost >= 0.7 AND NOT mesh THEN len_dm ELSE 0 END) / sum(CASE WHEN NOT mesh THEN len_dm ELSE 0 END) BETWEEN 0.001 AND 0.35 AS heavy, avg(CASE WHEN letter IN ('A', 'B', 'C') THEN 1 ELSE 0 END) > 0.15 AND avg(CASE WHEN letter = 'E' THEN 1 ELSE 0 END) < 0.5 AND any_value(most) < 0.95 AS noise,
    avg(morning) > avg(noon) AND avg(noon) / 255 BETWEEN 0.03 AND 0.6 AND avg(CASE WHEN abs(lft - rgt) > 64 THEN 1 ELSE 0 END) > 0.1 AS shade, count(steep) / count(*) > 0.9 AND avg(CASE WHEN abs(coalesce(steep, 0)) < 3 THEN 1 ELSE 0 END) BETWEEN 0.3 AND 0.98 AS slope,
    sum(green * len_dm) / sum(len_dm) BETWEEN 0.05 AND 0.7 AND sum(deep * len_dm) > 0 AND sum(deep * len_dm) < sum(green * len_dm) AS green FROM t, l""")
def expectations(spark, sf_dir):
    """Q2 to Q8: what stages expect of sidewalks, the mesh, costs, noise letters, shade by the clock, slopes and green, as one row of booleans."""
    q, m = C("noise_q"), C("len_dm")
    share = lambda when: F.avg(F.when(when, 1).otherwise(0))
    letter = F.when(q < 51, "A").when(q < 102, "B").when(q < 153, "C").when(q < 204, "D").otherwise("E")
    e = b.edges(spark, sf_dir)
    t = e.select(
        "len_dm", cost.bit(C("flags"), 2).alias("walk"), cost.bit(C("flags"), 128).alias("mesh"), (C("surface_q") / 255).alias("cost"), letter.alias("letter"), (C("green_q") / 255).alias("green"), (F.floor(C("green_q") / 2) / 255).alias("deep"),
        F.when(C("acc") % 16 != 3, C("slope") / 2).alias("steep"), b.shade(C("eid"), F.lit(20)).alias("noon"), b.shade(C("eid"), F.lit(0)).alias("morning"), b.shade(C("eid"), F.lit(8)).alias("left"), ((C("eid") * 53 + 88) % 256).alias("right"),
    )
    most = F.greatest(*[share(C("letter") == c) for c in "ABCDE"])
    of_all = lambda c: F.sum(C(c) * m) / F.sum(m)
    in_net = lambda when: F.sum(F.when(when & ~C("mesh"), m).otherwise(0))
    return t.agg(
        share(C("walk")).between(0.05, 0.6).alias("sidewalks"),
        ((F.sum(C("mesh").cast("int")) < 2.0 * F.sum((~C("mesh")).cast("int"))) & (F.max(F.when(C("mesh"), m / 10)) <= 150 + 1)).alias("mesh"),
        ((F.min("cost") >= 0) & (F.max("cost") <= 1) & (F.avg("cost") < 0.4)).alias("costs"),
        (in_net(C("cost") >= 0.7) / in_net(F.lit(True))).between(0.001, 0.35).alias("heavy"),
        ((share(C("letter").isin("A", "B", "C")) > 0.15) & (share(C("letter") == "E") < 0.5) & (most < 0.95)).alias("noise"),
        ((F.avg("morning") > F.avg("noon")) & (F.avg("noon") / 255).between(0.03, 0.6) & (share(F.abs(C("left") - C("right")) > 64) > 0.1)).alias("shade"),
        ((F.count("steep") / F.count(F.lit(1)) > 0.9) & share(F.abs(F.coalesce("steep", F.lit(0.0))) < 3).between(0.3, 0.98)).alias("slope"),
        (of_all("green").between(0.05, 0.7) & (of_all("deep") > 0) & (of_all("deep") < of_all("green"))).alias("green"),
    )


@query("""WITH t AS (SELECT u // 50 AS band, min(u) AS lo, max(u) AS hi, count(*) AS n FROM edges GROUP BY 1) SELECT bool_and(nx IS NULL OR lo + 50 = nx) AS contiguous, count(*) AS bands, bool_and(hi - lo < 50) AS narrow FROM (SELECT *, lead(lo) OVER (ORDER BY band) AS nx FROM t)""")
def band_checks(spark, sf_dir):
    """Bands follow each other and are no wider than stated."""
    from pyspark.sql import Window

    t = b.edges(spark, sf_dir).groupBy(F.floor(C("u") / b.WIDE).alias("band")).agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    nxt = F.lead("lo").over(Window.orderBy("band"))  # one row per band: few
    return t.withColumn("nx", nxt).agg(F.bool_and(C("nx").isNull() | (C("lo") + b.WIDE == C("nx"))).alias("contiguous"), F.count(F.lit(1)).alias("bands"), F.bool_and(C("hi") - C("lo") < b.WIDE).alias("narrow"))
