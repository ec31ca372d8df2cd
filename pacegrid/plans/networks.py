"""Queries over graphs, selections and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pacegrid.operators import network, select
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col
#: Nodes of one city: 20 grid rows.
CITY = 1000


#: First minute and step of the shade series, and metres a minute.
CLOCK = (b.START_MIN, b.STEP_MIN, b.SPEED)


def placed(spark, sf_dir):
    """Edges within cities, with their shade series and the places of their ends; nodes are not broadcast, as in ``b.edges``."""
    n = b.nodes(spark, sf_dir).hint("merge")
    e = b.edges(spark, sf_dir).withColumn("city", F.floor(C("u") / CITY)).where(F.floor(C("v") / CITY) == C("city"))
    series = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(b.BUCKETS - 1).cast("long")), lambda k: b.shade(C("eid"), k))
    return e.join(n.toDF("v", "x2", "y2"), "v").join(n.toDF("u", "x1", "y1"), "u").withColumn("shade", series)


def asked(spark, sf_dir):
    """A route query of every fiftieth order, across a few blocks."""
    w = b.walks(spark, sf_dir).where("trip % 50 = 0")
    return w.select(F.floor(C("origin") / CITY).alias("city"), "trip", C("origin").alias("start"), F.least(C("origin") + 5, F.floor(C("origin") / 50) * 50 + 49).alias("goal"), "depart")


@query()
def routed(spark, sf_dir):
    """Time-dependent best ways with turn costs."""
    out = network.routes(placed(spark, sf_dir), asked(spark, sf_dir), CLOCK, access="walk")
    return out.select("trip", F.size("eids").alias("n_edges"), F.round("metres", 3).alias("metres"), F.round("cost", 3).alias("cost"), "eids")


@query()
def routed_to_pins(spark, sf_dir):
    """Best ways to a place on an edge, by the end that is cheaper with the piece from there; the piece counts in metres and price."""
    pins = asked(spark, sf_dir).withColumns({"pin": C("goal") * 4 + 1, "part": (C("trip") % 11) / 10})
    out = network.routes_to_pins(placed(spark, sf_dir), pins, CLOCK, access="walk")
    return out.select("trip", F.round("metres", 3).alias("metres"), F.round("cost", 3).alias("cost"), F.round("piece_m", 3).alias("piece_m"), "eids")


@query("""WITH RECURSIVE p AS (SELECT s AS source, s AS node, 0::BIGINT AS dist FROM (SELECT node AS s FROM nodes WHERE node % 50 = 0) UNION
    SELECT source, v, dist + len_dm FROM p JOIN edges ON u = node WHERE dist <= 3000 AND dist + len_dm <= 4600) SELECT source, node, min(dist) AS dist FROM p GROUP BY source, node""")
def relaxed(spark, sf_dir):
    """Least metres from every fiftieth node; nodes past 300 m are reached but lead no further."""
    e = b.edges(spark, sf_dir).select("u", "v", C("len_dm").alias("w"))
    return network.relax(e, b.nodes(spark, sf_dir).where("node % 50 = 0").select(C("node").alias("source")), 3000)


_FEW = "few AS (SELECT u, v FROM edges WHERE noise_q < 90)"


@query(f"""WITH RECURSIVE {_FEW}, b AS (SELECT u, v FROM few UNION SELECT v, u FROM few), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT c.node, c.component, count(*) OVER (PARTITION BY component) AS size FROM c""")
def pockets(spark, sf_dir):
    """Connected pockets of quiet edges, and their sizes."""
    found = network.components(b.edges(spark, sf_dir).where("noise_q < 90").select("u", "v"))
    size = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return found.join(size, "component").select("node", "component", "size")


@query(f"""WITH RECURSIVE {_FEW}, b AS (SELECT u, v FROM few UNION SELECT v, u FROM few), r AS (SELECT u AS node, u AS seen FROM b UNION SELECT r.node, b.v FROM r JOIN b ON b.u = r.seen), c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT node FROM c WHERE component = (SELECT component FROM c GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)""")
def largest_pocket(spark, sf_dir):
    """The nodes of the largest pocket, the lower one on ties."""
    found = network.components(b.edges(spark, sf_dir).where("noise_q < 90").select("u", "v"))
    best = found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(1).select("component")
    return found.join(best, "component", "left_semi").select("node")


_OPTIONS = """options AS (SELECT o_custkey AS query, o_orderkey::BIGINT AS cand, o_totalprice AS score, 1000 + o_orderkey % 700 AS metres, o_orderkey % 16 AS sector, list_transform(range(0, 6), lambda i: (o_orderkey % 5) * 3 + i) AS eids FROM orders)"""


def options(spark, sf_dir):
    k = C("o_orderkey").cast("long")
    eids = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")), lambda i: k % 5 * 3 + i)
    return b.table(spark, sf_dir, "orders").select(C("o_custkey").alias("query"), k.alias("cand"), C("o_totalprice").alias("score"), (1000 + k % 700).alias("metres"), (k % 16).alias("sector"), eids.alias("eids"))


@query(f"WITH {_OPTIONS} SELECT query, cand, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score, cand) AS n FROM options) WHERE n <= 3")
def best_three(spark, sf_dir):
    """The best three of each query."""
    return select.top_k(options(spark, sf_dir), ["query"], [C("score"), C("cand")], 3).select("query", "cand", "score")


@query()
def diverse_three(spark, sf_dir):
    """Three options in different directions with little overlap, relaxed if there are fewer."""
    return select.diverse(options(spark, sf_dir), 3, 1300.0)


@query()
def unlike_loops(spark, sf_dir):
    """T4: near-duplicate loops suppressed, best first."""
    return select.unlike(options(spark, sf_dir))


@query(f"""WITH {_OPTIONS}, p AS (SELECT a.query, a.cand AS a, b.cand AS b, len(list_intersect(a.eids, b.eids)) AS shared, len(list_distinct(list_concat(a.eids, b.eids))) AS whole FROM options a JOIN options b ON a.query = b.query AND a.cand < b.cand)
    SELECT query, a, b, round(shared / 6::DOUBLE, 5) AS overlap, round(shared / whole::DOUBLE, 5) AS jaccard, whole - shared AS odd FROM p""")
def overlaps(spark, sf_dir):
    """Overlap, Jaccard and symmetric difference of options of one query.

    Pairs are within a query's few options, ordered, so each comes once.
    """
    o = options(spark, sf_dir).select("query", "cand", "eids")
    p = o.toDF("query", "a", "ea").join(o.toDF("query", "b", "eb"), "query").where("a < b")
    both, one = F.size(F.array_intersect("ea", "eb")), F.size(F.array_union("ea", "eb"))
    odd = F.size(F.array_union(F.array_except("ea", "eb"), F.array_except("eb", "ea")))
    return p.select("query", "a", "b", F.round(both / 6, 5).alias("overlap"), F.round(both / one, 5).alias("jaccard"), odd.alias("odd"))


#: What an alternative must be better by, and what its note warns of.
FASTER_MIN, AXIS_PP, SUN_MIN, SUN_RATIO, COBBLE_M, LOUD_PP, CLIMB_M = -2, 10, 5, 1.5, 100, 15, 15
_CARDS = """cards AS (SELECT o_custkey AS query, o_orderkey::BIGINT AS cand, CASE o_orderkey % 4 WHEN 0 THEN 'faster' WHEN 1 THEN 'shadier' WHEN 2 THEN 'quieter' ELSE 'loop' END AS kind, o_orderkey % 17 - 8 AS delta_min, o_orderkey * 7 % 101 AS shade_pct, o_orderkey * 13 % 101 AS quiet_pct,
    o_orderkey * 3 % 41 % 12 AS sun_min, o_orderkey * 11 % 400 // 3 AS cobble_m, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey * 17 % 101 // 2 END AS loud_pct, CASE WHEN o_orderkey % 6 > 0 THEN o_orderkey * 19 % 53 END AS climb_m, o_custkey % 3 > 0 AS wander, o_custkey % 9 = 0 AS night FROM orders),
    recs AS (SELECT * FROM cards QUALIFY row_number() OVER (PARTITION BY query ORDER BY cand) = 1),
    tagged_cards AS (SELECT c.*, r.shade_pct AS r_shade, r.quiet_pct AS r_quiet, r.sun_min AS r_sun, r.cobble_m AS r_cobble, r.loud_pct AS r_loud, r.climb_m AS r_climb, r.cand AS rec,
      c.delta_min <= -2 AS f, NOT c.night AND c.shade_pct - r.shade_pct >= 10 AS s, c.quiet_pct - r.quiet_pct >= 10 AS q, CASE WHEN (c.kind = 'faster' AND f) OR (c.kind = 'shadier' AND s) OR (c.kind = 'quieter' AND q) THEN c.kind WHEN f THEN 'faster' WHEN s THEN 'shadier' WHEN q THEN 'quieter' END AS tag
      FROM cards c JOIN recs r ON r.query = c.query WHERE c.cand <> r.cand)"""


def cards(spark, sf_dir):
    k = C("o_orderkey").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ("faster", "shadier", "quieter", "loop"))), (k % 4 + 1).cast("int"))
    part = lambda x, n: F.floor(x / n)
    return b.table(spark, sf_dir, "orders").select(
        C("o_custkey").alias("query"), k.alias("cand"), kind.alias("kind"), (k % 17 - 8).alias("delta_min"), (k * 7 % 101).alias("shade_pct"), (k * 13 % 101).alias("quiet_pct"),
        (k * 3 % 41 % 12).alias("sun_min"), part(k * 11 % 400, 3).alias("cobble_m"), F.when(k % 5 > 0, part(k * 17 % 101, 2)).alias("loud_pct"), F.when(k % 6 > 0, k * 19 % 53).alias("climb_m"),
        (C("o_custkey") % 3 > 0).alias("wander"), (C("o_custkey") % 9 == 0).alias("night"),
    )


def tagged_cards(spark, sf_dir):
    """Every card but the recommendation (the first of its query, ``r``), with the axis it beats that one on: its intended one first; null if none."""
    c = cards(spark, sf_dir)
    first = c.groupBy("query").agg(F.min_by(F.struct("cand", "shade_pct", "quiet_pct", "sun_min", "cobble_m", "loud_pct", "climb_m"), "cand").alias("r"))
    t = c.join(first, "query").where(C("cand") != C("r.cand"))
    beats = {
        "faster": C("delta_min") <= FASTER_MIN,
        "shadier": ~C("night") & (C("shade_pct") - C("r.shade_pct") >= AXIS_PP),
        "quieter": C("quiet_pct") - C("r.quiet_pct") >= AXIS_PP,
    }
    intended = F.coalesce(*[F.when((C("kind") == axis) & won, axis) for axis, won in beats.items()])
    return t.withColumn("tag", F.coalesce(intended, *[F.when(won, axis) for axis, won in beats.items()]))


@query(f"""WITH {_CARDS} SELECT query, cand, tag, CASE WHEN sun_min >= 5 AND sun_min >= 1.5 * r_sun THEN 'sun ' || sun_min WHEN cobble_m - r_cobble >= 100 THEN CASE WHEN r_cobble > 0 THEN 'cobbles +' || (cobble_m - r_cobble) ELSE 'cobbles ' || cobble_m END
    WHEN loud_pct - r_loud >= 15 THEN 'loud ' || loud_pct WHEN wander AND climb_m - r_climb >= 15 THEN 'climb ' || (climb_m - r_climb) WHEN tag = 'quieter' THEN 'quiet ' || quiet_pct WHEN night THEN 'after sunset' ELSE 'shade ' || shade_pct END AS note FROM tagged_cards WHERE tag IS NOT NULL""")
def alternatives(spark, sf_dir):
    """The axis an alternative beats the recommendation on, its intended one first, and the first cost that applies, else the gain."""
    t = tagged_cards(spark, sf_dir).where("tag IS NOT NULL")
    more = C("cobble_m") - C("r.cobble_m")
    say = lambda text, x: F.concat(F.lit(text), x.cast("string"))
    note = (
        F.when((C("sun_min") >= SUN_MIN) & (C("sun_min") >= SUN_RATIO * C("r.sun_min")), say("sun ", C("sun_min")))
        .when(more >= COBBLE_M, F.when(C("r.cobble_m") > 0, say("cobbles +", more)).otherwise(say("cobbles ", C("cobble_m"))))
        .when(C("loud_pct") - C("r.loud_pct") >= LOUD_PP, say("loud ", C("loud_pct")))
        .when(C("wander") & (C("climb_m") - C("r.climb_m") >= CLIMB_M), say("climb ", C("climb_m") - C("r.climb_m")))
        .when(C("tag") == "quieter", say("quiet ", C("quiet_pct"))).when(C("night"), "after sunset").otherwise(say("shade ", C("shade_pct")))
    )
    return t.select("query", "cand", "tag", note.alias("note"))


@query(f"""WITH {_CARDS}, n AS (SELECT query, count(*) AS n, min(delta_min) AS quickest, min_by(CASE WHEN delta_min > 0 THEN tag || ' +' || delta_min END, cand) FILTER (delta_min > 0 AND tag IN ('quieter', 'shadier')) AS gain FROM tagged_cards GROUP BY query)
    SELECT query, n || ' more' || CASE WHEN quickest < 0 THEN ' ' || quickest WHEN gain IS NOT NULL THEN ' ' || gain ELSE '' END AS label FROM n""")
def more_labels(spark, sf_dir):
    """What the folded cards offer: their number with the best saving of time, else with the minutes of the first quieter or shadier one, else alone."""
    t = tagged_cards(spark, sf_dir)
    gains = (C("delta_min") > 0) & C("tag").isin("quieter", "shadier")
    n = t.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("delta_min").alias("quickest"), F.min(F.when(gains, F.struct("cand", F.concat_ws(" +", "tag", C("delta_min").cast("string")).alias("say")))).alias("gain"))
    also = F.when(C("quickest") < 0, C("quickest").cast("string")).otherwise(C("gain.say"))
    return n.select("query", F.concat_ws(" ", F.concat(C("n").cast("string"), F.lit(" more")), also).alias("label"))


@query(f"""WITH {_CARDS} SELECT a.query, a.cand AS shown, c.cand, c.delta_min - a.delta_min AS delta_min FROM cards a JOIN cards c ON c.query = a.query AND c.cand <> a.cand""")
def rebased_cards(spark, sf_dir):
    """The other cards of a query beside each one shown, with their minutes against that one; a query's cards are few."""
    c = cards(spark, sf_dir).select("query", "cand", "delta_min")
    whole = c.groupBy("query").agg(F.collect_list(F.struct("cand", "delta_min")).alias("all"))
    other = F.explode(F.filter("all", lambda o: o["cand"] != C("cand"))).alias("o")
    return c.join(whole, "query").select("query", C("cand").alias("shown"), "delta_min", other).select("query", "shown", C("o.cand").alias("cand"), (C("o.delta_min") - C("delta_min")).alias("delta_min"))


@query("""SELECT part, bit_or(mask)::BIGINT AS modes, count(*) AS n FROM (SELECT l_partkey AS part, 1 << (l_linenumber % 3) AS mask FROM lineitem) GROUP BY part""")
def merged_modes(spark, sf_dir):
    """Mode bits of equal circuits merged by OR."""
    mask = F.pow(F.lit(2), C("l_linenumber") % 3).cast("long")
    return b.table(spark, sf_dir, "lineitem").select(C("l_partkey").alias("part"), mask.alias("mask")).groupBy("part").agg(F.bit_or("mask").alias("modes"), F.count(F.lit(1)).alias("n"))


@query("""SELECT node, 'both' AS side FROM (SELECT u AS node FROM edges WHERE (flags & 4) <> 0 INTERSECT SELECT v FROM edges WHERE (flags & 1) <> 0) UNION ALL SELECT node, 'first' FROM (SELECT u AS node FROM edges WHERE (flags & 4) <> 0 EXCEPT SELECT v FROM edges WHERE (flags & 1) <> 0)
    UNION ALL SELECT node, 'either' FROM (SELECT u AS node FROM edges WHERE (flags & 4) <> 0 UNION SELECT v FROM edges WHERE (flags & 1) <> 0)""")
def node_sets(spark, sf_dir):
    """Union, intersection and difference of node sets."""
    e = b.edges(spark, sf_dir)
    first = e.where(C("flags").bitwiseAND(F.lit(4)) != 0).select(C("u").alias("node"))
    second = e.where(C("flags").bitwiseAND(F.lit(1)) != 0).select(C("v").alias("node"))
    sets = {"both": first.intersect(second), "first": first.distinct().join(second, "node", "left_anti"), "either": first.unionByName(second).distinct()}
    named = [rows.withColumn("side", F.lit(side)) for side, rows in sets.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("""SELECT id, nm, rank FROM (SELECT c_custkey AS id, c_name AS nm, row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_mktsegment = 'MACHINERY') DESC, abs(c_acctbal), c_custkey) AS rank FROM customer) WHERE rank <= 5""")
def ranked_places(spark, sf_dir):
    """Places of a query: those in the city first, then by distance, then as they came; the first five."""
    order = Window.partitionBy("c_nationkey").orderBy(F.desc(C("c_mktsegment") == "MACHINERY"), F.abs("c_acctbal"), "c_custkey")
    return b.table(spark, sf_dir, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("nm"), F.row_number().over(order).cast("long").alias("rank")).where("rank <= 5")


@query("""SELECT trip, list_concat(list_slice(l, k + 1, 8), list_slice(l, 1, k)) AS turned FROM (SELECT trip, (trip % 8)::BIGINT AS k, list(eid ORDER BY seq) AS l FROM steps GROUP BY trip)""")
def rotated_loops(spark, sf_dir):
    """Closed sequences turned to begin at a given place."""
    l = F.transform(F.array_sort(F.collect_list(F.struct("seq", "eid"))), lambda s: s["eid"])
    k = (C("trip") % 8).cast("int")
    loops = b.steps(spark, sf_dir).groupBy("trip").agg(l.alias("l"))
    return loops.select("trip", F.concat(F.slice("l", k + 1, F.lit(8)), F.slice("l", F.lit(1), k)).alias("turned"))


@query()
def planned_ways(spark, sf_dir):
    """A to B with at most two alternatives of other presets that are unlike it."""
    from pacegrid.operators import planner

    return planner.plan_ab(placed(spark, sf_dir), asked(spark, sf_dir), CLOCK)


@query()
def round_walks(spark, sf_dir):
    """Round walks of about 1,500 m, by corners in sectors and legs that avoid what was trodden."""
    from pacegrid.operators import planner

    return planner.plan_loops(placed(spark, sf_dir), asked(spark, sf_dir), CLOCK, 1500.0)
