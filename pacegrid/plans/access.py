"""Queries on access: facts of streets and of the nodes at their ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from pacegrid.functions import access
from pacegrid.registry import query
from pacegrid.sources import bindings as b

C = F.col
#: Tag values that streets and nodes take in turn, by a factor of their numbers; an empty one is no tag.
WAY_TAGS = {
    "highway": (3, ["footway", "steps", "path", "track", "residential"]), "ramp": (5, ["", "yes", "no", "", ""]), "ramp_wheelchair": (7, ["", "", "", "yes", "no", "", "designated", "", ""]), "ramp_stroller": (11, ["", "", "yes", "", "no", "", ""]),
    "flat_steps": (13, ["", "", "", "yes", "", "no"]), "ramp_bicycle": (17, ["", "yes", "", "", "no"]), "conveying": (19, ["", "forward", "no", "", "", ""]), "wheelchair": (23, ["", "Yes", "no", "half", "limited", "BAD", "", ""]),
    "stroller": (29, ["", "yes", "Limited", "", ""]), "smoothness": (31, ["", "good", "bad", "horrible", "odd", "excellent", "impassable"]), "surface": (37, ["asphalt", "", "sett", "ground", "sand", "gravel", "fine_gravel", "unhewn_cobblestone", "unheard_of"]),
    "sac_scale": (41, ["", "", "hiking", "alpine_hiking", "t7"]), "trail_visibility": (43, ["", "good", "no", ""]), "obstacle": (47, ["", "", "yes", ""]), "tracktype": (53, ["", "grade1", "grade5", "grade", "gradex"]),
    "width": (59, ["", "1.2", "0", "2,5 m", "wide", "3 m;2", "1.5m"]), "est_width": (61, ["", "4", ".9 m"]),
}
NODE_TAGS = {
    "barrier": (3, ["", "bollard", "gate", "turnstile", "chain", "stile", "wicket_gate", ""]), "wheelchair": (5, ["", "", "yes", "no", "designated"]), "locked": (7, ["", "yes", "no"]), "maxwidth": (11, ["", "0.8", "0", "1,1 m", "?"]),
    "opening": (13, ["", "0.7", ""]), "kerb": (17, ["", "flush", "lowered", "raised", "yes", "odd", ""]), "kerb_height": (19, ["", "", "", "0.03", "12", "4 cm", ""]), "sloped_curb": (23, ["", "0", "yes", "no", "0.02", "5", "steep"]),
    "public_transport": (29, ["", "", "", "platform"]),
}


def tag(values, of):
    factor, options = values
    return F.nullif(F.element_at(F.array(*map(F.lit, options)), (F.floor(of * factor / 7) % len(options) + 1).cast("int")), F.lit(""))


def _tag_sql(name: str, values, of: str) -> str:
    factor, options = values
    return f"nullif([{', '.join(repr(o) for o in options)}][({of} * {factor} // 7 % {len(options)} + 1)::INT], '') AS {name}"


_TAGGED = "w AS (SELECT eid, u, v, (flags & 4) <> 0 AS crossing, " + ", ".join(_tag_sql(n, v, "eid") for n, v in WAY_TAGS.items()) + " FROM edges), n AS (SELECT node, " + ", ".join(_tag_sql(n, v, "node") for n, v in NODE_TAGS.items()) + " FROM nodes)"
_NUM = "TRY_CAST(nullif(regexp_extract(trim(replace(replace(lower({0}), ',', '.'), 'm', '')), '^([+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+))([\\s;].*)?$', 1), '') AS DOUBLE)"
_CM = "CASE WHEN {0} < 0.5 THEN {0} * 100 ELSE {0} END"
_ENDS = f"""k AS (SELECT node, public_transport, CASE WHEN barrier IS NULL OR coalesce(wheelchair IN ('yes', 'designated'), false) THEN 0 WHEN barrier IN ('turnstile', 'full-height_turnstile', 'stile', 'kissing_gate') OR (barrier IN ('gate', 'wicket_gate') AND coalesce(locked, '') = 'yes') THEN 2
      WHEN barrier IN ('cycle_barrier', 'chain', 'rope', 'motorcycle_barrier') THEN 1 ELSE 0 END AS bar, CASE WHEN barrier IS NOT NULL THEN coalesce(nullif({_NUM.format('maxwidth')}, 0), {_NUM.format('opening')}) END AS open_m,
      {_NUM.format('kerb_height')} AS h, {_NUM.format('sloped_curb')} AS s, sloped_curb, kerb, coalesce(kerb, CASE WHEN sloped_curb IN ('0', 'flush') THEN 'flush' WHEN sloped_curb IN ('yes', 'low') THEN 'lowered' WHEN sloped_curb = 'no' THEN 'raised' END) AS kk FROM n),
    e AS (SELECT node, public_transport, bar, open_m, CASE WHEN h IS NOT NULL THEN {_CM.format('h')} WHEN kk IN ('flush', 'no', 'at_grade', 'fully_lowered') THEN 0 WHEN kk IN ('lowered', 'low', 'dropped', 'sloped', 'both') THEN 3 WHEN kk IN ('raised', 'regular', 'rolled', 'one', 'none') THEN 12
      WHEN kk = 'yes' THEN 6 WHEN kk IS NOT NULL THEN -1 WHEN s IS NOT NULL THEN {_CM.format('s')} ELSE -1 END::DOUBLE AS kerb_cm FROM k)"""


@query(f"""WITH {_TAGGED}, {_ENDS}, r AS (SELECT w.*, greatest(a.bar, z.bar) AS bar, a.open_m AS a_open, z.open_m AS z_open, CASE WHEN crossing AND a.public_transport IS NULL THEN a.kerb_cm END AS a_kerb, CASE WHEN crossing AND z.public_transport IS NULL THEN z.kerb_cm END AS z_kerb,
      coalesce(ramp_wheelchair IN ('yes', 'designated'), false) AS rw, coalesce(ramp_stroller IN ('yes', 'designated'), false) OR coalesce(flat_steps = 'yes', false) AS rs, coalesce(ramp_bicycle IN ('yes', 'designated'), false) AS rb, coalesce(lower(w.wheelchair), '') AS said FROM w JOIN e a ON a.node = u JOIN e z ON z.node = v),
    f AS (SELECT eid, coalesce(highway = 'steps', false) AS steps, CASE WHEN rw THEN 'wheelchair' WHEN rs THEN 'stroller' WHEN ramp = 'yes' AND NOT rb THEN 'untyped' WHEN rb THEN 'bicycle' ELSE 'none' END AS ramp, coalesce(conveying <> 'no', false) AS conveying, CASE WHEN said IN ('bad', 'half', 'partial') THEN 'limited' ELSE said END AS wc, coalesce(lower(stroller), '') AS stroller,
      CASE smoothness WHEN 'excellent' THEN 0 WHEN 'good' THEN 1 WHEN 'bad' THEN 3 WHEN 'horrible' THEN 5 WHEN 'impassable' THEN 7 ELSE -1 END AS smooth, CASE surface WHEN 'asphalt' THEN 'smooth' WHEN 'sett' THEN 'sett' WHEN 'ground' THEN 'soft' WHEN 'sand' THEN 'bad' WHEN 'gravel' THEN 'loose' WHEN 'fine_gravel' THEN 'compacted' WHEN 'unhewn_cobblestone' THEN 'cobble' ELSE 'unknown' END AS surface,
      CASE sac_scale WHEN 'hiking' THEN 1 WHEN 'alpine_hiking' THEN 4 ELSE -1 END AS sac, coalesce(trail_visibility, '') AS trail, obstacle IS NOT NULL AS obstacle, CASE tracktype WHEN 'grade1' THEN 1 WHEN 'grade5' THEN 5 ELSE -1 END AS tracktype, greatest(-1, coalesce(a_kerb, -1), coalesce(z_kerb, -1))::DOUBLE AS kerb_cm,
      CASE bar WHEN 2 THEN 'block' WHEN 1 THEN 'soft' ELSE 'none' END AS barrier, coalesce(least(a_open, z_open, coalesce(nullif({_NUM.format('width')}, 0), {_NUM.format('est_width')})), -1)::DOUBLE AS narrow_m FROM r)
    SELECT *, steps OR ramp <> 'none' OR wc <> '' OR stroller <> '' OR kerb_cm > 3 OR barrier <> 'none' AS signals FROM f""")
def accessibility_facts(spark, sf_dir):
    """What a street and its end nodes say about access: steps, the ramp of most use, ranks, kerbs of crossings, the worse barrier of both ends and the narrowest place."""
    ways = b.edges(spark, sf_dir).select("eid", "u", "v", (C("flags").bitwiseAND(F.lit(4)) != 0).alias("crossing"), *[tag(v, C("eid")).alias(n) for n, v in WAY_TAGS.items()])
    nodes = b.nodes(spark, sf_dir).select("node", *[tag(v, C("node")).alias(n) for n, v in NODE_TAGS.items()])
    end = lambda key, name: nodes.select(C("node").alias(key), F.struct(*NODE_TAGS).alias(name))
    held = ways.join(end("u", "a"), "u").join(end("v", "z"), "v")
    found = access.facts({n: C(n) for n in (*WAY_TAGS, "crossing")}, tuple({n: C(f"{side}.{n}") for n in NODE_TAGS} for side in "az"))
    return held.select("eid", *[c.alias(n) for n, c in found.items()]).withColumn("signals", access.signals({n: C(n) for n in found}))
