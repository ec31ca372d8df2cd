"""What a street and the nodes at its ends say about access: ramps, surfaces, kerbs, barriers, widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SMOOTH_RANK = {"excellent": 0, "good": 1, "intermediate": 2, "bad": 3, "very_bad": 4, "horrible": 5, "very_horrible": 6, "impassable": 7}
SURFACE_CLASS = {
    "smooth": ["asphalt", "concrete", "concrete:plates", "paving_stones", "bricks", "tiles", "rubber", "wood", "metal", "paved"],
    "compacted": ["concrete:lanes", "compacted", "fine_gravel"], "sett": ["sett", "cobblestone:flattened"], "cobble": ["cobblestone", "unhewn_cobblestone"],
    "loose": ["gravel", "pebblestone", "woodchips", "unpaved", "metal_grid"], "soft": ["ground", "dirt", "earth", "grass", "grass_paver"],
    "bad": ["sand", "mud", "rock", "snow", "ice", "salt"],
}
SAC_RANK = {"strolling": 0, "hiking": 1, "mountain_hiking": 2, "demanding_mountain_hiking": 3, "alpine_hiking": 4, "demanding_alpine_hiking": 5, "difficult_alpine_hiking": 6}
BLOCK_BARRIERS, GATES = ["turnstile", "full-height_turnstile", "stile", "kissing_gate"], ["gate", "wicket_gate"]
SOFT_BARRIERS = ["cycle_barrier", "chain", "rope", "motorcycle_barrier"]
#: Kerbs in centimetres by what they are called; heights below half a metre are metres.
KERB_CM = {0.0: ["flush", "no", "at_grade", "fully_lowered"], 3.0: ["lowered", "low", "dropped", "sloped", "both"], 12.0: ["raised", "regular", "rolled", "one", "none"], 6.0: ["yes"]}
CURB_KERB = {"flush": ["0", "flush"], "lowered": ["yes", "low"], "raised": ["no"]}
YES, PARTLY = ["yes", "designated"], ["bad", "half", "partial"]
METRES_BELOW, HIGH_CM = 0.5, 3.0


def number(text: Column) -> Column:
    """The number a tag begins with, a decimal comma and metres allowed; null if there is none."""
    plain = F.trim(F.replace(F.replace(F.lower(text), F.lit(","), F.lit(".")), F.lit("m"), F.lit("")))
    return F.regexp_extract(plain, r"^([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))([\s;].*)?$", 1).try_cast("double")


def rank(text: Column, ranks: dict[str, int]) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[text], F.lit(-1))


def named(text: Column, classes: dict, other=None) -> Column:
    """The class that lists a value."""
    out = F.lit(other)
    for name, values in classes.items():
        out = F.when(text.isin(values), F.lit(name)).otherwise(out)
    return out


def kerb_cm(node: dict[str, Column]) -> Column:
    """A node's kerb: its height if given, else by its name, else by the sloped curb's name or number; -1 if unknown."""
    in_cm = lambda x: F.when(x < METRES_BELOW, x * 100).otherwise(x)
    curb = node["sloped_curb"]
    kerb = F.coalesce(node["kerb"], named(curb, CURB_KERB))
    by_number = F.when(node["kerb"].isNull() & curb.isNotNull(), in_cm(number(curb)))
    return F.coalesce(in_cm(number(node["kerb_height"])), F.when(kerb.isNotNull(), F.coalesce(named(kerb, KERB_CM), F.lit(-1.0))), by_number, F.lit(-1.0))


def barrier(node: dict[str, Column]) -> Column:
    """2 if a node blocks, 1 if it slows, 0 if it lets pass; one that is made for wheelchairs lets pass."""
    blocks = node["barrier"].isin(BLOCK_BARRIERS) | (node["barrier"].isin(GATES) & (node["locked"] == "yes"))
    free = node["barrier"].isNull() | F.coalesce(node["wheelchair"].isin(YES), F.lit(False))
    return F.when(free, 0).when(F.coalesce(blocks, F.lit(False)), 2).when(node["barrier"].isin(SOFT_BARRIERS), 1).otherwise(0)


def opening(node: dict[str, Column]) -> Column:
    """How wide a barrier lets pass, in metres; null without a barrier or a number."""
    width = F.coalesce(F.nullif(number(node["maxwidth"]), F.lit(0.0)), number(node["opening"]))
    return F.when(node["barrier"].isNotNull(), width)


def facts(way: dict[str, Column], ends: tuple[dict[str, Column], dict[str, Column]]) -> dict[str, Column]:
    """Facts of a street by name; ``way`` and ``ends`` hold their tags, null where there is none."""
    yes = lambda c: F.coalesce(way[c].isin(YES), F.lit(False))
    only = lambda c: F.coalesce(way[c] == "yes", F.lit(False))
    wheelchair, stroller, bicycle = yes("ramp_wheelchair"), yes("ramp_stroller") | only("flat_steps"), yes("ramp_bicycle")
    said = F.coalesce(F.lower(way["wheelchair"]), F.lit(""))
    grade = F.regexp_extract(way["tracktype"], "^grade([0-9])[0-9]*$", 1).try_cast("int")
    worst = F.greatest(*map(barrier, ends))
    own = F.coalesce(F.nullif(number(way["width"]), F.lit(0.0)), number(way["est_width"]))
    high = [F.when(way["crossing"] & end["public_transport"].isNull(), kerb_cm(end)) for end in ends]
    return {
        "steps": F.coalesce(way["highway"] == "steps", F.lit(False)),
        "ramp": F.when(wheelchair, "wheelchair").when(stroller, "stroller").when(only("ramp") & ~bicycle, "untyped").when(bicycle, "bicycle").otherwise("none"),
        "conveying": F.coalesce((way["conveying"] != "no") & (way["conveying"] != ""), F.lit(False)),
        "wc": F.when(said.isin(PARTLY), "limited").otherwise(said), "stroller": F.coalesce(F.lower(way["stroller"]), F.lit("")),
        "smooth": rank(way["smoothness"], SMOOTH_RANK), "surface": named(way["surface"], SURFACE_CLASS, "unknown"), "sac": rank(way["sac_scale"], SAC_RANK),
        "trail": F.coalesce(way["trail_visibility"], F.lit("")), "obstacle": way["obstacle"].isNotNull(), "tracktype": F.coalesce(grade, F.lit(-1)),
        "kerb_cm": F.greatest(F.lit(-1.0), *[F.coalesce(x, F.lit(-1.0)) for x in high]), "barrier": F.when(worst == 2, "block").when(worst == 1, "soft").otherwise("none"),
        "narrow_m": F.coalesce(F.least(*map(opening, ends), own), F.lit(-1.0)),
    }


def signals(f: dict[str, Column]) -> Column:
    """Whether a street says anything that a wheel cares about."""
    return f["steps"] | (f["ramp"] != "none") | (f["wc"] != "") | (f["stroller"] != "") | (f["kerb_cm"] > HIGH_CM) | (f["barrier"] != "none")
