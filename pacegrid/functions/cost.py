"""Prices of edges: surface, noise, shade at arrival, crossings, access modes, turns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pacegrid.sources.bindings import BUCKETS, SPEED, START_MIN, STEP_MIN

# --- fixed values -----------------------------------------------------------
#: Cost of a surface tag, 0 (smooth) to 1.
SURFACE_BASE = {
    "asphalt": 0.05, "paved": 0.05, "concrete": 0.10, "chipseal": 0.10, "concrete:plates": 0.20, "concrete:lanes": 0.25,
    "metal": 0.30, "wood": 0.30, "paving_stones": 0.15, "compacted": 0.05, "fine_gravel": 0.05, "gravel": 0.25,
    "pebblestone": 0.70, "unpaved": 0.30, "ground": 0.30, "dirt": 0.35, "earth": 0.35, "grass": 0.70, "grass_paver": 0.60,
    "sand": 0.90, "mud": 0.90, "woodchips": 0.70, "cobblestone:flattened": 0.70, "sett": 0.75, "cobblestone": 0.95,
    "unhewn_cobblestone": 1.00, "paving_stones:30": 0.60,
}
#: Cost where no known surface is tagged, by highway class, and for any other class.
HIGHWAY_DEFAULT = {
    "footway": 0.10, "pedestrian": 0.10, "living_street": 0.10, "residential": 0.10, "cycleway": 0.05, "tertiary": 0.10,
    "secondary": 0.10, "primary": 0.10, "unclassified": 0.15, "service": 0.15, "track": 0.50, "path": 0.40, "bridleway": 0.50,
}
FALLBACK = 0.20
EARTH = ["unpaved", "ground", "dirt", "earth"]
EARTH_BY_CLASS = {"track": -0.05, "path": 0.05}
SMOOTHNESS_ADD = {
    "excellent": -0.05, "good": -0.02, "intermediate": 0.05, "bad": 0.25, "very_bad": 0.50, "horrible": 0.80,
    "very_horrible": 1.00, "impassable": 1.00,
}
INFORMAL_ADD = 0.30
#: Weights of the presets: shade, noise, surface, green.
PRESETS = {"balanced": (1.5, 1.5, 2.0, 0.6), "maxShade": (3.5, 0.8, 2.0, 0.4), "maxQuiet": (0.0, 3.0, 2.0, 0.6), "fastest": (0.0, 0.0, 2.0, 0.0)}
#: A round walk counts green for more, up to a limit.
LOOP_GREEN, MOST_GREEN = 1.25, 0.9
CARRIAGEWAY, MAJOR_CARRIAGEWAY, CYCLEWAY = 12, 20, 15
CROSSING_M, CROSSING_LEN_M, INFERRED_CAP = 150, 15, 22.5
JAYWALK_FACTOR, CYCLE_CROSSING_FACTOR, MARKED_FACTOR = 15, 4, 0.6
STEPS_STROLLER_M, KERB_STROLLER_M = 400, 75
COBBLE_Q = 178
PARK_SHARE = 0.78
NOISE_LETTERS = ["A", "B", "C", "D", "E"]
DB_BASE, DB_STEP, MAX_BAND = 35, 5, 8


def preset(name: str) -> tuple[float, float, float, float]:
    """The weights (shade, noise, surface, green) of a preset, or of ``preset+loop``: the same for round walks."""
    base, _, loop = name.partition("+")
    shade, noise, surface, green = PRESETS[base]
    return shade, noise, surface, min(MOST_GREEN, green * LOOP_GREEN) if loop else green


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def js_round(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def bit(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(F.lit(mask).cast("long")) != 0


def lookup(key: Column, values: dict[str, float]) -> Column:
    """The value of a key, null for keys that aren't there and for null."""
    pairs = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.try_element_at(pairs, F.coalesce(key, F.lit("")))


def surface_cost(surface: Column, smoothness: Column, highway: Column, informal: Column) -> Column:
    """0 to 1; an unknown or missing surface falls back to the class, then to FALLBACK."""
    base = lookup(surface, SURFACE_BASE)
    earth = F.when(surface.isin(EARTH), F.coalesce(lookup(highway, EARTH_BY_CLASS), F.lit(0.0))).otherwise(0.0)
    start = F.when(base.isNotNull(), base + earth).otherwise(F.coalesce(lookup(highway, HIGHWAY_DEFAULT), F.lit(FALLBACK)))
    extra = F.coalesce(lookup(smoothness, SMOOTHNESS_ADD), F.lit(0.0)) + F.when(informal, INFORMAL_ADD).otherwise(0.0)
    return clamp(start + extra, 0.0, 1.0)


def noise_band(db: Column) -> Column:
    """dB to a band 0..8; 0 is unmapped and stays 0."""
    return F.when(db > 0, clamp((db - DB_BASE) / DB_STEP, 0.0, float(MAX_BAND))).otherwise(0.0)


def class_to_db(cls: Column, offset: int = 1) -> Column:
    return DB_BASE + DB_STEP * (cls + offset)


def noise_letter(mean: Column) -> Column:
    """Mean class to a letter, by the half-even rounding of the mean."""
    index = F.when(mean < 0.5, 0).otherwise(F.least(F.lit(4), F.floor((F.rint(mean) + 1) / 2).cast("int")))
    return F.element_at(F.array(*[F.lit(c) for c in NOISE_LETTERS]), index.cast("int") + 1)


def noise_curve(noise: Column) -> Column:
    """Free up to the knee, then quadratic."""
    x = (noise - 0.5) / 0.5
    return F.when(noise <= 0.5, 0.0).otherwise(x * x)


def quietness(noise_q: Column) -> Column:
    return clamp((7 - noise_q / 255 * 8) / 4, 0.0, 1.0)


def min_rate(w_green: Column) -> Column:
    return F.greatest(F.lit(0.05), 1 - w_green)


def bucket_of(minute: Column) -> Column:
    return F.least(F.greatest(F.floor((minute - START_MIN) / STEP_MIN), F.lit(0)), F.lit(BUCKETS - 1))


def shade_at(byte, minute: Column, sunrise: Column | None = None, sunset: Column | None = None) -> Column:
    """Shade share at a minute; ``byte(bucket)`` gives the bucket's value or null where it isn't loaded.

    Outside the window: 1 in the dark (or if the day's light is unknown), else the edge bucket.
    """
    last = START_MIN + STEP_MIN * (BUCKETS - 1)
    outside = (minute < START_MIN) | (minute > last)
    dark = F.lit(True) if sunrise is None else (minute < sunrise) | (minute > sunset)
    m = F.least(F.greatest(minute, F.lit(START_MIN)), F.lit(last))
    b = (m - START_MIN) / STEP_MIN
    b0 = F.least(F.greatest(F.floor(b), F.lit(0)), F.lit(BUCKETS - 1))
    b1 = F.least(b0 + 1, F.lit(BUCKETS - 1))
    f = b - b0
    return F.when(outside & dark, 1.0).otherwise((byte(b0) * (1 - f) + byte(b1) * f) / 255)


def priced(shade: Column, what: str = "shade band isn't loaded") -> Column:
    """The share itself; a missing band is an error, never a value."""
    return F.when(shade.isNull(), F.raise_error(F.lit(what)).cast("double")).otherwise(shade)


def edge_cost(e: dict[str, Column], shade: Column, weights: dict[str, Column], access: str = "stroller", extra: Column | None = None) -> Column:
    """Metres-equivalent of an edge; null where the access mode excludes it.

    ``e`` has len_dm, noise_q, surface_q, green_q, flags, acc and slope.
    """
    flags, acc = e["flags"], e["acc"]
    length = e["len_dm"] / 10
    crossing, street, cycle = bit(flags, 4), bit(flags, 1), bit(flags, 64)
    carriageway = F.when(bit(flags, 2) & ~crossing, F.when(bit(flags, 32), MAJOR_CARRIAGEWAY).otherwise(CARRIAGEWAY)).otherwise(0)
    rate = (
        1 - weights["green"] * e["green_q"] / 255 + weights["shade"] * (1 - shade)
        + weights["noise"] * noise_curve(e["noise_q"] / 255) + weights["surface"] * e["surface_q"] / 255 + carriageway
    )
    if extra is not None:
        rate = rate + extra
    rate = rate + F.when(cycle & ~crossing, CYCLEWAY).otherwise(0)
    inferred = crossing & street & ~cycle & ~bit(flags, 8)
    across = F.when(inferred, F.least(length, F.lit(INFERRED_CAP))).otherwise(length)
    factor = F.when(cycle, F.when(street, float(JAYWALK_FACTOR)).otherwise(float(CYCLE_CROSSING_FACTOR))).when(bit(flags, 8), MARKED_FACTOR).otherwise(1.0)
    base = length * rate + F.when(crossing, CROSSING_M * across / CROSSING_LEN_M * factor).otherwise(0.0)
    times, fixed, excluded = access_terms(acc, e["slope"], e["surface_q"], access)
    return F.when(~excluded, base * times + fixed)


def access_terms(acc: Column, slope: Column, surface_q: Column, access: str) -> tuple[Column, Column, Column]:
    """Multiplier, fixed metres, and whether the mode excludes the edge."""
    steep = F.abs(slope) / 2
    one, none = F.lit(1.0), F.lit(0.0)

    def times(*parts: tuple[Column, float]) -> Column:
        out = one
        for when, by in parts:
            out = out * F.when(when, by).otherwise(1.0)
        return out

    if access == "wheelchair":
        out = (bit(acc, 1) & ~bit(acc, 4)) | bit(acc, 8 | 16 | 64 | 128) | (steep > 8)
        climb = F.when(steep > 6, 3.0).when(steep > 3, F.when(slope > 0, 1.5).otherwise(1.2)).otherwise(1.0)
        return times((bit(acc, 4), 1.5), (bit(acc, 32), 3.0), (surface_q >= 150, 2.5)) * climb, none, out
    if access == "stroller":
        bare = bit(acc, 1) & ~bit(acc, 4) & ~bit(acc, 2)
        climb = F.when(steep > 12, 4.0).when(steep > 8, 2.5).when(steep > 6, 1.5).otherwise(1.0)
        by = times((steep > 20, 6.0), (bit(acc, 1) & ~bit(acc, 4) & bit(acc, 2), 1.5), (bare, 3.0), (bit(acc, 16), 2.0), (bit(acc, 32), 1.2), (bit(acc, 128), 2.5))
        return by * climb, F.when(bare, float(STEPS_STROLLER_M)).otherwise(0.0) + F.when(bit(acc, 8), float(KERB_STROLLER_M)).otherwise(0.0), bit(acc, 64)
    return times((bit(acc, 1), 3.0), (bit(acc, 64), 2.0)), none, F.lit(False)


def in_park(green_q: Column, flags: Column) -> Column:
    """Green and off the roadway; bit 3 of a crossing means marked, not sidewalk."""
    return (green_q >= PARK_SHARE * 255) & ~bit(flags, 1) & ~bit(flags, 16) & ~(bit(flags, 8) & ~bit(flags, 4))


def flags_byte(**bits: Column) -> Column:
    """Street, mapped, crossing, evidence, strong, major, cycle, centred as bits 0 to 7."""
    order = ["street", "mapped", "crossing", "evidence", "strong", "major", "cycle", "centred"]
    out = F.lit(0)
    for place, name in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.coalesce(bits[name], F.lit(False)).cast("int"), place))
    return out


def auto_preference(minute: Column, sunset: Column) -> Column:
    """Struct of preference, daypart and whether shade has no meaning any more."""
    part = F.when(minute < 660, "morning").when(minute < 1080, "afternoon").otherwise("evening")
    pref = F.when(minute >= sunset, "balanced").when((minute >= 660) & (minute < 960), "shade").when(minute >= 1080, "quiet").otherwise("balanced")
    return F.struct(pref.alias("pref"), part.alias("daypart"), (minute >= sunset).alias("night"))


def screened_slope(steepest: Column, mean: Column, lifted: Column) -> Column:
    """0 on bridges and in tunnels; the mean where the steepest stretch is a measuring error."""
    return F.when(lifted, 0.0).when((F.abs(steepest) > 25) & (F.abs(mean) < 12), mean).otherwise(steepest)


def arrival(depart: Column, metres_before: Column) -> Column:
    return depart + metres_before / SPEED
