"""Road tags, tiers, penalties, speeds and colours as Column expressions."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Classes, thresholds and factors that results depend on.
DRIVABLE = "motorway motorway_link trunk trunk_link primary primary_link secondary secondary_link tertiary tertiary_link unclassified residential service living_street".split()
NO_SURFACE = ["unpaved", "gravel", "dirt", "mud", "sand"]
SOFT_SURFACE = ["compacted", "fine_gravel"]
NO_ACCESS = ["private", "no"]
NO_HIGHWAY = ["track", "path", "footway", "cycleway", "bridleway", "steps"]
TIERS = [(30.0, 4, 2.0), (60.0, 3, 1.6), (100.0, 2, 1.3), (175.0, 1, 1.0)]
HIGHWAY_FACTOR = {"motorway": 0.3, "motorway_link": 0.3, "trunk": 0.5, "trunk_link": 0.5, "primary": 0.8, "primary_link": 0.8, "secondary": 0.9, "secondary_link": 0.9, "residential": 0.5, "service": 0.3}
KMH_TO_MPH = 0.621371
MIN_LENGTH_M = 1609.0
MIN_CURVATURE, MAX_CURVATURE = 0.0, 8000.0
TIER_COLOURS = ["F000E010", "F000FFFF", "F000AAFF", "F00055FF", "F00000FF"]


def fingerprint() -> str:
    """SHA-256 of what scores depend on: tiers, their weights and radii. Penalties and the wobble filter come later and don't count."""
    return hashlib.sha256(json.dumps({"tiers": TIERS, "straight_weight": 0.0}, sort_keys=True).encode()).hexdigest()


def _in(column: Column, values: list[str]) -> Column:
    return F.coalesce(column.isin(values), F.lit(False))


def drivable(highway: Column) -> Column:
    return highway.isin(DRIVABLE)


def rejected(surface: Column, access: Column, motor_vehicle: Column, highway: Column) -> Column:
    """True where a way is dropped; missing tags never drop one."""
    return _in(surface, NO_SURFACE) | _in(access, NO_ACCESS) | _in(motor_vehicle, NO_ACCESS) | _in(highway, NO_HIGHWAY)


def tier(radius: Column) -> Column:
    out = F.when(radius < TIERS[0][0], F.lit(TIERS[0][1]))
    for limit, t, _ in TIERS[1:]:
        out = out.when(radius < limit, F.lit(t))
    return out.otherwise(F.lit(0))


def weight(radius: Column) -> Column:
    out = F.when(radius < TIERS[0][0], F.lit(TIERS[0][2]))
    for limit, _, w in TIERS[1:]:
        out = out.when(radius < limit, F.lit(w))
    return out.otherwise(F.lit(0.0))


def class_factor(highways: Column) -> Column:
    """The least factor of a road's classes; 1 for classes without one."""
    table = F.create_map(*[F.lit(x) for kv in HIGHWAY_FACTOR.items() for x in kv])
    return F.coalesce(F.least(F.array_min(F.transform(highways, lambda h: F.coalesce(table[h], F.lit(1.0)))), F.lit(1.0)), F.lit(1.0))


def speed_mph(maxspeed: Column) -> Column:
    """Miles an hour of a maxspeed tag; null for lists, words and what isn't positive. A bare number is in miles."""
    text = F.trim(maxspeed)
    number = F.regexp_extract(text, r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)( km/h| mph)?$", 1).try_cast("double")
    mph = F.when(text.endswith(" km/h"), number * KMH_TO_MPH).otherwise(number)
    return F.when(number > 0, mph)


def passing_fraction(speeds: Column, total_length: Column, min_mph: float) -> Column:
    """Share of the tagged length with at least this speed; 1 where nothing is tagged, 0 without length. speeds: (speed_mph, length_m)."""
    tagged = F.aggregate(speeds, F.lit(0.0), lambda s, x: s + F.when(x.speed_mph.isNotNull(), x.length_m).otherwise(0.0))
    passing = F.aggregate(speeds, F.lit(0.0), lambda s, x: s + F.when(x.speed_mph >= min_mph, x.length_m).otherwise(0.0))
    return F.when(total_length <= 0, F.lit(0.0)).when(tagged <= 0, F.lit(1.0)).otherwise(passing / tagged)


def mean_speed(speeds: Column) -> Column:
    """Length-weighted mean over tagged ways; null where none is."""
    tagged = F.filter(speeds, lambda x: x.speed_mph.isNotNull())
    total = F.aggregate(tagged, F.lit(0.0), lambda s, x: s + x.length_m)
    return F.when(total > 0, F.aggregate(tagged, F.lit(0.0), lambda s, x: s + x.speed_mph * x.length_m) / total)


def disqualifying(access: Column, highway: Column, motor_vehicle: Column) -> Column:
    return _in(access, NO_ACCESS) | _in(highway, NO_HIGHWAY) | _in(motor_vehicle, NO_ACCESS)


def surface_penalty(surface: Column, highway: Column) -> Column:
    quarter = (_in(highway, ["unclassified"]) & (F.coalesce(surface, F.lit("")) == "")) | _in(highway, ["service"])
    return F.when(_in(surface, NO_SURFACE), 1.0).when(_in(surface, SOFT_SURFACE), 0.5).when(quarter, 0.25).otherwise(0.0)


def through_penalty(highway: Column) -> Column:
    kinds = [(["motorway", "motorway_link"], 1.0), (["trunk", "trunk_link"], 0.8), (["primary", "primary_link"], 0.4)]
    return F.coalesce(*[F.when(_in(highway, k), F.lit(v)) for k, v in kinds], F.lit(0.0))


def local_bonus(highway: Column) -> Column:
    return F.when(_in(highway, ["residential", "living_street"]), 1.0).when(_in(highway, ["tertiary", "tertiary_link"]), 0.5).otherwise(0.0)


def colour_level(score: Column, low: float = MIN_CURVATURE, high: float = MAX_CURVATURE) -> Column:
    share = F.least((score - low) / (high - low), F.lit(1.0))
    return F.when(score < low, 0).otherwise(F.round(510 * (1 - F.pow(F.lit(10.0), -0.75 * share))).cast("int") + 1)


def colour_kml(level: Column) -> Column:
    """AABBGGRR: green at 0, then yellow to red to magenta."""
    two = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    red = F.concat(F.lit("FF00"), two(F.lit(256) - level), F.lit("FF"))
    blue = F.concat(F.lit("FF"), two(F.floor((level - 257) * 255 / 254)), F.lit("00FF"))
    return F.when(level <= 0, F.lit(TIER_COLOURS[0])).when(level <= 256, red).otherwise(blue)


def colour_css(level: Column) -> Column:
    kml = colour_kml(level)
    return F.concat(F.lit("#"), F.lower(F.concat(F.substring(kml, 7, 2), F.substring(kml, 5, 2), F.substring(kml, 3, 2))))


def duration_text(seconds: Column) -> Column:
    minutes = F.floor(F.floor(seconds) / 60)
    return F.when(minutes >= 60, F.format_string("%dh%dm", F.floor(minutes / 60), minutes % 60)).otherwise(F.format_string("%dm", minutes))


def loop_radius_km(hours: Column, mph: Column) -> Column:
    return mph * 1.60934 * hours / (2 * 3.141592653589793)
