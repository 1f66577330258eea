"""Scoring of the segments between consecutive nodes; a projection over each way's own array, without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.functions import geo, tags

SEGMENT = "array<struct<seg_idx:int,start:struct<lat:double,lon:double>,end:struct<lat:double,lon:double>,radius:double,tier:int,weight:double,length:double,score:double>>"


def score_ways(ways: DataFrame) -> DataFrame:
    """``ways`` with segments: tier and weight by the least radius of the triangles that a segment is in."""
    g, n = F.col("geometry"), F.size("geometry")
    at = lambda i: F.get(g, i)
    none = F.array().cast("array<double>")
    # each distance is worked out once, then read from its array
    sides = F.when(n >= 2, F.transform(F.sequence(F.lit(0), n - 2), lambda i: geo.haversine(at(i), at(i + 1)))).otherwise(none)
    chords = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: geo.haversine(at(i), at(i + 2)))).otherwise(none)
    with_sides = ways.withColumns({"_sides": sides, "_chords": chords})
    side = lambda i: F.get(F.col("_sides"), i)
    radii = F.transform("_chords", lambda c, i: geo.radius_of_sides(side(i + 1), c, side(i)))
    with_radii = with_sides.withColumn("_radii", radii)
    near = lambda i: F.coalesce(F.get(F.col("_radii"), i), F.lit(geo.INF))
    bare = F.transform("_sides", lambda m, i: F.struct(i.alias("seg_idx"), at(i).alias("start"), at(i + 1).alias("end"), F.least(near(i - 1), near(i)).alias("radius"), m.alias("length")))
    with_bare = with_radii.withColumn("_bare", bare)
    scored = F.transform(
        "_bare",
        lambda s: F.struct(s.seg_idx, s.start, s.end, s.radius, tags.tier(s.radius).alias("tier"), tags.weight(s.radius).alias("weight"), s.length, (s.length * tags.weight(s.radius)).alias("score")),
    )
    return with_bare.withColumn("segments", scored).drop("_sides", "_chords", "_radii", "_bare")


def exploded(scored: DataFrame, *keep: str) -> DataFrame:
    """One row for each segment, with the way's columns ``keep``."""
    # inline, not explode: fields that are picked from an exploded struct would each work out the array again; outer, as
    # the optimizer else filters by the array's size first, and works it out once more for that
    return scored.select("way_id", *keep, F.inline_outer("segments")).where("seg_idx IS NOT NULL")


def steps(ways: DataFrame) -> DataFrame:
    """(way_id, seg_idx, start, end): the segments as :func:`exploded` gives them, where nobody asks for their scores."""
    g = F.col("geometry")
    pairs = F.when(F.size(g) >= 2, F.transform(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), lambda p, i: F.struct(i.alias("seg_idx"), p.alias("start"), F.get(g, i + 1).alias("end"))))
    return ways.select("way_id", F.inline_outer(pairs)).where("seg_idx IS NOT NULL")


def way_ends(ways: DataFrame) -> DataFrame:
    """``ways`` with first, last (points), the bearings entry and exit, and those of the way run backwards, back_entry and back_exit; null
    where a way has no segment. Read from the geometry, so that no filter on them works out the segments."""
    g = F.col("geometry")
    some = F.size(g) >= 2
    p, q, r, s = F.get(g, F.lit(0)), F.get(g, F.lit(1)), F.try_element_at(g, F.lit(-2)), F.try_element_at(g, F.lit(-1))
    values = {"first": p, "last": s, "entry": geo.bearing(p, q), "exit": geo.bearing(r, s), "back_entry": geo.bearing(s, r), "back_exit": geo.bearing(q, p)}
    return ways.withColumns({k: F.when(some, v) for k, v in values.items()})


def way_totals(scored: DataFrame, *keep: str) -> DataFrame:
    total = lambda f: F.aggregate("segments", F.lit(0.0), lambda s, x: s + x[f])
    return scored.select("way_id", *keep, F.size("segments").cast("long").alias("n_segments"), total("score").alias("score"), total("length").alias("length"))


def counts(ways: DataFrame) -> DataFrame:
    """One row: input ways, kept ways and their segments, in one pass."""
    kept = ~tags.rejected(F.col("surface"), F.col("access"), F.col("motor_vehicle"), F.col("highway"))
    n = F.greatest(F.size("geometry") - 1, F.lit(0)).cast("long")
    return ways.agg(F.count("*").alias("input_ways"), F.count_if(kept).alias("kept_ways"), F.sum(F.when(kept, n).otherwise(F.lit(0).cast("long"))).alias("segments"))
