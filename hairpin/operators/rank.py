"""Reports over segments and roads: tiers, runs, viewports, stages and record search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hairpin.functions import geo, tags
from hairpin.plans.lineage import discard, store


def tier_histogram(rows: DataFrame, *keys: str) -> DataFrame:
    """Per key the count, score and length of each tier."""
    out = []
    for t in range(5):
        hit = F.col("tier") == t
        out += [F.count_if(hit).alias(f"n_{t}"), F.sum(F.when(hit, F.col("score")).otherwise(0.0)).alias(f"score_{t}"), F.sum(F.when(hit, F.col("length")).otherwise(0.0)).alias(f"length_{t}")]
    return rows.groupBy(*keys).agg(*out)


def tier_runs(rows: DataFrame, *keys: str, order: str = "idx") -> DataFrame:
    """Consecutive rows of one tier united: (keys, run, tier, n, length, points), run 0-based."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = rows.withColumn("_new", F.coalesce((F.lag("tier").over(w) != F.col("tier")), F.lit(True)).cast("int")).withColumn("run", F.sum("_new").over(w) - 1)
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "start", "end")))
    runs = marked.groupBy(*keys, "run").agg(F.first("tier").alias("tier"), F.count("*").alias("n"), F.sum("length").alias("length"), steps.alias("_s"))
    return runs.withColumn("points", F.concat(F.array(F.get("_s", F.lit(0)).start), F.transform("_s", lambda x: x.end))).drop("_s")


def viewport_score(segments: DataFrame, wanted: Column | None = None) -> DataFrame:
    """One row: score, length and score per km; each segment once, however many tiles have it."""
    rows = segments if wanted is None else segments.where(wanted)
    sums = rows.dropDuplicates(["way_id", "seg_idx"]).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"), F.coalesce(F.sum("length"), F.lit(0.0)).alias("length"))
    return sums.withColumn("per_km", F.when(F.col("length") > 0, F.col("score") / (F.col("length") / 1000)).otherwise(0.0))


def overlay(roads: DataFrame, min_score: float, min_mph: float = 0.0) -> DataFrame:
    """Roads of a map overlay: a road without a known speed fails any speed that is asked for."""
    out = roads.where(F.col("total_score") >= min_score)
    return out.where(F.coalesce(tags.mean_speed(F.col("way_speeds")) >= min_mph, F.lit(False))) if min_mph > 0 else out


def road_boxes(roads: DataFrame) -> DataFrame:
    """Per road its box, ends and ways; of a table with segments, or of one with sums."""
    if "segments" not in roads.columns:
        return roads.where("n_segments > 0").select("group_key", "sub_index", "way_ids", "south", "west", "north", "east", "first", "last")
    p = F.concat(F.transform("segments", lambda s: s.start), F.transform("segments", lambda s: s.end))
    bound = lambda f, c: f(F.transform(p, lambda x: x[c]))
    return roads.where(F.size("segments") > 0).select(
        "group_key", "sub_index", "way_ids", bound(F.array_min, "lat").alias("south"), bound(F.array_min, "lon").alias("west"), bound(F.array_max, "lat").alias("north"), bound(F.array_max, "lon").alias("east"),
        F.get("segments", F.lit(0)).start.alias("first"), F.try_element_at("segments", F.lit(-1)).end.alias("last"),
    )


def touches_box(start: Column, end: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a segment begins or ends in a box."""
    return geo.in_box(start, south, west, north, east) | geo.in_box(end, south, west, north, east)


def roads_in_box(roads: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return roads.where(F.exists("segments", lambda s: touches_box(s.start, s.end, south, west, north, east)))


def find_roads(roads: DataFrame, name: str | None = None, way_id: int | None = None) -> DataFrame:
    out = roads if name is None else roads.where(F.col("group_key") == name)
    return out if way_id is None else out.where(F.array_contains("way_ids", F.lit(way_id).cast("long")))


def pass_summary(roads: DataFrame, min_score: float, min_length: float = tags.MIN_LENGTH_M, min_mph: float = 0.0) -> DataFrame:
    """Whether each road would be published, and a line that says so."""
    good = (F.col("penalized_score") >= min_score) & (F.col("total_length") >= min_length)
    if min_mph > 0:
        good = good & (tags.passing_fraction(F.col("way_speeds"), F.col("total_length"), min_mph) >= 0.5)
    line = F.format_string("%s: score %.0f, length %.0f m, %s", F.col("group_key"), F.col("penalized_score"), F.col("total_length"), F.when(good, "passes").otherwise("fails"))
    return roads.select("group_key", "sub_index", good.alias("passes"), line.alias("summary"))


def of_tiles(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """The rows whose tile (lat_idx, lon_idx) is one of ``tiles``."""
    return rows.join(tiles.select("lat_idx", "lon_idx").distinct(), ["lat_idx", "lon_idx"], "left_semi")


def spacing(roads: DataFrame, apart_m: float, cell: float = 0.01) -> DataFrame:
    """(a, b, away_m), a < b, of the entries (id, first, last) with ends within ``apart_m``, by their least distance: an equi-join on cells
    at least that wide, so distant pairs never meet."""
    size = F.greatest(F.lit(cell), F.lit(apart_m / 111000.0))
    band = lambda p: F.floor(p.lat / size).cast("long")
    column = lambda lon, b: F.floor(lon * F.cos(F.radians(F.least((F.abs(b) + 2) * size, F.lit(89.0)))) / size).cast("long")
    ends = roads.select("id", F.explode(F.array("first", "last")).alias("p")).where("p IS NOT NULL").withColumn("i", band(F.col("p")))
    left = ends.select(F.col("id").alias("a"), F.col("p").alias("pa"), "i", column(F.col("p.lon"), F.col("i")).alias("j"))
    probe = ends.select(F.col("id").alias("b"), F.col("p").alias("pb"), F.explode(F.sequence(F.col("i") - 1, F.col("i") + 1)).alias("i"))
    centre = column(F.col("pb.lon"), F.col("i"))
    right = probe.select("b", "pb", "i", F.explode(F.sequence(centre - 1, centre + 1)).alias("j"))
    met = left.join(right, ["i", "j"]).where("a < b").withColumn("away_m", geo.haversine(F.col("pa"), F.col("pb")))
    return met.where(F.col("away_m") <= apart_m).groupBy("a", "b").agg(F.min("away_m").alias("away_m"))


def tile_rings(status: DataFrame, size: float) -> DataFrame:
    """(lat_idx, lon_idx, feature): each tile as a closed ring with its label and whether it is loaded."""
    s, w = F.col("lat_idx") * size, F.col("lon_idx") * size
    ring = F.array(*[F.array(x, y) for x, y in ((w, s), (w + size, s), (w + size, s + size), (w, s + size), (w, s))])
    properties = F.struct(F.format_string("%.3f,%.3f", s, w).alias("label"), (F.col("status") == "present").alias("loaded"))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return status.select("lat_idx", "lon_idx", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))).alias("feature"))


def locate_ways(wanted: DataFrame, ways: DataFrame) -> DataFrame:
    """Each wanted way_id with the first tile that has it, or found false."""
    first = ways.groupBy("way_id").agg(F.min("tile_key").alias("tile_key"))
    return wanted.select("way_id").distinct().join(first, "way_id", "left").withColumn("found", F.col("tile_key").isNotNull())


def exported_ways(roads: DataFrame, exported: DataFrame) -> DataFrame:
    """Per road which of its ways an export has and lacks, and how many."""
    rows = roads.select("group_key", "sub_index", F.explode("way_ids").alias("way_id")).join(exported.select("way_id", F.lit(True).alias("_in")).distinct(), "way_id", "left")
    has = F.coalesce("_in", F.lit(False))
    ids = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("way_id"))))
    out = rows.groupBy("group_key", "sub_index").agg(ids(has).alias("present_ids"), ids(~has).alias("missing_ids"))
    return out.select("*", F.size("present_ids").cast("long").alias("present"), F.size("missing_ids").cast("long").alias("missing"))


def tile_status(wanted: DataFrame, loaded: DataFrame, failed: DataFrame) -> DataFrame:
    """Each wanted tile (lat_idx, lon_idx) with status present, failed or missing."""
    keys = ["lat_idx", "lon_idx"]
    a, b = loaded.select(*keys).distinct().withColumn("_a", F.lit(True)), failed.select(*keys).distinct().withColumn("_b", F.lit(True))
    return wanted.select(*keys).distinct().join(a, keys, "left").join(b, keys, "left").select(*keys, F.when(F.col("_a"), "present").when(F.col("_b"), "failed").otherwise("missing").alias("status"))


def new_tiles(wanted: DataFrame, fetched: DataFrame) -> DataFrame:
    return wanted.select("lat_idx", "lon_idx").distinct().join(fetched, ["lat_idx", "lon_idx"], "left_anti")


def status_counts(status: DataFrame) -> DataFrame:
    """(status, n): how many tiles are present, failed and missing."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def neighbours(roads: DataFrame, start_m: float = 1000.0, prefix: str | None = None) -> DataFrame:
    """(id, other, away_m): for each entry (id, first, last) the one whose ends come nearest to its own, at any distance, the smallest id among
    equals to the millimetre; of those whose id begins with ``prefix`` only, if given. An entry without others has no row.

    Rounds with a radius that doubles: entries without a neighbour yet are copied to the cells around their ends, cells as wide as the
    radius, and meet all entries there. Those that found one leave, so few entries look in large cells. Not across the date line.
    """
    named = roads if prefix is None else roads.where(F.col("id").startswith(prefix))
    ends = store(named.select("id", F.explode(F.array("first", "last")).alias("p")).where("p IS NOT NULL"))
    left, reach, rounds, used = ends, start_m, [], []
    while not left.isEmpty() and reach < 2 * math.pi * geo.EARTH_M:
        size = 1.5 * reach / 111000.0
        band = lambda p: geo.cell(p.lat, size)  # noqa: B023, E731
        column = lambda lon, b: geo.cell(lon * F.cos(F.radians(F.least((F.abs(b) + 2) * size, F.lit(89.0)))), size)  # noqa: B023, E731
        near = lambda c: F.explode(F.sequence(c - 1, c + 1))
        there = ends.select(F.col("id").alias("other"), F.col("p").alias("q"), band(F.col("p")).alias("i")).withColumn("j", column(F.col("q.lon"), F.col("i")))
        probe = left.select("id", "p", near(band(F.col("p"))).alias("i")).select("id", "p", "i", near(column(F.col("p.lon"), F.col("i"))).alias("j"))
        met = probe.join(there, ["i", "j"]).where("id <> other").withColumn("away_m", geo.haversine(F.col("p"), F.col("q"))).where(F.col("away_m") <= reach)
        best = F.min_by(F.struct("other", "away_m"), F.struct(F.round("away_m", 3), "other"))
        rounds.append(store(met.groupBy("id").agg(best.alias("b")).select("id", "b.*")))
        left = store(left.join(rounds[-1], "id", "left_anti"))
        used.append(left)
        reach *= 2
    out = rounds[0] if rounds else ends.select("id", F.col("id").alias("other"), F.lit(0.0).alias("away_m")).where(F.lit(False))
    for more in rounds[1:]:
        out = out.unionByName(more)
    out = store(out)
    discard(ends, *used, *rounds)
    return out
