"""Ways: assembling geometry, filtering, removing duplicates and grouping by name and ref.

A way is a row (way_id, name, ref, highway, maxspeed, oneway, surface, access, motor_vehicle, geometry); geometry is an array of
points in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hairpin.functions import tags


def assemble_geometry(way_nodes: DataFrame) -> DataFrame:
    """(way_id, geometry) from rows (way_id, node_idx, lat, lon); one shuffle, on way_id."""
    rows = way_nodes.groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("node_idx", "lat", "lon"))).alias("n"))
    return rows.select("way_id", F.transform("n", lambda x: F.struct(x.lat.alias("lat"), x.lon.alias("lon"))).alias("geometry"))


def resolve_nodes(osm_ways: DataFrame, osm_nodes: DataFrame) -> DataFrame:
    """(way_id, node_idx, lat, lon) from ways with node_ids; nodes that aren't there are left out."""
    refs = osm_ways.select(F.col("id").alias("way_id"), F.posexplode("node_ids").alias("node_idx", "node_id"))
    return refs.join(osm_nodes.select(F.col("id").alias("node_id"), "lat", "lon"), "node_id").select("way_id", F.col("node_idx").cast("long").alias("node_idx"), "lat", "lon")


def hard_filter(ways: DataFrame) -> DataFrame:
    return ways.where(~tags.rejected(F.col("surface"), F.col("access"), F.col("motor_vehicle"), F.col("highway")))


def drivable_only(ways: DataFrame) -> DataFrame:
    return ways.where(tags.drivable(F.col("highway")))


def distinct_ways(ways: DataFrame, order: str = "tile_key") -> DataFrame:
    """The first of the rows of each way by ``order``; way 0 has no identity and stays as often as it occurs."""
    rank = F.row_number().over(Window.partitionBy("way_id").orderBy(order))
    known = ways.where("way_id <> 0").withColumn("_r", rank).where("_r = 1").drop("_r")
    return known.unionByName(ways.where("way_id = 0"))


def group_keys(with_refs: bool = True):
    """Array column of a way's keys: its name and, if asked for, each part of its ref."""
    name = F.array(F.col("name"))
    parts = F.coalesce(F.transform(F.split("ref", ";"), lambda x: F.trim(x)), F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.concat(name, parts) if with_refs else name, lambda x: x.isNotNull() & (x != "")))


def copy_keys(ways: DataFrame) -> list[str]:
    """What names a row of a way: its id and, where several tiles bring it, the tile."""
    return ["way_id", *(["tile_key"] if "tile_key" in ways.columns else [])]


def grouped(ways: DataFrame, with_refs: bool = True) -> DataFrame:
    """Each way once for each of its keys, as group_key; of several rows of a way that of the lowest tile_key, where there is such a column."""
    rows = ways.withColumn("group_key", F.explode(group_keys(with_refs)))
    if "tile_key" not in ways.columns:
        return rows.dropDuplicates(["group_key", "way_id"])
    others = F.struct(*[c for c in rows.columns if c not in ("group_key", "way_id")])
    return rows.groupBy("group_key", "way_id").agg(F.min_by(others, "tile_key").alias("_w")).select("group_key", "way_id", "_w.*")


def in_box(ways: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    return ways.where(F.exists("geometry", lambda p: p.lat.between(south, north) & p.lon.between(west, east)))


def scored_in_box(scored: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Scored ways of which a segment begins or ends in the box; a way without segments is in none. Asked of the geometry, whose points are
    those ends, so that a filter ahead of the scoring doesn't work out the segments."""
    return in_box(scored.where(F.size("geometry") >= 2), south, west, north, east)


def find(ways: DataFrame, ref_part: str | None = None, name_part: str | None = None, exact: str | None = None, match: Column | None = None) -> DataFrame:
    """Ways whose ref or name contains a text, whose name or ref is one, or for which a condition of the caller's holds; case
    matters. All columns stay, so also the tile that a way was found in."""
    out = ways if match is None else ways.where(match)
    if ref_part is not None:
        out = out.where(F.col("ref").contains(ref_part))
    if name_part is not None:
        out = out.where(F.col("name").contains(name_part))
    if exact is not None:
        out = out.where((F.col("name") == exact) | (F.col("ref") == exact))
    return out


def merge_regions(*regions: DataFrame) -> DataFrame:
    """The union of the regions' objects of one type; of those with equal ids the one of the first region stays."""
    rows = None
    for i, region in enumerate(regions):
        part = region.withColumn("_region", F.lit(i))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    others = [c for c in rows.columns if c not in ("id", "_region")]
    return rows.groupBy("id").agg(F.min_by(F.struct(*others), "_region").alias("s")).select("id", "s.*")
