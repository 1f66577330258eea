"""Geometry as Column expressions. Points are struct columns with fields lat and lon, in degrees; lengths are metres."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6371000.0
INF = float("inf")


def point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def haversine(a: Column, b: Column) -> Column:
    """Great-circle distance of two points."""
    h = F.pow(F.sin(F.radians(b.lat - a.lat) / 2), F.lit(2.0)) + F.cos(F.radians(a.lat)) * F.cos(F.radians(b.lat)) * F.pow(F.sin(F.radians(b.lon - a.lon) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def metres(lat: float, lon: float, to_lat: float, to_lon: float) -> float:
    """:func:`haversine` of plain numbers."""
    la, lb = math.radians(lat), math.radians(to_lat)
    h = math.sin(math.radians(to_lat - lat) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(to_lon - lon) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(math.sqrt(h), 1.0))


def bearing(a: Column, b: Column) -> Column:
    """Initial bearing from a to b, in [0, 360)."""
    la, lb, d = F.radians(a.lat), F.radians(b.lat), F.radians(b.lon - a.lon)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d))), F.lit(360.0))


def signed_turn(a: Column, b: Column) -> Column:
    """From bearing a to bearing b, in [-180, 180)."""
    return F.pmod(b - a + 180, F.lit(360.0)) - 180


def turn(a: Column, b: Column) -> Column:
    """Absolute difference of two bearings, in [0, 180]."""
    return F.abs(signed_turn(a, b))


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius of the circle through three points; infinite where they are in line."""
    return radius_of_sides(haversine(b, c), haversine(a, c), haversine(a, b))


def radius_of_sides(x: Column, y: Column, z: Column) -> Column:
    """Radius of the circle around a triangle with these sides. They stand in the expression many times: pass columns or fields."""
    s = (x + y + z) / 2
    area = F.sqrt(F.greatest(s * (s - x) * (s - y) * (s - z), F.lit(0.0)))
    return F.when(area < 1e-10, F.lit(INF)).otherwise(x * y * z / (4 * area))


def destination(origin: Column, degrees: Column, metres: Column) -> Column:
    """The point at a distance and bearing from another."""
    d, t, la = metres / EARTH_M, F.radians(degrees), F.radians(origin.lat)
    lb = F.asin(F.sin(la) * F.cos(d) + F.cos(la) * F.sin(d) * F.cos(t))
    return point(F.degrees(lb), F.degrees(F.radians(origin.lon) + F.atan2(F.sin(t) * F.sin(d) * F.cos(la), F.cos(d) - F.sin(la) * F.sin(lb))))


def midpoint(a: Column, b: Column) -> Column:
    return point((a.lat + b.lat) / 2, (a.lon + b.lon) / 2)


def cell(degrees: Column, size: float) -> Column:
    """Index of the tile or bucket that a coordinate is in."""
    return F.floor(degrees / size).cast("long")


def metric_cell(p: Column, origin: Column, metres: float) -> Column:
    """(i, j) of the square of a grid that begins at ``origin``."""
    north = haversine(origin, point(p.lat, origin.lon)) * F.signum(p.lat - origin.lat)
    east = haversine(origin, point(origin.lat, p.lon)) * F.signum(p.lon - origin.lon)
    return F.struct(F.floor(north / metres).cast("long").alias("i"), F.floor(east / metres).cast("long").alias("j"))


def tile_key(lat_idx: Column, lon_idx: Column, size: float) -> Column:
    return F.format_string("tile_%.3f_%.3f", lat_idx * F.lit(size), lon_idx * F.lit(size))


def tiles_of_box(south: Column, west: Column, north: Column, east: Column, size: float) -> Column:
    """Array of (lat_idx, lon_idx) of the tiles that a box touches."""
    lats, lons = F.sequence(cell(south, size), cell(north, size)), F.sequence(cell(west, size), cell(east, size))
    return F.flatten(F.transform(lats, lambda i: F.transform(lons, lambda j: F.struct(i.alias("lat_idx"), j.alias("lon_idx")))))


def tiles_of_circle(centre: Column, radius_km: Column, size: float) -> Column:
    """Array of (lat_idx, lon_idx) around a centre, up to but without tiles that begin at the north or east bound."""
    dlat = radius_km / 111.32
    dlon = radius_km / (111.32 * F.cos(F.radians(centre.lat)))
    last = lambda top: F.ceil(top / size).cast("long") - 1
    lats = F.sequence(cell(centre.lat - dlat, size), F.greatest(last(centre.lat + dlat), cell(centre.lat - dlat, size)))
    lons = F.sequence(cell(centre.lon - dlon, size), F.greatest(last(centre.lon + dlon), cell(centre.lon - dlon, size)))
    return F.flatten(F.transform(lats, lambda i: F.transform(lons, lambda j: F.struct(i.alias("lat_idx"), j.alias("lon_idx")))))


def in_box(p: Column, south: float, west: float, north: float, east: float) -> Column:
    return p.lat.between(south, north) & p.lon.between(west, east)


def valid_point(p: Column) -> Column:
    return F.coalesce(p.lat.between(-90, 90) & p.lon.between(-180, 180), F.lit(False))


def quarantined(rows: DataFrame, point_column: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose point exists, and those whose doesn't."""
    good = valid_point(F.col(point_column))
    return rows.where(good), rows.where(~good)
