"""Responses of a routing service, stored as a table of JSON texts, as candidate routes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.functions import geo
from hairpin.operators.routes import decode_polyline

_TRIP = "struct<summary:struct<time:double,length:double>,legs:array<struct<shape:string,summary:struct<time:double,length:double>,maneuvers:array<struct<instruction:string,street_names:array<string>,time:double,length:double,begin_shape_index:int>>>>>"
SCHEMA = f"trip {_TRIP}, alternates array<struct<trip:{_TRIP}>>"
PRECISION = 1e6


def read_routes(responses: DataFrame) -> DataFrame:
    """Routes (request_id, route_idx, points, duration, distance, maneuvers, leg_ends) of rows (request_id, response).

    Legs are decoded one by one; the point at which two legs meet is kept once; times are seconds and lengths metres, summed over
    legs; a maneuver is placed at its point of its leg's line, or at 0, 0 where there is none. What can't be read gives no route.
    """
    parsed = responses.select("request_id", F.from_json("response", SCHEMA).alias("r")).where("r.trip IS NOT NULL")
    trips = F.concat(F.array("r.trip"), F.coalesce(F.transform("r.alternates", lambda a: a.trip), F.array().cast(f"array<{_TRIP}>")))
    legs = parsed.select("request_id", F.posexplode(trips).alias("route_idx", "t")).select("request_id", "route_idx", F.posexplode("t.legs").alias("leg", "l"))
    legs = legs.withColumn("p", decode_polyline(F.col("l.shape"), PRECISION))
    origin = F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))
    turns = F.transform(
        F.coalesce("l.maneuvers", F.array().cast("array<struct<instruction:string,street_names:array<string>,time:double,length:double,begin_shape_index:int>>")),
        lambda m: F.struct(m.instruction, m.street_names, m.time, m.length.alias("length_km"), F.coalesce(F.get("p", m.begin_shape_index), origin).alias("location")),
    )
    one = F.struct("leg", F.col("p").alias("p"), F.col("l.summary.time").alias("s"), (F.col("l.summary.length") * 1000).alias("m"), turns.alias("turns"))
    rows = legs.groupBy("request_id", "route_idx").agg(F.array_sort(F.collect_list(one)).alias("g"))
    total = lambda f: F.aggregate("g", F.lit(0.0), lambda s, x: s + F.coalesce(x[f], F.lit(0.0)))
    return rows.select(
        "request_id", "route_idx", stitched("g").alias("points"), total("s").alias("duration"), total("m").alias("distance"),
        F.flatten(F.transform("g", lambda x: x.turns)).alias("maneuvers"), F.transform("g", lambda x: F.try_element_at(x.p, F.lit(-1))).alias("leg_ends"),
    )


def stitched(legs: str):
    """The points of an array of legs (field p) in one line; later legs give up their first point."""
    return F.flatten(F.transform(legs, lambda x, i: F.when(i == 0, x.p).otherwise(F.slice(x.p, 2, F.greatest(F.size(x.p), F.lit(1))))))


def stops(routes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(request_id, route_idx, stop, name, lat, lon): the start and the end of each leg, named by ``names`` (request_id, stop, name)."""
    ends = F.concat(F.array(F.get("points", F.lit(0))), F.col("leg_ends"))
    rows = routes.select("request_id", "route_idx", F.posexplode(ends).alias("stop", "p"))
    rows = rows.withColumn("name", F.lit(None).cast("string")) if names is None else rows.join(names.select("request_id", "stop", "name"), ["request_id", "stop"], "left")
    return rows.select("request_id", "route_idx", "stop", "name", "p.lat", "p.lon")


def snap_report(routes: DataFrame, wanted: DataFrame, gap_m: float = 150.0) -> DataFrame:
    """``wanted`` ends (request_id, from_lat, from_lon, to_lat, to_lon) against those of the routes: how far each end was moved, and gap
    where one was by more than ``gap_m``; null where there is no route or no end to compare with."""
    asked = lambda k: F.when(F.col(f"{k}_lat").isNotNull() & F.col(f"{k}_lon").isNotNull(), F.struct(F.col(f"{k}_lat").alias("lat"), F.col(f"{k}_lon").alias("lon")))
    rows = wanted.join(routes.select("request_id", "route_idx", F.get("points", F.lit(0)).alias("p"), F.try_element_at("points", F.lit(-1)).alias("q")), "request_id", "left")
    rows = rows.select("request_id", "route_idx", geo.haversine(asked("from"), F.col("p")).alias("start_m"), geo.haversine(asked("to"), F.col("q")).alias("end_m"))
    return rows.withColumn("gap", F.greatest("start_m", "end_m") > gap_m)


#: The other dialect: whole routes with one line each, in 1e-5 degrees, and a code that tells whether there are any.
CODED_SCHEMA = "code string, routes array<struct<geometry:string,duration:double,distance:double>>"


def read_coded_routes(responses: DataFrame) -> DataFrame:
    """Routes (request_id, route_idx, points, duration, distance) of rows (request_id, response) whose code is Ok."""
    parsed = responses.select("request_id", F.from_json("response", CODED_SCHEMA).alias("r")).where("r.code = 'Ok'")
    rows = parsed.select("request_id", F.posexplode("r.routes").alias("route_idx", "t"))
    return rows.select("request_id", "route_idx", decode_polyline(F.col("t.geometry"), 1e5).alias("points"), "t.duration", "t.distance")


def _cut_bytes(text, n: int):
    """The first ``n`` bytes of a text, without a character that they would part."""
    raw = F.encode(text, "UTF-8")
    # a byte of 80 to BF goes on with the character before it, which has four bytes at most
    whole = [F.when(~F.hex(F.substring(raw, k + 1, 1)).rlike("^[89AB]"), F.substring(raw, 1, k)) for k in range(n, n - 4, -1)]
    return F.when(F.octet_length(text) <= n, text).otherwise(F.coalesce(*whole).cast("string"))


def turn_points(routes: DataFrame) -> DataFrame:
    """(request_id, route_idx, pos, name, description, lat, lon) of the maneuvers, with names of 40 bytes at most."""
    m = routes.select("request_id", "route_idx", F.posexplode("maneuvers").alias("pos", "m"))
    text = F.format_string("%s (%.0f s, %.1f km)", "m.instruction", F.coalesce("m.time", F.lit(0.0)), F.coalesce("m.length_km", F.lit(0.0)))
    return m.select("request_id", "route_idx", "pos", _cut_bytes(F.col("m.instruction"), 40).alias("name"), text.alias("description"), "m.location.lat", "m.location.lon")
