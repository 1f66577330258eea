"""Features and documents as text columns: GeoJSON, KML and GPX, one row for each feature or road, ready for a text sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hairpin.functions import tags
from hairpin.operators.assemble import display_name


def _pair(p: Column) -> Column:
    return F.array(p.lon, p.lat)


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def segment_features(roads: DataFrame, ways: DataFrame) -> DataFrame:
    """(way_id, feature): a LineString for each segment of each road, with its way's class and speed where it has them."""
    rows = roads.select("group_key", "sub_index", F.explode_outer("segments").alias("s")).where("s IS NOT NULL").select("group_key", "sub_index", "s.*")
    return numbered_features(rows.join(ways.select("way_id", "highway", "maxspeed"), "way_id", "left"))


def numbered_features(segments: DataFrame) -> DataFrame:
    """The same of segments (group_key, sub_index, way_id, highway, maxspeed, start, end, tier, score) that no road holds: a projection."""
    tag = lambda c: F.nullif(c, F.lit("")).alias(c)
    shape = F.struct(F.lit("LineString").alias("type"), F.array(_pair(F.col("start")), _pair(F.col("end"))).alias("coordinates"))
    properties = F.struct(display_name().alias("road_name"), "tier", "score", "way_id", tag("highway"), tag("maxspeed"))
    return segments.select("way_id", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties"))).alias("feature"))


def road_features(roads: DataFrame) -> DataFrame:
    """(group_key, sub_index, feature): a MultiLineString for each road that has segments; the speed is null where none is tagged."""
    rows = roads.where(F.size("segments") > 0)
    line = F.concat(F.array(_pair(F.get("segments", F.lit(0)).start)), F.transform("segments", lambda s: _pair(s.end)))
    shape = F.struct(F.lit("MultiLineString").alias("type"), F.array(line).alias("coordinates"))
    properties = F.struct(display_name().alias("road_name"), F.col("total_score").alias("score"), tags.colour_css(tags.colour_level(F.col("total_score"))).alias("color"), tags.mean_speed(F.col("way_speeds")).alias("max_speed_mph"))
    return rows.select("group_key", "sub_index", F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def coordinates(points: Column) -> Column:
    """``lon,lat,0`` of each point, to six places."""
    return F.array_join(F.transform(points, lambda p: F.format_string("%.6f,%.6f,0", p.lon, p.lat)), " ")


def description() -> Column:
    return F.format_string(
        "Score: %d | Per km: %d | Length: %.1f km | Types: %s | Ways: %s",
        F.round("penalized_score").cast("long"), F.round("penalized_per_km").cast("long"), F.col("total_length") / 1000,
        F.array_join("highway_types", ", "), F.array_join(F.transform("way_ids", lambda x: x.cast("string")), ", "),
    )


def _runs(segments: Column) -> Column:
    """Segments of equal tier next to each other: array of (tier, points), a fold over the road's own array."""
    empty = F.array().cast("array<struct<tier:int,points:array<struct<lat:double,lon:double>>>>")
    last = lambda s: F.try_element_at(s, F.lit(-1))
    fresh = lambda x: F.struct(x.tier.alias("tier"), F.array(x.start, x.end).alias("points"))
    longer = lambda s, x: F.concat(F.slice(s, 1, F.size(s) - 1), F.array(F.struct(x.tier.alias("tier"), F.concat(last(s).points, F.array(x.end)).alias("points"))))
    return F.aggregate(segments, empty, lambda s, x: F.when(F.coalesce(last(s).tier == x.tier, F.lit(False)), longer(s, x)).otherwise(F.concat(s, F.array(fresh(x)))))


def line() -> Column:
    """The points of a road of segments, in order."""
    s = F.col("segments")
    return F.when(F.size(s) > 0, F.concat(F.array(F.get(s, F.lit(0)).start), F.transform(s, lambda x: x.end))).otherwise(F.array().cast("array<struct<lat:double,lon:double>>"))


def kml_folders(roads: DataFrame, by_tier: bool = True) -> DataFrame:
    """(group_key, sub_index, folder): each road as a KML folder, its runs in the colour of their tier or all in one by its score. For the latter a road
    may have its :func:`line` instead of segments."""
    mark = lambda style, points: F.concat(F.lit("<Placemark>"), style, F.lit("<LineString><coordinates>"), coordinates(points), F.lit("</coordinates></LineString></Placemark>"))
    if by_tier:
        marks = F.array_join(F.transform(_runs(F.col("segments")), lambda r: mark(F.concat(F.lit("<styleUrl>#tier"), r.tier.cast("string"), F.lit("</styleUrl>")), r.points)), "")
    else:
        colour = tags.colour_kml(tags.colour_level(F.col("total_score")))
        style = F.concat(F.lit("<Style><LineStyle><color>"), colour, F.lit("</color><width>4</width></LineStyle></Style>"))
        marks = mark(style, F.col("line") if "line" in roads.columns else line())
    folder = F.concat(F.lit("<Folder><name>"), escaped(display_name()), F.lit("</name><description>"), escaped(description()), F.lit("</description>"), marks, F.lit("</Folder>"))
    return roads.select("group_key", "sub_index", folder.alias("folder"))


#: The colours that raw ways take in turn (AABBGGRR).
PALETTE = ["FF0000FF", "FFFF0000", "FF00FF00", "FF00FFFF", "FFFF00FF", "FFFFFF00", "FF0080FF", "FF800080", "FF008080", "FF80FF00", "FF0000A0", "FFA00000"]
KML_HEAD = '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>'
KML_FOOT = "</Document></kml>"


def tier_styles() -> str:
    """The styles that the placemarks of :func:`kml_folders` refer to."""
    return "".join(f'<Style id="tier{i}"><LineStyle><color>{c}</color><width>4</width></LineStyle></Style>' for i, c in enumerate(tags.TIER_COLOURS))


def kml_documents(folders: DataFrame, *keys: str) -> DataFrame:
    """(keys, document): the folders (seq, folder) of each key as one KML document with the tiers' styles, in order of seq."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "folder"))), lambda x: x.folder), "")
    return folders.groupBy(*keys).agg(F.concat(F.lit(KML_HEAD + tier_styles()), body, F.lit(KML_FOOT)).alias("document"))


def raw_way_folders(ways: DataFrame) -> DataFrame:
    """(group_key, way_id, seq, folder): each way with two nodes or more as a KML folder and placemark of its name; colours go by the row number
    of a way in its group, by pos, counted with the ways that have no line."""
    seq = F.row_number().over(Window.partitionBy("group_key").orderBy("pos", "way_id")) - 1
    colour = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), F.col("seq") % len(PALETTE) + 1)
    tag = lambda c: F.coalesce(F.col(c), F.lit(""))
    text = F.format_string("name=%s | ref=%s | highway=%s | nodes=%d", tag("name"), tag("ref"), tag("highway"), F.size("geometry"))
    title = F.concat(F.lit("<name>Way "), F.col("way_id").cast("string"), F.lit("</name>"))
    mark = F.concat(F.lit("<Placemark>"), title, F.lit("<Style><LineStyle><color>"), colour, F.lit("</color><width>4</width></LineStyle></Style><LineString><coordinates>"), coordinates(F.col("geometry")), F.lit("</coordinates></LineString></Placemark>"))
    folder = F.concat(F.lit("<Folder>"), title, F.lit("<description>"), escaped(text), F.lit("</description>"), mark, F.lit("</Folder>"))
    return ways.withColumn("seq", seq).where(F.size("geometry") >= 2).select("group_key", "way_id", "seq", folder.alias("folder"))


def folder_entries(folders: DataFrame, prefix: str = "") -> DataFrame:
    """(name, way_ids, first, last, south, west, north, east, n_points) read back from KML folder texts (folder) whose name has the prefix."""
    found = lambda tag: F.regexp_extract("folder", f"<{tag}>(.*?)</{tag}>", 1)
    lines = F.expr("regexp_extract_all(folder, '<coordinates>(.*?)</coordinates>', 1)")
    triples = F.filter(F.flatten(F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))), lambda x: x != "")
    number = lambda t, i: F.get(F.split(t, ","), F.lit(i)).cast("double")
    points = F.transform(triples, lambda t: F.struct(number(t, 1).alias("lat"), number(t, 0).alias("lon")))
    name = found("name")
    for a, b in (("&#39;", "'"), ("&#34;", '"'), ("&gt;", ">"), ("&lt;", "<"), ("&amp;", "&")):
        name = F.replace(name, F.lit(a), F.lit(b))
    ids = F.transform(F.filter(F.split(F.regexp_extract(found("description"), r"Ways: ([0-9, ]*)", 1), ", "), lambda x: x != ""), lambda x: x.cast("long"))
    rows = folders.select(name.alias("name"), ids.alias("way_ids"), points.alias("p")).where(F.startswith("name", F.lit(prefix)))
    bound = lambda f, c: f(F.transform("p", lambda x: x[c]))
    return rows.select(
        "name", "way_ids", F.get("p", F.lit(0)).alias("first"), F.try_element_at("p", F.lit(-1)).alias("last"), bound(F.array_min, "lat").alias("south"), bound(F.array_min, "lon").alias("west"),
        bound(F.array_max, "lat").alias("north"), bound(F.array_max, "lon").alias("east"), F.size("p").cast("long").alias("n_points"),
    )


def gpx_documents(routes: DataFrame, name: Column, description: Column | None = None, creator: str = "hairpin") -> DataFrame:
    """(request_id, route_idx, document): each route as a GPX track, after its waypoints (an array of name, description, lat, lon) if it has a column
    waypoints. Names and descriptions that are null or empty are left out."""
    tag = lambda t, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{t}>"), escaped(c), F.lit(f"</{t}>"))).otherwise("")
    track = F.array_join(F.transform("points", lambda p: F.format_string('<trkpt lat="%.6f" lon="%.6f"></trkpt>', p.lat, p.lon)), "")
    stops = F.lit("")
    if "waypoints" in routes.columns:
        one = lambda w: F.concat(F.format_string('<wpt lat="%.6f" lon="%.6f">', w.lat, w.lon), tag("name", w["name"]), tag("desc", w.description), F.lit("</wpt>"))
        stops = F.array_join(F.transform(F.coalesce("waypoints", F.array().cast(routes.schema["waypoints"].dataType)), one), "")
    head = F.lit(f'<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="{creator}" xmlns="http://www.topografix.com/GPX/1/1">')
    text = F.concat(head, stops, F.lit("<trk>"), tag("name", name), tag("desc", description if description is not None else F.lit(None).cast("string")), F.lit("<trkseg>"), track, F.lit("</trkseg></trk></gpx>"))
    return routes.select("request_id", "route_idx", text.alias("document"))


def route_kml(routes: DataFrame, name: Column) -> DataFrame:
    """(request_id, route_idx, document): each route as a KML document with one line."""
    style = "<Style><LineStyle><color>ff0000ff</color><width>4</width></LineStyle></Style>"
    mark = F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit(f"</name>{style}<LineString><coordinates>"), coordinates(F.col("points")), F.lit("</coordinates></LineString></Placemark>"))
    return routes.select("request_id", "route_idx", F.concat(F.lit(KML_HEAD), mark, F.lit(KML_FOOT)).alias("document"))
