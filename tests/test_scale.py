"""Steps of the road table: the same rows as the plainer form, with less moved."""

import random

from pyspark.sql import functions as F

from hairpin.operators import assemble, segments
from hairpin.plans import adapter, roads

POINT = "struct<lat:double,lon:double>"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_by_squares_equal_those_of_links(spark):
    """Chains over borders of squares, crowds in one cell, pairs a little nearer and farther than the distance; none or one end only is no link."""
    rng, rows = random.Random(5), []
    for name, lat, lon in (("a", 40.0, -80.0), ("b", -0.0005, 0.0005), ("c", 69.9999, 19.9999)):
        for i in range(80):
            p = (lat + rng.uniform(-0.009, 0.009), lon + rng.uniform(-0.009, 0.009))
            rows.append((name, i, p, (p[0] + rng.uniform(-0.002, 0.002), p[1] + rng.uniform(-0.002, 0.002))))
        rows += [(name, 1000 + i, (lat + 0.3, lon + 0.008 * i), (lat + 0.3, lon + 0.008 * (i + 1))) for i in range(30)]
        rows += [(name, 2000 + i, (lat + 0.5 + i * 1e-7, lon), (lat + 0.5, lon + i * 1e-7)) for i in range(20)]
        rows += [(name, 3000 + i, (lat - 0.5, lon + i), (lat - 0.5 + (100 + d) / 111194.93, lon + i + 0.5)) for i, d in enumerate((-0.1, 0.1))]
        rows += [(name, 3010 + i, (lat - 0.5 + (100 + d) / 111194.93, lon + i), (lat - 0.6, lon + i)) for i, d in enumerate((-0.1, 0.1))]
        rows += [(name, 4000, None, None)]
    rng.shuffle(rows)
    ends = spark.createDataFrame(rows, f"group_key string, way_id long, first {POINT}, last {POINT}")
    want = {(r.group_key, r.way_id): r.component for r in assemble.components(ends, assemble.proximity_links(ends)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        found = {(r.group_key, r.way_id): r.component for r in assemble.near_components(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == want and len(found) == len(rows)
    assert found["a", 1029] == 1000 and found["a", 2019] == 2000 and found["a", 3010] == 3000 and found["a", 3011] == 3011


def test_nodes_are_those_of_the_sql_and_ways_move_rows_twice(spark, tmp_path):
    """Also with orders without lines, between others and alone."""
    orders = [(10 * road + k, road) for road in range(1, 8) for k in range(5)]
    lines = [(o, 37 * o + n, o % 5 + n, n, 10.0 + n, 1.0 * n) for o, _ in orders if o % 10 != 2 and o < 70 for n in range(1, 4)]
    o = spark.createDataFrame([(k, c, "1-URGENT") for k, c in orders], "o_orderkey long, o_custkey long, o_orderpriority string")
    line = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double")
    o.write.parquet(str(tmp_path / "orders.parquet"))
    line.write.parquet(str(tmp_path / "lineitem.parquet"))
    columns = ["way_id", "road", "node_idx", "lat7", "lon7"]
    want = sorted(tuple(r) for r in spark.sql(adapter.NODES_SQL, orders=o, lineitem=line).select(columns).collect())
    assert sorted(tuple(r) for r in adapter.nodes(spark, str(tmp_path)).select(columns).collect()) == want
    ways = adapter.ways(spark, str(tmp_path))
    sizes = {r.way_id: len(r.geometry) for r in ways.collect()}
    assert len(sizes) == len(orders) and sum(sizes.values()) == len(want) and sizes[13] == 0 and sizes[71] == 0
    tags = {r.o.way_id: r.o for r in spark.sql(adapter.TAGS_SQL, orders=o).select(F.struct("*").alias("o")).collect()}
    assert all(r[c] == tags[r.way_id][c] for r in ways.collect() for c in ("name", "ref", "highway", "surface", "access", "oneway", "maxspeed"))
    # the two tables by order, then their rows by road
    assert planned(adapter.nodes(spark, str(tmp_path))).count("Exchange") <= 3 and planned(adapter.ways(spark, str(tmp_path))).count("Exchange") <= 3


def test_segments_are_not_sorted_to_be_counted_nor_joined_to_their_windows(spark):
    way = ("a", 0, 0, 0, False, 1, "primary", None, 3)
    placed = spark.createDataFrame([way, ("a", 0, 0, 1, True, 2, "primary", None, 2)], "group_key string, component long, chunk long, pos int, reversed boolean, way_id long, highway string, maxspeed string, n_segments int")
    line = F.transform(F.sequence(F.lit(0), F.col("n_segments")), lambda i: F.struct((F.lit(40.0) + i * 0.001).alias("lat"), F.lit(-80.0).alias("lon")))
    own = segments.score_ways(placed.withColumn("geometry", line)).withColumn("offset", F.when(F.col("pos") == 0, 0).otherwise(3))
    flat = assemble.flattened(own)
    assert "Window" not in planned(flat)
    assert [(r.way_id, r.seg_idx, r.idx) for r in flat.orderBy("idx").collect()] == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (2, 1, 3), (2, 0, 4)]
    assert sorted((r.way_id, r.seg_idx, r.idx) for r in assemble.flattened(own.drop("offset")).collect()) == sorted((r.way_id, r.seg_idx, r.idx) for r in flat.collect())
    assert "Join" not in planned(assemble.without_wobbles(flat))


def test_ends_are_taken_before_ways_are_grouped(spark):
    """Geometry isn't moved to find the groups' ways; a way with several rows counts once."""
    line = [{"lat": 40.0, "lon": -80.0}, {"lat": 40.001, "lon": -80.0}]
    row = (1, "Pass", "R1; R2", "primary", None, None, None, None, None, line)
    ways = spark.createDataFrame([row, row], f"way_id long, name string, ref string, highway string, maxspeed string, oneway string, surface string, access string, motor_vehicle string, geometry array<{POINT}>")
    ends = roads.group_ends(ways)
    assert "geometry" not in planned(ends).split("Exchange")[0]
    assert sorted((r.group_key, r.n_segments) for r in ends.collect()) == [("Pass", 1), ("R1", 1), ("R2", 1)]
    assert sorted(r.group_key for r in roads.road_table(ways).collect()) == ["Pass", "R1", "R2"]


def _tables_of_roads(spark, path):
    """Orders and lines of a few roads, some without lines, one that turns on the spot."""
    orders = [(10 * road + k, road, "1-URGENT") for road in range(1, 12) for k in range(6)]
    lines = [(o, 37 * o + n, o % 5 + n, n, 10.0 + n, 1.0 * n) for o, _, _ in orders if o % 10 != 2 for n in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{path}/lineitem.parquet")
    return str(path)


def test_routes_are_those_of_the_sql_and_their_places_are_found_once(spark, tmp_path):
    d = _tables_of_roads(spark, tmp_path)
    want = {}
    for r in adapter.route_points(spark, d).orderBy("request_id", "route_idx", "pt_idx").collect():
        want.setdefault((r.request_id, r.route_idx), []).append((r.lat, r.lon))
    found = adapter.routes(spark, d)
    assert {(r.request_id, r.route_idx): [tuple(p) for p in r.points] for r in found.collect()} == want and len(want) == 33
    assert all(r.duration == 30.0 * len(r.points) for r in found.collect())
    plan = planned(adapter.routes(spark, d))
    assert "Union" not in plan and plan.count("Exchange") <= 3


def test_steps_are_the_segments_without_their_scores(spark, tmp_path):
    ways = adapter.ways(spark, _tables_of_roads(spark, tmp_path))
    found = segments.steps(ways)
    want = segments.exploded(segments.score_ways(ways)).select("way_id", "seg_idx", "start", "end")
    assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect()))
    assert "ASIN" not in planned(found).upper() and "ASIN" in planned(want).upper()


def test_nearest_ways_copy_nodes_and_move_no_matches(spark):
    """Against all pairs, over borders of cells and far to the north; of equals the lowest id."""
    from hairpin.functions import geo
    from hairpin.operators import routes

    rng, probes, nodes = random.Random(8), [], []
    for lat, lon in ((40.0, -80.0), (-0.0001, 0.0001), (84.9999, 19.9999)):
        for i in range(60):
            probes.append((len(probes), (lat + rng.uniform(-0.001, 0.001), lon + rng.uniform(-0.004, 0.004))))
            nodes += [(w, lat + rng.uniform(-0.001, 0.001), lon + rng.uniform(-0.004, 0.004)) for w in (len(nodes), len(nodes) + 1)]
    nodes += [(999, *probes[0][1]), (998, *probes[0][1])]
    points = spark.createDataFrame(probes, f"leg long, mid {POINT}")
    side = spark.createDataFrame(nodes, "way_id long, lat double, lon double")
    met = points.crossJoin(side).withColumn("d", geo.haversine(F.col("mid"), F.struct("lat", "lon"))).where(F.col("d") <= routes.MATCH_M)
    want = {r.leg: r.way_id for r in met.groupBy("leg").agg(F.min_by("way_id", F.struct("d", "way_id")).alias("way_id")).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = routes.nearest_way(points, side, ["leg"])
        assert {r.leg: r.way_id for r in found.collect()} == want and want[0] == 998 and len(want) > 40
        assert planned(found).split("Initial Plan")[-1].count("Exchange") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_region_files_find_places_once(spark, tmp_path, monkeypatch):
    """Ways are named from the orders alone: no geometry is put together for them."""
    from hairpin import queries

    d = _tables_of_roads(spark, tmp_path)
    n = adapter.nodes(spark, d)
    nodes, ways = n.count(), n.select("way_id").distinct().count()
    monkeypatch.setattr(adapter, "ways", None)
    found = queries.region_files(spark, d)
    assert {r.kind: r["count"] for r in found.groupBy("kind").count().collect()} == {"node": nodes, "way": ways, "relation": 11}
