"""Road operators against sequential versions and known shapes."""

import math
import random
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hairpin import queries
from hairpin.functions import geo, tags
from hairpin.operators import assemble, export, rank, routes, segments, waypoints
from hairpin.operators import ways as way_ops
from hairpin.operators.components import connected_components
from hairpin.plans import adapter, reports, roads
from hairpin.sources import tiles

TAGS = "name string, ref string, highway string, maxspeed string, oneway string, surface string, access string, motor_vehicle string"
WAY = f"way_id long, {TAGS}, geometry array<struct<lat:double,lon:double>>"


def hav(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def brg(a, b):
    la, lb, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(lb), math.cos(la) * math.sin(lb) - math.sin(la) * math.cos(lb) * math.cos(d))) % 360


def way(way_id, geometry, name="Pass", highway="secondary", **more):
    row = {"name": name, "ref": None, "highway": highway, "maxspeed": None, "oneway": None, "surface": None, "access": None, "motor_vehicle": None} | more
    return (way_id, *[row[t] for t in ("name", "ref", "highway", "maxspeed", "oneway", "surface", "access", "motor_vehicle")], geometry)


def arc(lat, lon, radius, degrees, n):
    out = []
    for i in range(n):
        t = math.radians(degrees * i / (n - 1))
        out.append((lat + radius * math.cos(t) / 111195.0, lon + radius * math.sin(t) / (111195.0 * math.cos(math.radians(lat)))))
    return out


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pt(lat, lon):
    return geo.point(F.lit(lat), F.lit(lon))


def test_geometry_matches_plain_formulas(spark):
    a, b = (42.36, -72.58), (42.37, -72.55)
    assert one(spark, geo.haversine(pt(*a), pt(*b))) == pytest.approx(hav(a, b), rel=1e-9)
    assert one(spark, geo.bearing(pt(*a), pt(*b))) == pytest.approx(brg(a, b))
    assert one(spark, geo.turn(F.lit(350.0), F.lit(10.0))) == pytest.approx(20)
    assert one(spark, geo.signed_turn(F.lit(10.0), F.lit(350.0))) == pytest.approx(-20)
    assert one(spark, geo.circumradius(pt(0.0, 0.0), pt(0.009, 0.0), pt(0.0045, 0.0078))) == pytest.approx(577, rel=0.02)
    assert one(spark, geo.circumradius(pt(0.0, 5.0), pt(0.0, 5.0), pt(0.1, 5.0))) == float("inf")
    d = one(spark, geo.destination(pt(*a), F.lit(90.0), F.lit(1000.0)))
    assert hav(a, (d.lat, d.lon)) == pytest.approx(1000, rel=1e-6)


@pytest.mark.parametrize(("text", "mph"), [("55", 55.0), ("55 mph", 55.0), ("90 km/h", 55.92339), ("", None), ("none", None), ("walk", None), ("30;50", None), ("signals", None), ("0", None), ("-5", None), (None, None)])
def test_speeds(spark, text, mph):
    found = one(spark, tags.speed_mph(F.lit(text).cast("string")))
    assert found == (None if mph is None else pytest.approx(mph))


def test_filters_are_safe_with_missing_tags(spark):
    rows = [way(1, []), way(2, [], surface="gravel"), way(3, [], access="private"), way(4, [], motor_vehicle="no"), way(5, [], highway="track"), way(6, [], highway=None)]
    assert {r.way_id for r in way_ops.hard_filter(spark.createDataFrame(rows, WAY)).collect()} == {1, 6}
    assert {r.way_id for r in way_ops.drivable_only(spark.createDataFrame(rows, WAY)).collect()} == {1, 2, 3, 4}


def test_arcs_land_in_their_tier(spark):
    rows = [way(1, arc(42.36, -72.58, 50, 180, 8)), way(2, []), way(3, [(1.0, 1.0)]), way(4, [(1.0, 1.0), (1.001, 1.0)]), way(5, arc(42.36, -72.58, 20, 180, 8))]
    got = {r.way_id: r.segments for r in segments.score_ways(spark.createDataFrame(rows, WAY)).collect()}
    assert {s.tier for s in got[1]} == {3} and {s.tier for s in got[5]} == {4}
    assert len(got[2]) == len(got[3]) == 0 and len(got[4]) == 1
    assert got[4][0].radius == float("inf") and got[4][0].score == 0
    assert all(s.score == pytest.approx(s.length * 1.6) for s in got[1])


def test_groups_and_duplicates(spark):
    rows = [way(1, [], ref="A; B;;A"), way(1, [], ref="A; B"), way(2, [], name=None, ref=None), way(3, [], name="A", ref="A")]
    got = sorted((r.group_key, r.way_id) for r in way_ops.grouped(spark.createDataFrame(rows, WAY)).collect())
    assert got == [("A", 1), ("A", 3), ("B", 1), ("Pass", 1)]
    twice = spark.createDataFrame([(1, "b"), (1, "a"), (0, "a"), (0, "b")], "way_id long, tile_key string")
    assert sorted(map(tuple, way_ops.distinct_ways(twice).collect())) == [(0, "a"), (0, "b"), (1, "a")]


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    links = chain + [(1, k) for k in range(2, 30)] + [(50, 51), (51, 52), (52, 50), (70, 70), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(1, 30)} == {1}
    assert {got[k] for k in (50, 51, 52)} == {50} and got[70] == 70 and len(got) == 61 + 29 + 3 + 1


def test_proximity_links_equal_all_pairs(spark):
    rng = random.Random(3)
    ways = [way(i, [(60 + rng.random() * 0.01, 20 + rng.random() * 0.02) for _ in range(2)]) for i in range(1, 60)]
    ends = segments.way_ends(segments.score_ways(way_ops.grouped(spark.createDataFrame(ways, WAY))))
    got = {(r.a, r.b) for r in assemble.proximity_links(ends).collect()}
    want = {(a[0], b[0]) for a in ways for b in ways if a[0] < b[0] and min(hav(p, q) for p in a[-1] for q in b[-1]) <= 100}
    assert got == want and want


def wobbles(segs):
    """One after the other: segs are (start, end, length, score)."""
    score, i = [s[3] for s in segs], 0
    while i < len(segs):
        if score[i] == 0:
            i += 1
            continue
        e, far = i, 0.0
        while e < len(segs) and far < 2400:
            far += segs[e][2]
            e += 1
        change = sum(abs((brg(*segs[j + 1][:2]) - brg(*segs[j][:2]) + 180) % 360 - 180) for j in range(i, e - 1))
        if change < 20:
            score[i:e] = [0.0] * (e - i)
            i = e
        else:
            i += 1
    return score


def straights(tiers, lengths):
    pieces, current, i = [], [], 0
    while i < len(tiers):
        if tiers[i]:
            current.append(i)
            i += 1
            continue
        j = i
        while j < len(tiers) and tiers[j] == 0:
            j += 1
        if sum(lengths[i:j]) > 2414:
            pieces, current = pieces + ([current] if current else []), []
        else:
            current += range(i, j)
        i = j
    return pieces + ([current] if current else [])


def test_wobbles_and_straights_equal_a_sequential_loop(spark):
    rng, rows, plain = random.Random(5), [], {}
    for k in range(40):
        lat, lon, heading, own = 40.0 + k * 0.2, 10.0, 0.0, []
        for i in range(rng.randint(1, 45)):
            heading += rng.choice([0, 0, 0, 1, -1, 4, 30, -25])
            step = rng.choice([0.0, 80.0, 300.0, 900.0])
            end = (lat + step * math.cos(math.radians(heading)) / 111195, lon + step * math.sin(math.radians(heading)) / 85000)
            tier = rng.choice([0, 0, 1, 2])
            length = hav((lat, lon), end)
            own.append(((lat, lon), end, length, length * tier, tier))
            rows.append((k, 0, 0, i, i + 1, (lat, lon), end, 1.0, tier, float(tier), length, length * tier))
            lat, lon = end
        plain[k] = own
    flat = spark.createDataFrame(rows, "road long, component int, chunk int, idx int, way_id long, start struct<lat:double,lon:double>, end struct<lat:double,lon:double>, radius double, tier int, weight double, length double, score double")
    got = {(r.road, r.idx): r.score for r in assemble.without_wobbles(flat, "road").collect()}
    for k, own in plain.items():
        assert [got[k, i] for i in range(len(own))] == wobbles([s[:4] for s in own]), k
    split = {}
    for r in assemble.split_straights(flat, "road").orderBy("road", "idx").collect():
        split.setdefault(r.road, {}).setdefault(r.piece, []).append(r.idx)
    for k, own in plain.items():
        assert list(split.get(k, {}).values()) == straights([s[4] for s in own], [s[2] for s in own]), k


def _row(way_id, a, b, oneway=False):
    back = (brg(b, a), brg(b, a))
    return {"way_id": way_id, "a": a, "b": b, "oneway": oneway, "entry": brg(a, b), "exit": brg(a, b), "back_entry": back[0], "back_exit": back[1]}


def test_chains(spark):
    p = [(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)]
    ways = [_row(1, p[1], p[0]), _row(2, p[1], p[2]), _row(3, p[3], p[2]), _row(4, p[3], p[4])]
    assert assemble.chain(ways) == [(1, 0, True), (2, 1, False), (3, 2, True), (4, 3, False)]
    # a oneway isn't run backwards, and its end isn't a start
    assert assemble.chain([_row(1, p[1], p[0], True), _row(2, p[2], p[1])]) == [(2, 0, False), (1, 1, False)]
    # straight on rather than round the corner
    fork = [_row(1, (0, 0), (0, 1)), _row(2, (0, 1), (1, 1)), _row(3, (0, 1), (0, 2))]
    assert [w for w, _, _ in assemble.chain(fork)] == [1, 3, 2]


def _winding(lat, lon, n=6):
    out, at = [], (lat, lon)
    for k in range(n):
        part = arc(at[0], at[1], 45, 170 if k % 2 else -170, 10)
        shift = (at[0] - part[0][0], at[1] - part[0][1])
        part = [(a + shift[0], b + shift[1]) for a, b in part]
        out += part if not out else part[1:]
        at = out[-1]
    return out


def test_road_table_is_the_same_for_any_partitioning(spark):
    line = _winding(42.0, -72.0, 24)
    ways = [way(k + 1, line[k * 30 : k * 30 + 31], maxspeed="55 mph") for k in range(len(line) // 30 + 1)] + [way(90, [(45.0, 3.0), (45.1, 3.0)], name="Far")]
    df = spark.createDataFrame(ways, WAY)
    rows = [sorted(map(str, roads.road_table(df.repartition(n)).collect())) for n in (1, 5)]
    assert rows[0] == rows[1]
    table = roads.road_table(df)
    r = table.where("group_key = 'Pass'").collect()
    ids = [w[0] for w in ways[:-1] if len(w[-1]) > 1]
    # the chain begins at its southernmost end
    assert len(r) == 1 and r[0].way_ids in (ids, ids[::-1]) and r[0].penalty_factor == 0.9
    assert r[0].total_length == pytest.approx(sum(hav(a, b) for a, b in zip(line, line[1:], strict=False)), rel=1e-6)
    assert [x.group_key for x in roads.published(table, min_score=10, min_mph=50).collect()] == ["Pass"]
    assert roads.published(table, min_score=10, min_mph=60).count() == 0
    kml = export.kml_folders(table.where("group_key = 'Pass'")).first().folder
    assert kml.startswith("<Folder><name>Pass</name>") and "#tier3" in kml and kml.count("<Placemark>") >= 1
    feature = export.road_features(table.where("group_key = 'Pass'")).first().feature
    assert '"type":"MultiLineString"' in feature and '"max_speed_mph":5' in feature
    assert export.segment_features(table, df).count() == sum(len(x.segments) for x in table.collect())


def test_routes(spark):
    read = lambda texts: [None if x is None else [(p["lat"], p["lon"]) for p in x] for x in routes.decoded(pa.array(texts, pa.string()), 1e5).to_pylist()]
    sample = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]
    # a line that is cut off within a number, or after a latitude, ends before it
    assert read(["_p~iF~ps|U_ulLnnqC_mqNvxq`@", None, "", "_p~iF~ps|U_ulLnnqC_mqNvx", "_p~iF~ps|U_ulL", "_"]) == [sample, None, [], sample[:2], sample[:1], []]
    decoded = spark.createDataFrame([("_p~iF~ps|U",), (None,)], "s string").select(routes.decode_polyline(F.col("s")).alias("p")).collect()
    assert decoded[0].p[0].lat == 38.5 and decoded[1].p is None
    straight = [(45.0, -122.0), (45.01, -122.0), (45.02, -122.0)]
    corner = [(45.0, -122.0), (45.01, -122.0), (45.01, -121.99)]
    r = spark.createDataFrame([(1, 0, straight, 100.0), (1, 1, corner, 300.0), (1, 2, [], 400.0)], "request_id long, route_idx int, points array<struct<lat:double,lon:double>>, duration double")
    s = {x.route_idx: x for x in routes.route_stats(r).collect()}
    assert s[0].score == pytest.approx(0, abs=1e-6) and s[1].score > 30 and s[2].score == 0
    pick = lambda t: [x.route_idx for x in routes.choose(routes.route_stats(r).where("route_idx < 2"), t).where("selected").collect()]
    assert pick(0.0) == [0] and pick(1.0) == [1]
    good = spark.createDataFrame([way(1, straight, highway="motorway"), way(2, corner, highway="residential", access="private")], WAY)
    a = {x.route_idx: x for x in routes.quality_adjusted(routes.route_stats(r), good).collect()}
    assert a[0].through_penalty == 0.0 and a[2].disqualified is None and not a[2].warning  # midpoints lie far from nodes


def test_tiles_and_quarantine(spark, tmp_path):
    (tmp_path / "tile_a.json").write_text('{"elements":[{"id":7,"tags":{"name":"X","highway":"tertiary"},"geometry":[{"lat":1.0,"lon":2.0},{"lat":1.01,"lon":2.0}]}]}')
    (tmp_path / "tile_b.json").write_text('{"elements":[],"remark":"timed out"}')
    (tmp_path / "tile_c.json").write_text("{broken")
    docs = tiles.read_documents(spark, str(tmp_path))
    assert {r.tile_key: r.status for r in docs.collect()} == {"tile_a": "loaded", "tile_b": "failed", "tile_c": "corrupt"}
    ways = tiles.ways_of(docs).collect()
    assert [(w.way_id, w.name, w.lat_idx) for w in ways] == [(7, "X", 20)]
    loaded = docs.where("status = 'loaded'")
    done = loaded.select("tile_key", "raw_hash").withColumn("params_hash", F.lit("p"))
    assert tiles.changed(loaded, done, "p").count() == 0 and tiles.changed(loaded, done, "q").count() == 1 and tiles.changed(loaded, done, "p", force=True).count() == 1


def test_waypoints_are_repeatable_and_spaced(spark):
    line = _winding(42.0, -72.0, 24)
    table = roads.road_table(spark.createDataFrame([way(1, line), way(2, _winding(42.05, -72.0, 24), name="Other")], WAY))
    req = spark.createDataFrame([(1, 42.0, -72.0, 20.0, 1, 5), (2, 0.0, 0.0, 20.0, 3, 5)], "request_id long, lat double, lon double, radius_km double, n int, seed long")
    a, b = (waypoints.sampled(req, table).collect() for _ in range(2))
    assert a == b and len(a) == 1


def test_each_customer_asks_for_waypoints_near_it(spark):
    req = waypoints.requests_of(spark.range(1, 121).withColumnRenamed("id", "c_custkey"))
    places = {r.request_id: (r.lat, r.lon) for r in req.collect()}
    assert set(places) == set(range(1, 121)) and len({round(lat, 3) for lat, _ in places.values()}) == 50
    table = roads.road_table(spark.createDataFrame([way(k, _winding(35.0 + k % 50 * 0.2, -85.0 + k // 50 * 0.2, 24), name=f"Road {k}") for k in range(1, 121, 4)], WAY)).cache()
    mids = {(r.group_key, r.sub_index): (r.mid, r.penalized_score) for r in table.where(f"penalized_score > 0 AND total_length >= {waypoints.MIN_ROAD_M}").select("group_key", "sub_index", "penalized_score", waypoints.road_midpoint().alias("mid")).collect()}
    near = {(q, k): hav(at, mid) for q, at in places.items() for k, (mid, _) in mids.items() if hav(at, mid) <= 30_000}
    assert {(r.request_id, (r.group_key, r.sub_index)) for r in waypoints.eligible(req, table).collect()} == set(near)
    u = {(q, k): (int(sha256(f"{q * 31}/{k[0]}/{k[1]}".encode()).hexdigest()[:12], 16) + 1) / ((1 << 48) + 1) for q, k in near}
    want = set()
    for q, at in places.items():
        drawn = sorted((k for p, k in near if p == q), key=lambda k: -math.log(u[q, k]) / mids[k][1])[:4]
        want |= {(q, stop, *k) for stop, k in enumerate(sorted(drawn, key=lambda k: brg(at, mids[k][0])), 1)}
    assert {(r.request_id, r.stop, r.group_key, r.sub_index) for r in waypoints.sampled(req, table).collect()} == want
    assert len({q for q, *_ in want}) > 100


def test_corridor_takes_all_routes(spark, tmp_path):
    rng = random.Random(3)
    orders = [(k, 1 + k % 3, "2-HIGH") for k in range(1, 13)]
    lines = [(k, n, rng.randrange(200), rng.randrange(50), float(rng.randint(1, 50)), 1.0) for k, _, _ in orders for n in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    legs = [(a, b) for r in adapter.routes(spark, str(tmp_path)).collect() for a, b in zip(r.points, r.points[1:])]

    def away(m):
        best = math.inf
        for a, b in legs:
            dx, dy = b.lon - a.lon, b.lat - a.lat
            t = max(0.0, min(1.0, ((m.lon - a.lon) * dx + (m.lat - a.lat) * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            best = min(best, hav(m, (a.lat + t * dy, a.lon + t * dx)))
        return best

    found = segments.exploded(segments.score_ways(adapter.ways(spark, str(tmp_path)))).select("way_id", "seg_idx", geo.midpoint(F.col("start"), F.col("end")).alias("mid")).collect()
    want = sorted((r.way_id, r.seg_idx) for r in found if away(r.mid) <= routes.CORRIDOR_M)
    assert want and sorted((r.way_id, r.seg_idx) for r in queries.corridor_segments(spark, str(tmp_path)).collect()) == want


def test_a_chunk_of_which_nothing_stays_is_an_empty_road(spark):
    straight = [(40.0 + 0.01 * i, -72.0) for i in range(6)]
    bend = arc(40.3, -72.0, 50, 180, 10)
    df = spark.createDataFrame([way(1, straight, "X"), way(2, bend, "X")], WAY)
    rows = roads.road_table(df).orderBy("sub_index").select("sub_index", "way_ids", "total_length", "penalty_factor", F.size("segments").alias("n"), assemble.display_name().alias("name")).collect()
    assert [(r.sub_index, r.way_ids, r.n, r.name) for r in rows] == [(0, [], 0, "X"), (1, [2], 9, "X (2)")]
    assert rows[0].total_length == 0 and rows[0].penalty_factor == 1
    assert [r.group_key for r in roads.published(roads.road_table(df), min_length=0.1).collect()] == ["X"]


def test_of_a_ways_rows_the_lowest_tile_wins(spark):
    df = spark.createDataFrame([(1, "A", "c", 3), (1, "A", "a", 1), (1, "A", "b", 2)], "way_id long, name string, tile_key string, v int").withColumn("ref", F.lit(None).cast("string"))
    assert [(r.tile_key, r.v) for r in way_ops.grouped(df).collect()] == [("a", 1)]


def test_ends_and_segments_are_of_one_copy(spark):
    old, new = arc(40.0, -72.0, 50, 180, 12), arc(40.0, -72.0, 200, 90, 30)
    rows = [(*way(1, old, "Old name"), "b"), (*way(1, new, "New name"), "a"), (*way(2, old, "Both"), "b"), (*way(2, new, "Both"), "a"), (*way(1, old, "New name"), "c")]
    df = spark.createDataFrame(rows, f"{WAY}, tile_key string")
    for n in (1, 3):
        table = roads.road_table(df.repartition(n)).collect()
        assert {r.group_key: len(r.segments) for r in table} == {"Old name": 11, "New name": 29, "Both": 29}
    totals = {(r.group_key, r.stage): r.n_segments for r in reports.stage_report(df, 0.0, 0.0).collect()}
    assert all(totals[g, s] == n for g, n in (("Old name", 11), ("New name", 29)) for s in ("tile_cache", "scoring", "ordering", "deflection_filter"))
    assert {r.group_key: r.n_nodes for r in reports.continuity(df).collect()} == {"Old name": 12, "New name": 30, "Both": 30}


def test_raw_ways_keep_their_place_in_the_palette(spark):
    lines = [way(k, [(40.0, -72.0)] if k == 2 else [(40.0, -72.0 + k), (40.1, -72.0)], "A & B" if k == 1 else None, ref="R1" if k == 3 else None) for k in range(1, 15)]
    found = {r.way_id: r for r in export.raw_way_folders(spark.createDataFrame(lines, WAY).withColumns({"group_key": F.lit("g"), "pos": F.col("way_id")})).collect()}
    assert 2 not in found and len(found) == 13
    assert all(f"<color>{export.PALETTE[(k - 1) % 12]}</color>" in r.folder and r.seq == k - 1 for k, r in found.items())
    assert "<name>Way 1</name><description>name=A &amp; B | ref= | highway=secondary | nodes=2</description>" in found[1].folder and "name= | ref=R1 |" in found[3].folder


def test_kml_is_framed_and_read_back(spark):
    df = spark.createDataFrame([way(7, arc(40.0, -72.0, 50, 180, 8), "Pine & <Hill>"), way(8, [(41.0, -72.0), (41.001, -72.0)], "Oak")], WAY)
    table = roads.road_table(df)
    folders = export.kml_folders(table)
    document = export.kml_documents(folders.select(F.lit(1).alias("k"), F.col("group_key").alias("seq"), "folder"), "k").first().document
    assert document.count("<Folder>") == 2 and all(f'<Style id="tier{t}">' in document for t in range(5)) and document.endswith("</Document></kml>")
    found = {r.name: r for r in export.folder_entries(folders).collect()}
    assert found["Pine & <Hill>"].way_ids == [7] and found["Pine & <Hill>"].n_points >= 8
    assert found["Oak"].first.lat == 41.0 and found["Oak"].north == pytest.approx(41.001) and export.folder_entries(folders, "Pine").count() == 1
    raw = export.raw_way_folders(df.withColumns({"group_key": F.lit("g"), "pos": F.col("way_id")}))
    assert {r.way_id: r.folder[r.folder.index("<color>") + 7 :][:8] for r in raw.collect()} == {7: export.PALETTE[0], 8: export.PALETTE[1]}


def test_gpx_has_waypoints_before_the_track(spark):
    points = [(1.0, 2.0), (1.5, 2.5)]
    df = spark.createDataFrame([(1, 0, points, [("A&B", None, 1.0, 2.0)]), (2, 0, points, None)], "request_id long, route_idx int, points array<struct<lat:double,lon:double>>, waypoints array<struct<name:string,description:string,lat:double,lon:double>>")
    a, b = (r.document for r in export.gpx_documents(df, F.lit("N"), F.lit("D")).orderBy("request_id").collect())
    assert 'creator="hairpin"' in a and '<wpt lat="1.000000" lon="2.000000"><name>A&amp;B</name></wpt><trk><name>N</name><desc>D</desc>' in a and "<wpt" not in b
    assert "<coordinates>2.000000,1.000000,0 2.500000,1.500000,0</coordinates>" in export.route_kml(df, F.lit("N")).first().document


def test_sums_of_roads_are_those_of_their_segments(spark):
    """The table without segments says of each road what the one with them does, and holds none on the way."""
    lines = [_winding(42.0 + 0.3 * k, -72.0, 24) for k in range(3)] + [[(43.0 + 0.01 * k, -72.0) for k in range(9)]]
    df = spark.createDataFrame([way(k + 1, line, name="A" if k < 2 else f"N{k}") for k, line in enumerate(lines)], WAY)
    box = (42.0, -72.5, 42.2, -71.5)
    sums = roads.road_sums(df, inside=rank.touches_box(F.col("start"), F.col("end"), *box))
    assert "segments" not in sums.columns and "collect_list(struct(idx" not in sums._jdf.queryExecution().analyzed().toString()
    table = roads.road_table(df)
    both = ["group_key", "sub_index", "way_ids", "highway_types", "way_speeds", "total_length", "total_score", "penalized_score", "penalty_factor"]
    near = lambda rows: sorted(str([round(x, 6) if isinstance(x, float) else x for x in r][:4]) + str([round(x, 6) for x in r[5:]]) for r in rows)
    assert near(sums.select(both).collect()) == near(table.select(both).collect())
    assert sorted((r.group_key, r.sub_index, r.n_segments) for r in sums.collect()) == sorted((r.group_key, r.sub_index, len(r.segments)) for r in table.collect())
    assert sorted(map(str, rank.road_boxes(sums).collect())) == sorted(map(str, rank.road_boxes(table).collect()))
    keys = lambda t: sorted((r.group_key, r.sub_index) for r in t.collect())
    assert keys(sums.where("inside")) == keys(rank.roads_in_box(table, *box))
    assert 0 < sums.where("inside").count() < sums.count() and sums.where("n_segments = 0").count() == 1
    # fewer fields of segments, the same roads
    few = roads.road_table(df, fields=("start", "end"))
    assert sorted(map(str, waypoints.midpoints(few).collect())) == sorted(map(str, waypoints.midpoints(table).collect()))
    # places of roads without their segments, which don't come where roads are counted
    placed = roads.road_table(df, fields=("start", "end"), **waypoints.places())
    assert "segments" not in placed.columns and sorted(map(str, waypoints.midpoints(placed).collect())) == sorted(map(str, waypoints.midpoints(table).collect()))


def _mixed():
    """A straight road, one with straights at both ends and between, one with a gap, and one of a single point."""
    straight = lambda lat, lon, n=6: [(lat + 0.01 * i, lon) for i in range(n)]
    bends = [arc(40.3 + 0.2 * k, -72.0, 50, 180, 10) for k in range(3)]
    parts = [straight(40.0, -73.0), straight(40.35, -72.0), bends[0], straight(40.9, -72.0)]
    rows = [way(1, parts[0], "X"), way(2, bends[0], "X"), way(3, parts[0] + bends[0] + [(40.36, -72.0), (40.39, -72.0)] + bends[1] + straight(40.6, -72.0), "Y"), way(4, bends[2], "Y"), way(5, [(40.0, -72.0)], "Z")]
    return [*rows, way(6, bends[1], None, ref="R1; R2"), way(7, bends[1], "X", ref="R1")]


def test_numbered_segments_are_those_of_the_roads(spark):
    df = spark.createDataFrame(_mixed(), WAY)
    table = roads.road_table(df)
    want = table.select("group_key", "sub_index", F.inline("segments")).select("group_key", "sub_index", "idx", "way_id", "start", "end", "tier", "length", "score")
    found = roads.numbered_segments(df)
    assert sorted(map(repr, found.select(want.columns).collect())) == sorted(map(repr, want.collect())) and table.agg(F.max("sub_index")).first()[0] == 2
    # the same features, of segments that were never an array
    features = export.numbered_features(found)
    assert sorted(map(tuple, features.collect())) == sorted(map(tuple, export.segment_features(table, df).collect()))
    assert "collect_list(struct(idx" not in features._jdf.queryExecution().optimizedPlan().toString()


def test_stages_are_summed_by_way_and_keep_no_table(spark):
    from hairpin.plans.lineage import shared_folder

    df = spark.createDataFrame(_mixed(), WAY)
    folder = Path(shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = {p.name for p in folder.glob("hairpin-*")}
    report = reports.stage_report(df, 0.0, 0.0)
    assert len({p.name for p in folder.glob("hairpin-*")} - before) == 1
    found = {(r.group_key, r.stage): r for r in report.collect()}
    for r in roads.road_table(df).groupBy("group_key").agg(F.count("*").alias("n"), F.sum(F.size("segments")).alias("s"), F.sum("total_length").alias("l"), F.sum("total_score").alias("t")).collect():
        stage = found[r.group_key, "straight_gap_split"]
        assert (stage.n_parts, stage.n_segments) == (r.n, r.s) and stage.length == pytest.approx(r.l) and stage.score == pytest.approx(r.t)
        assert found[r.group_key, "penalties"].n_parts == r.n and found[r.group_key, "penalties"].n_segments == r.s
    quiet = found["Y", "deflection_filter"]
    assert (quiet.n_ways, quiet.n_segments, quiet.length) == (2, found["Y", "ordering"].n_segments, pytest.approx(found["Y", "ordering"].length))


def test_a_line_stands_for_a_roads_segments(spark):
    df = spark.createDataFrame(_mixed(), WAY)
    small = roads.road_table(df, fields=("start", "end"), line=export.line(), stops=waypoints.road_stops(F.col("segments")))
    assert "segments" not in small.columns
    whole = roads.road_table(df)
    assert sorted(map(tuple, export.kml_folders(small, by_tier=False).collect())) == sorted(map(tuple, export.kml_folders(whole, by_tier=False).collect()))
    stops = [waypoints.dense(t.withColumnRenamed("sub_index", "step"), "group_key") for t in (small, whole)]
    assert sorted(map(tuple, stops[0].collect())) == sorted(map(tuple, stops[1].collect()))
