"""Region files and routing responses."""

import json
import random

from hairpin.operators.ways import assemble_geometry, merge_regions, resolve_nodes
from hairpin.operators.routes import decode_polyline, encode_polyline
from hairpin.sources import osm, routing, tiles

REGION = """<?xml version="1.0"?><osm><node id="1" lat="1.5" lon="2.25"/><node id="2" lat="1.6" lon="2.3"><tag k="highway" v="stop"/></node>
<way id="9"><nd ref="2"/><nd ref="1"/><nd ref="77"/><tag k="name" v="A &amp; B"/><tag k="highway" v="tertiary"/></way>
<relation id="5"><member type="way" ref="9" role="outer"/></relation></osm>"""


def test_region_files(spark, tmp_path):
    (tmp_path / "r.osm").write_text(REGION)
    path = f"{tmp_path}/r.osm"
    nodes, ways = osm.read_nodes(spark, path), osm.read_ways(spark, path)
    assert sorted((r.id, r.lat, r.lon, dict(r.tags)) for r in nodes.collect()) == [(1, 1.5, 2.25, {}), (2, 1.6, 2.3, {"highway": "stop"})]
    w = ways.first()
    assert (w.id, w.node_ids, w.tags) == (9, [2, 1, 77], {"name": "A & B", "highway": "tertiary"})
    assert osm.read_relations(spark, path).first().members[0].role == "outer"
    g = assemble_geometry(resolve_nodes(ways, nodes)).first()
    assert [(p.lat, p.lon) for p in g.geometry] == [(1.6, 2.3), (1.5, 2.25)]
    osm.write_nodes(nodes, f"{tmp_path}/out")
    assert sorted(map(str, osm.read_nodes(spark, f"{tmp_path}/out").collect())) == sorted(map(str, nodes.collect()))
    again = nodes.selectExpr("id", "lat + 1 AS lat", "lon", "tags")
    assert sorted((r.id, r.lat) for r in merge_regions(nodes.where("id = 1"), again).collect()) == [(1, 1.5), (2, 2.6)]


def _encode(points, precision=1e6):
    out, last = "", (0, 0)
    for p in points:
        now = tuple(round(x * precision) for x in p)
        for a, b in zip(now, last, strict=True):
            v = (a - b) << 1
            v = ~v if a < b else v
            while v >= 32:
                out += chr((32 | v & 31) + 63)
                v >>= 5
            out += chr(v + 63)
        last = now
    return out


def test_routing_responses(spark):
    a, b = [(1.0, 2.0), (1.1, 2.1)], [(1.1, 2.1), (1.2, 2.0), (1.3, 2.0)]
    leg = lambda p, t: {"shape": _encode(p), "summary": {"time": t, "length": 2.5}, "maneuvers": [{"instruction": "Turn", "time": 3.0, "length": 0.4, "begin_shape_index": 1}, {"instruction": "Arrive", "begin_shape_index": 99}]}
    body = {"trip": {"legs": [leg(a, 60), leg(b, 30)]}, "alternates": [{"trip": {"legs": [leg(b, 10)]}}]}
    rows = routing.read_routes(spark.createDataFrame([(1, json.dumps(body)), (2, "{broken"), (3, None)], "request_id long, response string"))
    got = {r.route_idx: r for r in rows.collect()}
    assert set(got) == {0, 1} and [(p.lat, p.lon) for p in got[0].points] == a + b[1:]
    assert got[0].duration == 90 and got[0].distance == 5000
    assert (got[0].maneuvers[0].location.lat, got[0].maneuvers[1].location.lat) == (1.1, 0.0)
    assert [(r.lat, r.lon) for r in routing.stops(rows.where("route_idx = 0")).orderBy("stop").collect()] == [a[0], a[1], b[2]]
    assert routing.turn_points(rows).count() == 6


def test_names_of_turns_are_cut_between_characters(spark):
    texts = ["x" * k + c * 20 for k in range(36, 42) for c in ("\u00e9", "\u4e2d", "\U0001f600", "\ufffd")] + ["short \u00e9", None, ""]
    m = spark.createDataFrame([(i, 0, [(t, None, None, None, None)]) for i, t in enumerate(texts)], "request_id long, route_idx int, maneuvers array<struct<instruction:string,time:double,length_km:double,location:struct<lat:double,lon:double>,street_names:array<string>>>")
    got = {r.request_id: r.name for r in routing.turn_points(m).collect()}
    assert got == {i: t and t.encode()[:40].decode(errors="ignore") for i, t in enumerate(texts)}


def test_polylines_are_encoded_as_they_are_decoded(spark):
    rng = random.Random(4)
    lines = [[(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(rng.choice([0, 1, 2, 50]))] for _ in range(40)]
    lines += [[(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], [(90.0, 180.0), (-90.0, -180.0)], None]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(lines)], "id long, p array<struct<lat:double,lon:double>>")
    for precision in (1e5, 1e6):
        rows = df.withColumn("text", encode_polyline("p", precision)).withColumn("back", decode_polyline("text", precision)).collect()
        for r in rows:
            if r.p is None:
                assert r.text is None and r.back is None
                continue
            assert r.text == _encode([(p.lat, p.lon) for p in r.p], precision)
            assert [(p.lat, p.lon) for p in r.back] == [(round(p.lat * precision) / precision, round(p.lon * precision) / precision) for p in r.p]
        if precision == 1e5:
            assert rows[40].text == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"


def test_tiles_of_the_table_are_replaced_whole(spark, tmp_path):
    at = f"{tmp_path}/ways"
    schema = "way_id long, lat_idx long, lon_idx long, name string"
    rows = [(i, i % 60 - 30, i % 45 - 20, f"w{i}") for i in range(900)]
    tiles.write_ways(spark.createDataFrame([*rows, (5000, None, None, "nowhere")], schema), at)
    kept = {r[0]: r[1:] for r in rows}
    read = lambda *box: {r.way_id: (r.lat_idx, r.lon_idx, r.name) for r in tiles.read_ways(spark, at, *box).collect()}
    assert read() == kept
    gone = {(-30, -20), (0, 10), (7, 3), (500, 500)}
    new = [(0, -30, -20, "changed"), (7001, 0, 10, "added"), (7002, 1, 1, "of no named tile")]
    for _ in range(2):
        tiles.replace_tiles(spark.createDataFrame(new, schema), at, spark.createDataFrame(sorted(gone) * 2, "lat_idx long, lon_idx long"))
        want = {k: v for k, v in kept.items() if v[:2] not in gone} | {0: (-30, -20, "changed"), 7001: (0, 10, "added")}
        assert read() == want
        assert sorted(map(tuple, tiles.read_tiles(spark, at).collect())) == sorted({v[:2] for v in kept.values()} | gone)
    # a tile that lost all its ways, the last one of its block too, is still known
    everything = spark.createDataFrame([], schema)
    tiles.replace_tiles(everything, at, tiles.read_tiles(spark, at).where("lat_idx < -20"))
    assert read() == {k: v for k, v in want.items() if v[0] >= -20}
    assert tiles.read_tiles(spark, at).where("lat_idx < -20").count() > 20
    tiles.replace_tiles(everything, at, spark.createDataFrame([], "lat_idx long, lon_idx long"))
    # a box reads the folders of its own blocks and no others
    box = (0.0, 0.0, 0.99, 0.99)
    near = {k: v for k, v in want.items() if 0 <= v[0] < 20 and 0 <= v[1] < 20}
    assert near and read(box) == near
    df = tiles.read_ways(spark, at, box)
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    folders = list((tmp_path / "ways").glob("block=*"))
    assert len(folders) > 10 and scan.metrics().get("numFiles").get().value() == len(list((tmp_path / "ways" / "block=0_0").glob("*.parquet")))
