"""SQL for the registered queries, written for another engine over the same tables.

Shared parts are common table expressions that each text picks from PARTS.
"""

from __future__ import annotations

import re

from hairpin.functions import tags
from hairpin.operators import export
from hairpin.plans import adapter
from hairpin.queries import BOX, TILE, TWIST

INF = "CAST('Infinity' AS DOUBLE)"


def hav(a: str, b: str, c: str, d: str) -> str:
    """Metres between (lat a, lon b) and (lat c, lon d)."""
    h = f"(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(12742000.0 * asin(least(sqrt({h}), 1.0)))"


def brg(a: str, b: str, c: str, d: str) -> str:
    y = f"sin(radians({d} - {b})) * cos(radians({c}))"
    x = f"(cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))"
    return f"mod(degrees(atan2({y}, {x})) + 360.0, 360.0)"


def six(x: str) -> str:
    """A coordinate in units of 1e-7 degrees as text with six places, halves away from zero."""
    tens = f"((abs({x}) + 5) // 10)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({tens} // 1000000 AS VARCHAR) || '.' || lpad(CAST({tens} % 1000000 AS VARCHAR), 6, '0'))"


def adiff(a: str, b: str) -> str:
    return f"abs(mod({b} - {a} + 540.0, 360.0) - 180.0)"


def _in(column: str, values: list[str]) -> str:
    return f"coalesce({column} IN ({', '.join(repr(v) for v in values)}), false)"


REJECTED = " OR ".join([_in("surface", tags.NO_SURFACE), _in("access", tags.NO_ACCESS), _in("highway", tags.NO_HIGHWAY)])
TIER = "CASE " + " ".join(f"WHEN radius < {a} THEN {t}" for a, t, _ in tags.TIERS) + " ELSE 0 END"
WEIGHT = "CASE " + " ".join(f"WHEN radius < {a} THEN {w}" for a, _, w in tags.TIERS) + " ELSE 0.0 END"
FACTOR = "CASE highway " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tags.HIGHWAY_FACTOR.items()) + " ELSE 1.0 END"
MPH = f"""CASE WHEN regexp_matches(trim(maxspeed), '^[0-9.]+( km/h| mph)?$') THEN
  CASE WHEN trim(maxspeed) LIKE '% km/h' THEN CAST(regexp_extract(trim(maxspeed), '^[0-9.]+') AS DOUBLE) * {tags.KMH_TO_MPH} ELSE CAST(regexp_extract(trim(maxspeed), '^[0-9.]+') AS DOUBLE) END END"""
LEVEL = "CASE WHEN s < 0 THEN 0 ELSE CAST(round(510 * (1 - pow(10.0, -0.75 * least(s / 8000.0, 1.0)))) AS BIGINT) + 1 END"
KML = "CASE WHEN level <= 0 THEN 'F000E010' WHEN level <= 256 THEN 'FF00' || printf('%02X', 256 - level) || 'FF' ELSE 'FF' || printf('%02X', CAST(floor((level - 257) * 255 / 254.0) AS BIGINT)) || '00FF' END"
S, W, N, E = BOX[0], BOX[1], BOX[2], BOX[3]

def _wobbles(x: str, base: str) -> dict[str, tuple[str, list[str]]]:
    """Parts named after ``x`` that zero the wobbles of ``base``, by a walk from one firing window to the next that begins beyond it."""
    by = "group_key, component, chunk"
    same = lambda a, b: f"{a}.group_key = {b}.group_key AND {a}.component = {b}.component AND {a}.chunk = {b}.chunk"
    return {
        f"{x}head": (f"SELECT *, {brg('lat', 'lon', 'lat1', 'lon1')} AS hd, coalesce(sum(length) OVER (PARTITION BY {by} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS gone FROM {base}", [base]),
        f"{x}turn": (f"SELECT *, sum(t) OVER (PARTITION BY {by} ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS turned, max(idx) OVER (PARTITION BY {by} ORDER BY gone RANGE BETWEEN CURRENT ROW AND CAST(2399.9999999999995 AS DOUBLE) FOLLOWING) AS e FROM (SELECT *, coalesce({adiff(f'lag(hd) OVER (PARTITION BY {by} ORDER BY idx)', 'hd')}, 0.0) AS t FROM {x}head)", [f"{x}head"]),
        f"{x}fire": (f"SELECT a.group_key, a.component, a.chunk, a.idx, a.e FROM {x}turn a JOIN {x}turn b ON {same('a', 'b')} AND b.idx = a.e WHERE a.score <> 0 AND b.turned - a.turned < 20", [f"{x}turn"]),
        f"{x}next": (f"SELECT a.group_key, a.component, a.chunk, a.idx, a.e, min(b.idx) AS nx FROM {x}fire a LEFT JOIN {x}fire b ON {same('a', 'b')} AND b.idx > a.e GROUP BY a.group_key, a.component, a.chunk, a.idx, a.e", [f"{x}fire"]),
        f"{x}walk": (
            f"SELECT n.group_key, n.component, n.chunk, n.idx, n.e, n.nx FROM {x}next n JOIN (SELECT {by}, min(idx) AS idx FROM {x}next GROUP BY {by}) m ON {same('n', 'm')} AND n.idx = m.idx UNION ALL SELECT n.group_key, n.component, n.chunk, n.idx, n.e, n.nx FROM {x}walk w JOIN {x}next n ON {same('n', 'w')} AND n.idx = w.nx",
            [f"{x}next"],
        ),
        f"{x}zero": (f"SELECT {by}, unnest(range(idx, e + 1)) AS idx FROM {x}walk", [f"{x}walk"]),
        f"{x}quiet": (
            f"SELECT b.* REPLACE (CASE WHEN z.idx IS NULL THEN b.score ELSE 0.0 END AS score, CASE WHEN z.idx IS NULL THEN b.tier ELSE 0 END AS tier), b.score AS was FROM {base} b LEFT JOIN {x}zero z ON {same('b', 'z')} AND z.idx = b.idx",
            [base, f"{x}zero"],
        ),
    }


def _split(base: str) -> str:
    """The segments of ``base`` with long (in a straight run that is cut out), none (stands for a chunk of which nothing stays) and piece."""
    by = "group_key, component, chunk"
    return f"""SELECT *, CASE WHEN none THEN 0 ELSE CAST(sum(CASE WHEN long AND first THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY idx) AS BIGINT) END AS piece FROM (
      SELECT *, bool_and(long) OVER (PARTITION BY {by}) AND idx = 0 AS none FROM (
        SELECT *, tier = 0 AND sum(length) OVER (PARTITION BY {by}, run) > 2414 AS long FROM (
          SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY {by} ORDER BY idx) AS run FROM (
            SELECT *, coalesce(lag(tier = 0) OVER (PARTITION BY {by} ORDER BY idx) <> (tier = 0), true) AS first FROM {base}))))"""


RADIUS_M, BUDGET_S, RIDE_MPS = 30000, 5400.0, 35.0 * 1609.34 / 3600.0
OFF = adiff("axis", "bearing")


def draw(*parts: str) -> str:
    """48 bits of a hash of the parts as a whole number."""
    return f"CAST('0x' || left(sha256({" || '/' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)}), 12) AS BIGINT)"


def cell_of(lat: str, lon: str) -> str:
    return f"(CAST(floor(({lat} - olat) * 111000.0 / 500.0) AS BIGINT) * 4294967296 + CAST(floor(({lon} - olon) * 111000.0 * cos(radians(olat)) / 500.0) AS BIGINT))"


def path_of(lat: str, lon: str, to_lat: str, to_lon: str, rows: str) -> str:
    """``rows`` with path: the cells of points from one place to another."""
    d = "(way * i / steps / 6371000.0)"
    la = f"radians({lat})"
    lb = f"asin(sin({la}) * cos({d}) + cos({la}) * sin({d}) * cos(radians(hd)))"
    lo = f"degrees(radians({lon}) + atan2(sin(radians(hd)) * sin({d}) * cos({la}), cos({d}) - sin({la}) * sin({lb})))"
    return f"""SELECT *, list_transform(range(0, steps + 1), lambda i: CASE WHEN i = 0 THEN {cell_of(lat, lon)} ELSE {cell_of(f"degrees({lb})", lo)} END) AS path FROM (
      SELECT *, greatest(CAST(floor(way / 250.0) AS BIGINT), 1) AS steps FROM (SELECT *, {hav(lat, lon, to_lat, to_lon)} AS way, {brg(lat, lon, to_lat, to_lon)} AS hd FROM ({rows})))"""


def moved_by(rows: str) -> str:
    """The state of rides after the roads that ``rows`` chose."""
    return f"""SELECT request_id, step, group_key, sub_index, rev AS reversed, olat, olon, xlat AS clat, xlon AS clon, used + connector + seconds AS used, {brg('clat', 'clon', 'xlat', 'xlon')} AS heading,
      list_distinct(list_concat(driven, list_concat(line, path))) AS driven, list_append(taken, group_key || '/' || sub_index) AS taken
      FROM (SELECT x.*, CASE WHEN rev THEN flat ELSE llat END AS xlat, CASE WHEN rev THEN flon ELSE llon END AS xlon, list_transform(pts, lambda p: {cell_of('p.lat', 'p.lon')}) AS line
        FROM (SELECT *, {hav('clat', 'clon', 'llat', 'llon')} < {hav('clat', 'clon', 'flat', 'flon')} AS rev FROM ({rows})) x JOIN rline ON rline.group_key = x.group_key AND rline.sub_index = x.sub_index)"""


def _rides() -> str:
    to = {k: hav("clat", "clon", f"{k}lat", f"{k}lon") for k in "mflo"}
    near = f"""SELECT s.*, w.step + 1 AS step, w.clat, w.clon, w.used, w.heading, w.driven, w.taken FROM ridewalk w JOIN cand s ON s.request_id = w.request_id
      WHERE w.used < 0.85 * {BUDGET_S} AND NOT list_contains(w.taken, s.group_key || '/' || s.sub_index)"""
    near = f"SELECT *, {to['m']} AS to_m, {to['f']} AS to_f, {to['l']} AS to_l, {to['o']} AS to_o, used <= 0.4 * {BUDGET_S} AS out FROM ({near})"
    near = f"SELECT *, least(to_m, to_f, to_l) / {RIDE_MPS} AS connector, CASE WHEN to_l < to_f THEN {hav('flat', 'flon', 'olat', 'olon')} ELSE {hav('llat', 'llon', 'olat', 'olon')} END / {RIDE_MPS} AS home, {brg('olat', 'olon', 'clat', 'clon')} AS gone FROM ({near})"
    near = f"SELECT * FROM ({near}) WHERE NOT (out AND (away < 0.8 * to_o OR (to_o > 500 AND {adiff('gone', 'bearing')} > 120))) AND used + connector + seconds + home <= {BUDGET_S}"
    near = f"SELECT *, (mod(hd - heading + 540.0, 360.0) - 180.0) * sweep AS delta, len(list_filter(path, lambda c: list_contains(driven, c))) / len(path) AS overlap FROM ({path_of('clat', 'clon', 'mlat', 'mlon', near)})"
    score = "ps / (1 + ln(1 + connector)) * CASE WHEN delta < 0 THEN 0.3 ELSE 1 + 0.5 * exp(-delta / 30) END * (1 - 0.7 * overlap) * CASE WHEN NOT out AND to_o > 0 THEN greatest(1 + (to_o - away) / to_o, 0.5) ELSE 1 END"
    best = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(ln(greatest({score}, 1e-300)), 9) DESC, group_key, sub_index) AS r FROM ({near})) WHERE r = 1"
    first = f"SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(ln(greatest(1 / CASE WHEN away = 0 THEN 1 ELSE away END * (1 + cos(radians({OFF}))), 1e-300)), 9) DESC, group_key, sub_index) AS r FROM cand"
    first = f"SELECT *, CAST(0 AS BIGINT) AS step, olat AS clat, olon AS clon, 0.0::DOUBLE AS used, 0.0::DOUBLE AS connector, CAST([] AS BIGINT[]) AS driven, CAST([] AS VARCHAR[]) AS taken FROM ({first}) WHERE r = 1"
    return f"{moved_by(path_of('clat', 'clon', 'mlat', 'mlon', first))} UNION ALL {moved_by(best)}"


def _sector(rungs: list[int], enough: int, last: str) -> str:
    """Rows of ``elig`` with an axis, within the narrowest arc that holds enough."""
    arc = " ".join(f"WHEN count(*) FILTER ({OFF} <= {a / 2}) OVER (PARTITION BY request_id) >= {enough} THEN {a}" for a in rungs)
    return f"SELECT * FROM (SELECT *, CASE {arc} ELSE {last} END AS arc FROM (SELECT *, {draw('seed', "'axis'")} / 281474976710656.0 * 360.0 AS axis FROM elig)) WHERE {OFF} <= arc / 2"


LOT = f"ln(({draw('seed', 'group_key', 'sub_index')} + 1.0) / 281474976710657.0) / ps"
LOBE_SIDE = "mod(bearing - axis + 540.0, 360.0) - 180.0 < 0"
DENSE_KEY = "CAST(trunc(lat * 10000) AS BIGINT) || '_' || CAST(trunc(lon * 10000) AS BIGINT)"


PARTS: dict[str, tuple[str, list[str]]] = {
    "nodes": (adapter.NODES_SQL.format(lineitem="lineitem", orders="orders"), []),
    "tag": (adapter.TAGS_SQL.format(orders="orders"), []),
    "n": ("SELECT way_id, road, node_idx, lat7 / 1e7 AS lat, lon7 / 1e7 AS lon FROM nodes", ["nodes"]),
    "kept": (f"SELECT * FROM tag WHERE NOT ({REJECTED})", ["tag"]),
    "step": (
        "SELECT way_id, road, node_idx, lat, lon, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1, lead(lat, 2) OVER w AS lat2, lead(lon, 2) OVER w AS lon2 FROM n WINDOW w AS (PARTITION BY way_id ORDER BY node_idx)",
        ["n"],
    ),
    "side": (f"SELECT *, {hav('lat1', 'lon1', 'lat2', 'lon2')} AS x, {hav('lat', 'lon', 'lat2', 'lon2')} AS y, {hav('lat', 'lon', 'lat1', 'lon1')} AS z FROM step WHERE lat1 IS NOT NULL", ["step"]),
    "area": ("SELECT *, sqrt(greatest((x+y+z)/2 * ((x+y+z)/2 - x) * ((x+y+z)/2 - y) * ((x+y+z)/2 - z), 0.0)) AS a FROM side", ["side"]),
    "tri": (f"SELECT *, CASE WHEN lat2 IS NULL OR a < 1e-10 THEN {INF} ELSE x * y * z / (4 * a) END AS r FROM area", ["area"]),
    "rad": (f"SELECT way_id, road, node_idx AS seg_idx, lat, lon, lat1, lon1, z AS length, least(r, coalesce(lag(r) OVER (PARTITION BY way_id ORDER BY node_idx), {INF})) AS radius FROM tri", ["tri"]),
    "seg": (f"SELECT *, CAST({TIER} AS BIGINT) AS tier, CAST({WEIGHT} AS DOUBLE) AS weight, length * ({WEIGHT}) AS score FROM rad", ["rad"]),
    "key": ("SELECT DISTINCT way_id, k AS group_key FROM (SELECT way_id, name AS k FROM tag UNION ALL SELECT way_id, trim(unnest(string_split(ref, ';'))) FROM tag WHERE ref IS NOT NULL) WHERE k IS NOT NULL AND k <> ''", ["tag"]),
    "total": ("SELECT way_id, count(*) AS n, sum(score) AS s, sum(length) AS l FROM seg GROUP BY way_id", ["seg"]),
    "grp": (
        f"SELECT group_key, count(*) AS n_ways, coalesce(sum(s), 0) AS s, coalesce(sum(l), 0) AS l, min({FACTOR}) AS f, sum(CASE WHEN mph IS NOT NULL THEN l ELSE 0 END) AS tagged, sum(CASE WHEN mph >= 50 THEN l ELSE 0 END) AS passing, sum(mph * l) AS vl FROM (SELECT key.group_key, kept.*, total.s, coalesce(total.l, 0) AS l, {MPH} AS mph FROM key JOIN kept ON key.way_id = kept.way_id LEFT JOIN total ON total.way_id = kept.way_id) GROUP BY group_key",
        ["key", "kept", "total"],
    ),
    "wend": ("SELECT way_id, arg_min(lat7, node_idx) AS a7, arg_min(lon7, node_idx) AS ao7, arg_max(lat7, node_idx) AS b7, arg_max(lon7, node_idx) AS bo7 FROM nodes GROUP BY way_id HAVING count(*) >= 2", ["nodes"]),
    "wdir": (
        f"SELECT way_id, arg_min(f, node_idx) AS entry, arg_max(f, node_idx) AS leave, arg_max(g, node_idx) AS back_entry, arg_min(g, node_idx) AS back_leave FROM (SELECT way_id, node_idx, {brg('lat', 'lon', 'lat1', 'lon1')} AS f, {brg('lat1', 'lon1', 'lat', 'lon')} AS g FROM step WHERE lat1 IS NOT NULL) GROUP BY way_id",
        ["step"],
    ),
    "ge": ("SELECT key.group_key, kept.way_id, coalesce(oneway, '') = 'yes' AS ow, a7, ao7, b7, bo7, entry, leave, back_entry, back_leave FROM key JOIN kept ON key.way_id = kept.way_id LEFT JOIN wend ON wend.way_id = kept.way_id LEFT JOIN wdir ON wdir.way_id = kept.way_id", ["key", "kept", "wend", "wdir"]),
    "pt": ("SELECT group_key, way_id, a7 / 1e7 AS lat, ao7 / 1e7 AS lon FROM ge WHERE a7 IS NOT NULL UNION ALL SELECT group_key, way_id, b7 / 1e7, bo7 / 1e7 FROM ge WHERE b7 IS NOT NULL", ["ge"]),
    "link": (f"SELECT DISTINCT p.group_key, p.way_id AS a, q.way_id AS b FROM pt p JOIN pt q ON p.group_key = q.group_key AND p.way_id < q.way_id AND abs(p.lat - q.lat) < 0.002 WHERE {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} <= 100", ["pt"]),
    "reach": ("SELECT group_key, a AS v, a AS u FROM link UNION SELECT group_key, b, b FROM link UNION SELECT r.group_key, r.v, CASE WHEN l.a = r.u THEN l.b ELSE l.a END FROM reach r JOIN link l ON l.group_key = r.group_key AND (l.a = r.u OR l.b = r.u)", ["link"]),
    "comp": ("SELECT ge.group_key, ge.way_id, coalesce(c, ge.way_id) AS component FROM ge LEFT JOIN (SELECT group_key, v, min(u) AS c FROM reach GROUP BY group_key, v) x ON x.group_key = ge.group_key AND x.v = ge.way_id", ["ge", "reach"]),
    "away": (f"SELECT p.group_key, p.component AS x, q.component AS y, min(round({hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}, 3)) AS gap_m FROM (SELECT pt.*, component FROM pt JOIN comp USING (group_key, way_id)) p JOIN (SELECT pt.*, component FROM pt JOIN comp USING (group_key, way_id)) q ON p.group_key = q.group_key AND p.component < q.component GROUP BY 1, 2, 3", ["pt", "comp"]),
    "prim": (
        "SELECT group_key, [min(x)] AS seen, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y, CAST(NULL AS DOUBLE) AS gap_m FROM away GROUP BY group_key "
        "UNION ALL SELECT group_key, list_append(seen, CASE WHEN list_contains(seen, e.x) THEN e.y ELSE e.x END), e.x, e.y, e.gap_m FROM (SELECT prim.group_key, any_value(prim.seen) AS seen, min({'gap_m': away.gap_m, 'x': away.x, 'y': away.y}) AS e FROM prim JOIN away ON prim.group_key = away.group_key AND list_contains(prim.seen, away.x) <> list_contains(prim.seen, away.y) GROUP BY prim.group_key)",
        ["away"],
    ),
    "gc": ("SELECT ge.*, component FROM ge JOIN comp USING (group_key, way_id)", ["ge", "comp"]),
    "touch": ("SELECT group_key, component, way_id, ow, a7 AS p, ao7 AS q, false AS back, entry AS enter FROM gc WHERE a7 IS NOT NULL UNION ALL SELECT group_key, component, way_id, ow, b7, bo7, true, back_entry FROM gc WHERE b7 IS NOT NULL", ["gc"]),
    "lone": ("SELECT group_key, component, arg_min(way_id, r) AS way_id, arg_min(back, r) AS back FROM (SELECT group_key, component, row(p, q) AS r, count(*) AS c, min(way_id) AS way_id, bool_or(back) AS back, bool_or(ow) AS ow FROM touch GROUP BY group_key, component, p, q) WHERE c = 1 AND NOT (back AND ow) GROUP BY group_key, component", ["touch"]),
    "begin_at": ("SELECT g.group_key, g.component, coalesce(lone.way_id, g.way_id) AS way_id, n > 1 AND coalesce(back, false) AS flip FROM (SELECT group_key, component, min(way_id) AS way_id, count(*) AS n FROM gc GROUP BY group_key, component) g LEFT JOIN lone ON lone.group_key = g.group_key AND lone.component = g.component", ["gc", "lone"]),
    "chain": (
        f"""SELECT group_key, component, way_id, flip, CAST(0 AS BIGINT) AS pos, [way_id] AS seen FROM begin_at
        UNION ALL SELECT group_key, component, way_id, flip, pos, seen FROM (
          SELECT c.group_key, c.component, t.way_id, t.back AS flip, c.pos + 1 AS pos, list_append(c.seen, t.way_id) AS seen,
            row_number() OVER (PARTITION BY c.group_key, c.component ORDER BY {adiff('CASE WHEN c.flip THEN g.back_leave ELSE g.leave END', 't.enter')}, t.way_id, t.back) AS r
          FROM chain c JOIN gc g ON g.group_key = c.group_key AND g.way_id = c.way_id
          JOIN touch t ON t.group_key = c.group_key AND t.component = c.component AND t.p = CASE WHEN c.flip THEN g.a7 ELSE g.b7 END AND t.q = CASE WHEN c.flip THEN g.ao7 ELSE g.bo7 END
          WHERE NOT list_contains(c.seen, t.way_id) AND NOT (t.back AND t.ow)) WHERE r = 1""",
        ["begin_at", "gc", "touch"],
    ),
    "placed": (
        """SELECT group_key, component, way_id, flip, pos FROM chain UNION ALL
        SELECT g.group_key, g.component, g.way_id, false, m.n + row_number() OVER (PARTITION BY g.group_key, g.component ORDER BY g.way_id) - 1
        FROM gc g JOIN (SELECT group_key, component, count(*) AS n FROM chain GROUP BY group_key, component) m ON m.group_key = g.group_key AND m.component = g.component
        WHERE NOT EXISTS (SELECT 1 FROM chain c WHERE c.group_key = g.group_key AND c.way_id = g.way_id)""",
        ["gc", "chain"],
    ),
    "chunked": (
        f"""SELECT *, CAST(sum(CASE WHEN gap > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY group_key, component ORDER BY pos) AS BIGINT) AS chunk FROM (
          SELECT *, {hav('lag(elat) OVER w', 'lag(elon) OVER w', 'blat', 'blon')} AS gap FROM (
            SELECT p.*, CASE WHEN flip THEN b7 ELSE a7 END / 1e7 AS blat, CASE WHEN flip THEN bo7 ELSE ao7 END / 1e7 AS blon, CASE WHEN flip THEN a7 ELSE b7 END / 1e7 AS elat, CASE WHEN flip THEN ao7 ELSE bo7 END / 1e7 AS elon
            FROM placed p JOIN gc g ON g.group_key = p.group_key AND g.way_id = p.way_id) WINDOW w AS (PARTITION BY group_key, component ORDER BY pos))""",
        ["placed", "gc"],
    ),
    "rflat": (
        f"""SELECT group_key, component, chunk, pos, c.way_id, highway, {MPH} AS mph, seg_idx, CASE WHEN flip THEN lat1 ELSE lat END AS lat, CASE WHEN flip THEN lon1 ELSE lon END AS lon, CASE WHEN flip THEN lat ELSE lat1 END AS lat1, CASE WHEN flip THEN lon ELSE lon1 END AS lon1,
          tier, weight, length, score, maxspeed, row_number() OVER (PARTITION BY group_key, component, chunk ORDER BY pos, CASE WHEN flip THEN -seg_idx ELSE seg_idx END) - 1 AS idx
        FROM chunked c JOIN seg ON seg.way_id = c.way_id JOIN kept ON kept.way_id = c.way_id""",
        ["chunked", "seg", "kept"],
    ),
    "fflat": ("SELECT *, road AS group_key, 0 AS component, 0 AS chunk FROM flat", ["flat"]),
    **_wobbles("r", "rflat"),
    **_wobbles("f", "fflat"),
    "rsplit": (_split("rquiet"), ["rquiet"]),
    "fsplit": (_split("fflat"), ["fflat"]),
    "rpiece": ("SELECT * FROM rsplit WHERE NOT long OR none", ["rsplit"]),
    "road": (
        f"""SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY component, chunk, piece) - 1 AS sub_index, s * f AS ps, CASE WHEN l > 0 THEN s / (l / 1000) ELSE 0 END AS pk FROM (
          SELECT group_key, component, chunk, piece, count(DISTINCT way_id) FILTER (WHERE NOT none) AS n_ways, count(*) FILTER (WHERE NOT none) AS n_segments, sum(CASE WHEN none THEN 0 ELSE score END) AS s, sum(CASE WHEN none THEN 0 ELSE length END) AS l,
            coalesce(min({FACTOR}) FILTER (WHERE NOT none), 1.0) AS f, sum(CASE WHEN mph IS NOT NULL AND NOT none THEN length ELSE 0 END) AS tagged, sum(CASE WHEN mph >= 30 AND NOT none THEN length ELSE 0 END) AS passing, sum(CASE WHEN NOT none THEN mph * length END) AS vl
          FROM rpiece GROUP BY group_key, component, chunk, piece)""",
        ["rpiece"],
    ),
    "label": ("SELECT *, CASE WHEN sub_index > 0 THEN group_key || ' (' || CAST(sub_index + 1 AS VARCHAR) || ')' ELSE group_key END AS name FROM road", ["road"]),
    "good": ("SELECT * FROM label WHERE ps >= 100 AND l >= 1609 AND CASE WHEN l <= 0 THEN 0 WHEN tagged <= 0 THEN 1 ELSE passing / tagged END >= 0.5", ["label"]),
    "rseg": ("SELECT r.sub_index, r.name, p.* FROM rpiece p JOIN label r ON r.group_key = p.group_key AND r.component = p.component AND r.chunk = p.chunk AND r.piece = p.piece WHERE NOT p.none", ["rpiece", "label"]),
    "rnum": ("SELECT group_key, sub_index, lat, lon, lat1, lon1, length, row_number() OVER (PARTITION BY group_key, sub_index ORDER BY idx) - 1 AS i, count(*) OVER (PARTITION BY group_key, sub_index) AS n FROM rseg", ["rseg"]),
    "rfeat": (
        "SELECT r.group_key, r.sub_index, ps, l, arg_min(lat, i) AS flat, arg_min(lon, i) AS flon, arg_max(lat1, i) AS llat, arg_max(lon1, i) AS llon, max((lat + lat1) / 2) FILTER (i = n // 2) AS mlat, max((lon + lon1) / 2) FILTER (i = n // 2) AS mlon FROM rnum s JOIN road r ON r.group_key = s.group_key AND r.sub_index = s.sub_index WHERE ps > 0 AND l >= 500 GROUP BY ALL",
        ["rnum", "road"],
    ),
    "rline": ("SELECT group_key, sub_index, list_concat(list({'lat': lat, 'lon': lon}), list({'lat': lat1, 'lon': lon1})) AS pts FROM rnum GROUP BY group_key, sub_index", ["rnum"]),
    "ask": ("SELECT c_custkey AS request_id, 35.0::DOUBLE + (c_custkey % 50) * 0.2::DOUBLE AS olat, -85.0::DOUBLE + (c_custkey // 50) * 0.2::DOUBLE AS olon, c_custkey * 31 AS seed FROM customer", []),
    "elig": (f"SELECT *, {brg('olat', 'olon', 'mlat', 'mlon')} AS bearing FROM (SELECT *, {hav('olat', 'olon', 'mlat', 'mlon')} AS away FROM ask JOIN rfeat ON abs(olat - mlat) < 0.3) WHERE away <= {RADIUS_M}", ["ask", "rfeat"]),
    "lot": (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {LOT} DESC, group_key, sub_index) AS r FROM elig) WHERE r <= 4", ["elig"]),
    "lobe": (
        f"SELECT *, {LOBE_SIDE} AS lft, count(*) FILTER ({LOBE_SIDE}) OVER (PARTITION BY request_id) AS nl, count(*) OVER (PARTITION BY request_id) AS na FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY {LOT} DESC, group_key, sub_index) AS r FROM ({_sector([90, 120, 150, 180], 4, '360')})) WHERE r <= 4",
        ["elig"],
    ),
    "lobes": ("SELECT *, nl > 0 AND nl < na AND lft <> (nl >= na - nl) AS back FROM lobe", ["lobe"]),
    "cand": (f"SELECT *, l / {RIDE_MPS} AS seconds, CASE WHEN {draw('seed', "'sweep'")} / 281474976710656.0 < 0.5 THEN -1 ELSE 1 END AS sweep FROM ({_sector(list(range(120, 361, 30)), 3, '360')})", ["elig"]),
    "ridewalk": (_rides(), ["cand", "rline"]),
    "duewalk": (
        "SELECT group_key, sub_index, i, n, lat1, lon1, length >= 2000 AS due, CASE WHEN length >= 2000 THEN 0.0 ELSE length END AS m FROM rnum WHERE i = 0 UNION ALL SELECT s.group_key, s.sub_index, s.i, s.n, s.lat1, s.lon1, w.m + s.length >= 2000, CASE WHEN w.m + s.length >= 2000 THEN 0.0 ELSE w.m + s.length END FROM duewalk w JOIN rnum s ON s.group_key = w.group_key AND s.sub_index = w.sub_index AND s.i = w.i + 1",
        ["rnum"],
    ),
    "dpt": (
        f"SELECT *, {DENSE_KEY} AS k, row_number() OVER (PARTITION BY group_key ORDER BY sub_index, kind, i) AS o FROM (SELECT group_key, sub_index, 0 AS kind, i, lat, lon FROM rnum WHERE i = 0 UNION ALL SELECT group_key, sub_index, 1, i, lat1, lon1 FROM duewalk WHERE due UNION ALL SELECT group_key, sub_index, 2, i, lat1, lon1 FROM rnum WHERE i = n - 1)",
        ["rnum", "duewalk"],
    ),
    "dwalk": (
        f"""SELECT group_key, o, lat, lon, true AS keep, lat AS klat, lon AS klon, [k] AS seen FROM dpt WHERE o = 1 UNION ALL
        SELECT group_key, o, lat, lon, keep, CASE WHEN keep THEN lat ELSE klat END, CASE WHEN keep THEN lon ELSE klon END, CASE WHEN keep THEN list_append(seen, k) ELSE seen END FROM (
          SELECT p.group_key, p.o, p.lat, p.lon, p.k, w.klat, w.klon, w.seen, {hav('w.klat', 'w.klon', 'p.lat', 'p.lon')} > 100 AND NOT list_contains(w.seen, p.k) AS keep FROM dwalk w JOIN dpt p ON p.group_key = w.group_key AND p.o = w.o + 1)""",
        ["dpt"],
    ),
    "flat": ("SELECT *, row_number() OVER (PARTITION BY road ORDER BY way_id, seg_idx) - 1 AS idx FROM seg", ["seg"]),
    "route": (adapter.ROUTES_SQL.format(nodes="nodes"), ["nodes"]),
    "rp": ("SELECT request_id, CAST(route_idx AS BIGINT) AS route_idx, pt_idx, lat7 / 1e7 AS lat, lon7 / 1e7 AS lon FROM route", ["route"]),
    "leg": (
        "SELECT request_id, route_idx, pt_idx AS leg, lat, lon, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM rp WINDOW w AS (PARTITION BY request_id, route_idx ORDER BY pt_idx)",
        ["rp"],
    ),
    "legm": (f"SELECT *, {hav('lat', 'lon', 'lat1', 'lon1')} AS m, {brg('lat', 'lon', 'lat1', 'lon1')} AS b, (lat + lat1) / 2 AS mlat, (lon + lon1) / 2 AS mlon FROM leg WHERE lat1 IS NOT NULL", ["leg"]),
    "legt": (f"SELECT *, {adiff('b', 'lead(b) OVER (PARTITION BY request_id, route_idx ORDER BY leg)')} AS t FROM legm", ["legm"]),
    "rsum": (
        f"SELECT request_id, route_idx, sum(m) AS d, coalesce(sum(t), 0) AS t, {hav('arg_min(lat, leg)', 'arg_min(lon, leg)', 'arg_max(lat1, leg)', 'arg_max(lon1, leg)')} AS line FROM legt GROUP BY request_id, route_idx",
        ["legt"],
    ),
    "rstat": ("SELECT request_id, route_idx, d, least(line / d, 1.0) AS ind, t / (d / 1000) AS dens, t / (d / 1000) * 0.7 + (1 - least(line / d, 1.0)) * 300 AS score FROM rsum", ["rsum"]),
    "ft": (f"SELECT way_id, lat, lon, CAST(floor(lat / {TILE}) AS BIGINT) AS lat_idx, CAST(floor(lon / {TILE}) AS BIGINT) AS lon_idx FROM n WHERE node_idx = 0", ["n"]),
    "rend": ("SELECT road, arg_min(lat, row(way_id, node_idx)) AS lat, arg_min(lon, row(way_id, node_idx)) AS lon FROM n GROUP BY road UNION ALL SELECT road, arg_max(lat, row(way_id, node_idx)), arg_max(lon, row(way_id, node_idx)) FROM n GROUP BY road", ["n"]),
    "rends": ("SELECT request_id, route_idx, arg_min(lat, pt_idx) AS lat, arg_min(lon, pt_idx) AS lon, arg_max(lat, pt_idx) AS lat1, arg_max(lon, pt_idx) AS lon1 FROM rp GROUP BY request_id, route_idx", ["rp"]),
    "sm": ("SELECT *, (lat + lat1) / 2 AS mlat, (lon + lon1) / 2 AS mlon, CAST(floor((lat + lat1) * 100) AS BIGINT) AS ci, CAST(floor((lon + lon1) * 100) AS BIGINT) AS cj FROM seg", ["seg"]),
    "lm": ("SELECT request_id, lat AS a, lon AS b, lat1 - lat AS dy, lon1 - lon AS dx, CAST(floor(mlat * 200) AS BIGINT) + di AS ci, CAST(floor(mlon * 200) AS BIGINT) + dj AS cj FROM legm, (SELECT unnest([-1, 0, 1]) AS di) x, (SELECT unnest([-1, 0, 1]) AS dj) y", ["legm"]),
    "foot": ("SELECT sm.*, a, b, dx, dy, CASE WHEN dx * dx + dy * dy > 0 THEN greatest(0.0, least(1.0, ((mlon - b) * dx + (mlat - a) * dy) / (dx * dx + dy * dy))) ELSE 0.0 END AS t FROM sm JOIN lm USING (ci, cj)", ["sm", "lm"]),
    "along": (f"SELECT DISTINCT way_id, seg_idx, score, length FROM foot WHERE {hav('mlat', 'mlon', '(a + t * dy)', '(b + t * dx)')} <= 50", ["foot"]),
    "cellp": ("SELECT request_id, route_idx, leg, mlat, mlon, CAST(floor(mlat * 100) AS BIGINT) + di AS ci, CAST(floor(mlon * 100) AS BIGINT) + dj AS cj FROM legm, (SELECT unnest([-1, 0, 1]) AS di) x, (SELECT unnest([-1, 0, 1]) AS dj) y", ["legm"]),
    "celln": ("SELECT way_id, lat, lon, CAST(floor(lat * 100) AS BIGINT) AS ci, CAST(floor(lon * 100) AS BIGINT) AS cj FROM n", ["n"]),
    "met": (f"SELECT request_id, route_idx, leg, way_id, {hav('mlat', 'mlon', 'lat', 'lon')} AS d FROM cellp JOIN celln USING (ci, cj) WHERE abs(mlat - lat) < 0.0004 AND abs(mlon - lon) < 0.0008", ["cellp", "celln"]),
    "near": ("SELECT request_id, route_idx, leg, way_id FROM (SELECT *, row_number() OVER (PARTITION BY request_id, route_idx, leg ORDER BY d, way_id) AS r FROM met WHERE d <= 30) WHERE r = 1", ["met"]),
    "fault": (
        f"SELECT way_id, CASE WHEN {_in('access', tags.NO_ACCESS)} OR {_in('highway', tags.NO_HIGHWAY)} THEN 1.0 ELSE 0.0 END AS dq, CASE WHEN {_in('surface', tags.NO_SURFACE)} THEN 1.0 WHEN {_in('surface', tags.SOFT_SURFACE)} THEN 0.5 WHEN highway = 'unclassified' AND coalesce(surface, '') = '' THEN 0.25 WHEN highway = 'service' THEN 0.25 ELSE 0.0 END AS sp, CASE highway WHEN 'motorway' THEN 1.0 WHEN 'trunk' THEN 0.8 WHEN 'primary' THEN 0.4 ELSE 0.0 END AS tp, CASE highway WHEN 'residential' THEN 1.0 WHEN 'living_street' THEN 1.0 WHEN 'tertiary' THEN 0.5 ELSE 0.0 END AS lb FROM tag",
        ["tag"],
    ),
    "share": (
        "SELECT legm.request_id, legm.route_idx, sum(coalesce(dq, 0) * m) / sum(m) AS dq, sum(coalesce(sp, 0) * m) / sum(m) AS sp, sum(coalesce(tp, 0) * m) / sum(m) AS tp, sum(coalesce(lb, 0) * m) / sum(m) AS lb FROM legm LEFT JOIN near ON near.request_id = legm.request_id AND near.route_idx = legm.route_idx AND near.leg = legm.leg LEFT JOIN fault ON fault.way_id = near.way_id GROUP BY legm.request_id, legm.route_idx",
        ["legm", "near", "fault"],
    ),
    "adj": ("SELECT request_id, route_idx, dq, sp, tp, lb, score * (1 - 0.9 * dq) * (1 - 0.3 * sp) * (1 - 0.6 * tp) * (1 + 0.4 * lb) AS adj FROM rstat JOIN share USING (request_id, route_idx)", ["rstat", "share"]),
    "rlegs": (
        f"SELECT request_id, route_idx, count(*) AS n, greatest(1, CAST(ceil((count(*) - 1) / {adapter.LEG_STEPS}.0) AS BIGINT)) AS legs, CAST(sum(CAST(round(lat * 1e6) AS BIGINT)) AS BIGINT) AS lat_sum, CAST(sum(CAST(round(lon * 1e6) AS BIGINT)) AS BIGINT) AS lon_sum FROM rp GROUP BY request_id, route_idx",
        ["rp"],
    ),
    "dur": ("SELECT request_id, route_idx, count(*) * 30.0 AS duration FROM rp GROUP BY request_id, route_idx", ["rp"]),
    "wt": (f"SELECT DISTINCT way_id, CAST(floor(lat7 / 1e7 / {TILE}) AS BIGINT) AS lat_idx, CAST(floor(lon7 / 1e7 / {TILE}) AS BIGINT) AS lon_idx FROM nodes", ["nodes"]),
}


def _norm(c: str) -> str:
    return f"CASE WHEN max({c}) OVER w > min({c}) OVER w THEN ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) ELSE 1.0 END"


_inside = lambda a, b: f"({a} BETWEEN {S} AND {N} AND {b} BETWEEN {W} AND {E})"

#: name -> (text, the parts that it needs)
# the same walks along the roads of rides, in the direction in which each is driven
PARTS["rrnum"] = (
    "SELECT w.request_id AS group_key, w.step AS sub_index, CASE WHEN reversed THEN n - 1 - i ELSE i END AS i, n, length, CASE WHEN reversed THEN lat1 ELSE lat END AS lat, CASE WHEN reversed THEN lon1 ELSE lon END AS lon, CASE WHEN reversed THEN lat ELSE lat1 END AS lat1, CASE WHEN reversed THEN lon ELSE lon1 END AS lon1 FROM ridewalk w JOIN rnum s ON s.group_key = w.group_key AND s.sub_index = w.sub_index",
    ["ridewalk", "rnum"],
)
for _walk in ("duewalk", "dpt", "dwalk"):
    _text, _needs = PARTS[_walk]
    PARTS[f"r{_walk}"] = (re.sub(r"\b(rnum|duewalk|dpt|dwalk)\b", r"r\1", _text), [f"r{p}" for p in _needs])


#: name -> (text, the parts that it needs, parts that stand in for others)
TEXTS: dict[str, tuple] = {
    "way_assembly": ("SELECT tag.way_id, count(node_idx) AS n_nodes, arg_min(lat, node_idx) AS first_lat, arg_max(lon, node_idx) AS last_lon FROM tag LEFT JOIN n ON n.way_id = tag.way_id GROUP BY tag.way_id", ["tag", "n"]),
    "hard_filter": ("SELECT way_id, highway FROM kept", ["kept"]),
    "drivable_ways": (f"SELECT highway, count(*) AS n FROM tag WHERE highway IN ({', '.join(repr(h) for h in tags.DRIVABLE)}) GROUP BY highway", ["tag"]),
    "pipeline_counts": ("SELECT (SELECT count(*) FROM tag) AS input_ways, (SELECT count(*) FROM kept) AS kept_ways, (SELECT count(*) FROM seg JOIN kept USING (way_id)) AS segments", ["tag", "kept", "seg"]),
    "segment_scores": ("SELECT way_id, seg_idx, tier, weight, round(length, 3) AS length, round(score, 3) AS score FROM seg", ["seg"]),
    "way_totals": ("SELECT tag.way_id, coalesce(n, 0) AS n_segments, round(coalesce(s, 0), 3) AS score, round(coalesce(l, 0), 3) AS length FROM tag LEFT JOIN total ON total.way_id = tag.way_id", ["tag", "total"]),
    "way_ends": (
        f"SELECT way_id, lat AS first_lat, last_lat, round(entry, 2) AS entry, round(ex, 2) AS exit FROM (SELECT *, seg_idx AS i, {brg('lat', 'lon', 'lat1', 'lon1')} AS entry, last_value(lat1) OVER w AS last_lat, last_value({brg('lat', 'lon', 'lat1', 'lon1')}) OVER w AS ex FROM seg WINDOW w AS (PARTITION BY way_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE i = 0",
        ["seg"],
    ),
    "group_ways": ("SELECT group_key, way_id FROM key", ["key"]),
    "name_groups": ("SELECT name AS group_key, count(*) AS n_ways FROM tag WHERE name IS NOT NULL GROUP BY name", ["tag"]),
    "distinct_ways": ("SELECT way_id, name, CASE WHEN way_id % 3 = 0 THEN 'a' ELSE 'b' END AS tile_key FROM tag", ["tag"]),
    "merge_regions": ("SELECT way_id * 1000 + node_idx AS id, CASE WHEN lat7 < 400000000 THEN lat7 ELSE lat7 + 1 END AS lat7, lon7 FROM nodes", ["nodes"]),
    "find_ways": ("SELECT way_id, name, ref FROM tag WHERE contains(ref, 'R1') AND contains(name, 'Road 1')", ["tag"]),
    "ways_in_box": (f"SELECT DISTINCT way_id FROM n WHERE {_inside('lat', 'lon')}", ["n"]),
    "scored_ways_in_box": (f"SELECT way_id, count(*) AS n_segments FROM seg GROUP BY way_id HAVING bool_or(({_inside('lat', 'lon')}) OR ({_inside('lat1', 'lon1')}))", ["seg"]),
    "ordered_ways": ("SELECT tag.way_id, coalesce(lat, 0.0) AS lat, coalesce(lon, 0.0) AS lon FROM tag LEFT JOIN n ON n.way_id = tag.way_id AND node_idx = 0", ["tag", "n"]),
    "way_tiles": ("SELECT way_id, lat_idx, lon_idx FROM wt", ["wt"]),
    "road_tiles": (
        f"SELECT road, lat_idx, unnest(range(w, e + 1)) AS lon_idx FROM (SELECT road, w, e, unnest(range(s, nn + 1)) AS lat_idx FROM (SELECT road, CAST(floor(min(lat) / {TILE}) AS BIGINT) AS s, CAST(floor(max(lat) / {TILE}) AS BIGINT) AS nn, CAST(floor(min(lon) / {TILE}) AS BIGINT) AS w, CAST(floor(max(lon) / {TILE}) AS BIGINT) AS e FROM n GROUP BY road))",
        ["n"],
    ),
    "tile_status": ("SELECT lat_idx, lon_idx, CASE WHEN bool_or(way_id % 4 = 0) THEN 'present' WHEN bool_or(way_id % 4 = 1) THEN 'failed' ELSE 'missing' END AS status FROM wt GROUP BY lat_idx, lon_idx", ["wt"]),
    "new_tiles": ("SELECT lat_idx, lon_idx FROM wt GROUP BY lat_idx, lon_idx HAVING NOT bool_or(way_id % 4 = 0)", ["wt"]),
    "locate_ways": ("SELECT tag.way_id, min(CAST(lat_idx AS VARCHAR) || '_' || CAST(lon_idx AS VARCHAR)) AS tile_key, count(lat_idx) > 0 AS found FROM tag LEFT JOIN wt ON wt.way_id = tag.way_id GROUP BY tag.way_id", ["tag", "wt"]),
    "way_speeds": (f"SELECT way_id, round({MPH}, 3) AS mph FROM tag", ["tag"]),
    "name_scores": ("SELECT group_key, n_ways, round(s, 3) AS total_score, round(l, 3) AS total_length, round(CASE WHEN l > 0 THEN s / (l / 1000) ELSE 0 END, 2) AS score_per_km, CAST(f AS DOUBLE) AS penalty_factor, round(s * f, 3) AS penalized_score FROM grp", ["grp"]),
    "top_names": ("SELECT group_key, n_ways, round(s, 3) AS total_score, round(l, 3) AS total_length, round(CASE WHEN l > 0 THEN s / (l / 1000) ELSE 0 END, 2) AS score_per_km, CAST(f AS DOUBLE) AS penalty_factor, round(s * f, 3) AS penalized_score FROM grp ORDER BY penalized_score DESC, group_key LIMIT 5", ["grp"]),
    "name_speeds": ("SELECT group_key, round(CASE WHEN l <= 0 THEN 0 WHEN tagged <= 0 THEN 1 ELSE passing / tagged END, 3) AS passing, round(CASE WHEN tagged > 0 THEN vl / tagged END, 3) AS mean_mph FROM grp", ["grp"]),
    "name_colours": (f"SELECT group_key, level, kml, '#' || lower(substr(kml, 7, 2) || substr(kml, 5, 2) || substr(kml, 3, 2)) AS css FROM (SELECT group_key, level, {KML} AS kml FROM (SELECT group_key, {LEVEL} AS level FROM (SELECT group_key, round(s) AS s FROM grp)))", ["grp"]),
    "route_faults": ("SELECT way_id, dq > 0 AS dq, CAST(sp AS DOUBLE) AS sp, CAST(tp AS DOUBLE) AS tp, CAST(lb AS DOUBLE) AS lb FROM fault", ["fault"]),
    "chained_ways": ("SELECT group_key, component, way_id, pos, flip AS reversed, chunk FROM chunked", ["chunked"]),
    "wobble_filter": ("SELECT road, round(sum(was), 2) AS score_before, round(sum(score), 2) AS score_after, count(*) FILTER (WHERE was <> 0 AND score = 0) AS zeroed FROM fquiet GROUP BY road", ["fquiet"]),
    "road_table": ("SELECT group_key, sub_index, n_ways, n_segments, round(s, 2) AS total_score, round(l, 2) AS total_length, round(pk, 2) AS score_per_km, CAST(f AS DOUBLE) AS penalty_factor, round(ps, 2) AS penalized_score FROM road", ["road"]),
    "ranked_roads": ("SELECT name, round(ps, 2) AS penalized_score, round(l, 2) AS total_length FROM good", ["good"]),
    "top_roads": ("SELECT name, round(ps, 2) AS penalized_score FROM label ORDER BY ps DESC, group_key, sub_index LIMIT 5", ["label"]),
    "road_boxes": ("SELECT group_key, sub_index, least(min(lat), min(lat1)) AS south, least(min(lon), min(lon1)) AS west, greatest(max(lat), max(lat1)) AS north, greatest(max(lon), max(lon1)) AS east, arg_min(lat, idx) AS first_lat, arg_max(lon1, idx) AS last_lon, count(DISTINCT way_id) AS n_ways FROM rseg GROUP BY group_key, sub_index", ["rseg"]),
    "exported_ways": (
        "SELECT group_key, sub_index, coalesce(string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY way_id) FILTER (WHERE way_id % 2 = 0), '') AS present_ids, coalesce(string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY way_id) FILTER (WHERE way_id % 2 = 1), '') AS missing_ids, count(*) FILTER (WHERE way_id % 2 = 0) AS present, count(*) FILTER (WHERE way_id % 2 = 1) AS missing FROM (SELECT DISTINCT group_key, sub_index, way_id FROM rseg) GROUP BY group_key, sub_index",
        ["rseg"],
    ),
    "segment_features": ("SELECT p.way_id, name AS road_name, tier, round(score, 2) AS score, highway, maxspeed, round(lon, 7) AS lon0, round(lat1, 7) AS lat1 FROM rseg p", ["rseg"]),
    "road_features": (
        f"SELECT group_key, sub_index, name AS road_name, '#' || lower(substr(kml, 7, 2) || substr(kml, 5, 2) || substr(kml, 3, 2)) AS color, round(mean, 2) AS max_speed_mph, n_points, round(s, 1) AS score FROM (SELECT *, {KML} AS kml FROM (SELECT *, n_segments + 1 AS n_points, CASE WHEN tagged > 0 THEN vl / tagged END AS mean, {LEVEL} AS level FROM label WHERE n_segments > 0))",
        ["label"],
    ),
    "stage_report": (
        f"""SELECT group_key, 'tile_cache' AS stage, count(*) AS n_ways, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_segments, 1 AS n_parts, 0.0 AS score, round(coalesce(sum(l), 0), 2) AS length FROM key LEFT JOIN total USING (way_id) GROUP BY group_key
        UNION ALL SELECT group_key, 'hard_filter', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), 1, 0.0, round(coalesce(sum(l), 0), 2) FROM ge LEFT JOIN total USING (way_id) GROUP BY group_key
        UNION ALL SELECT group_key, stage, count(*), CAST(coalesce(sum(n), 0) AS BIGINT), 1, round(coalesce(sum(s), 0), 2), round(coalesce(sum(l), 0), 2) FROM ge LEFT JOIN total USING (way_id), (SELECT unnest(['scoring', 'grouping']) AS stage) GROUP BY group_key, stage
        UNION ALL SELECT group_key, 'connected_components', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), count(DISTINCT component), round(coalesce(sum(s), 0), 2), round(coalesce(sum(l), 0), 2) FROM chunked LEFT JOIN total USING (way_id) GROUP BY group_key
        UNION ALL SELECT group_key, 'ordering', count(*), CAST(coalesce(sum(n), 0) AS BIGINT), count(DISTINCT row(component, chunk)), round(coalesce(sum(s), 0), 2), round(coalesce(sum(l), 0), 2) FROM chunked LEFT JOIN total USING (way_id) GROUP BY group_key
        UNION ALL SELECT group_key, 'deflection_filter', count(DISTINCT way_id), count(*), count(DISTINCT row(component, chunk)), round(sum(score), 2), round(sum(length), 2) FROM rquiet GROUP BY group_key
        UNION ALL SELECT group_key, 'straight_gap_split', count(DISTINCT way_id) FILTER (WHERE NOT none), count(*) FILTER (WHERE NOT none), count(DISTINCT row(component, chunk, piece)), round(sum(CASE WHEN none THEN 0 ELSE score END), 2), round(sum(CASE WHEN none THEN 0 ELSE length END), 2) FROM rpiece GROUP BY group_key
        UNION ALL SELECT r.group_key, 'penalties', w.n, CAST(sum(n_segments) AS BIGINT), count(*), round(sum(ps), 2), round(sum(l), 2) FROM road r JOIN (SELECT group_key, count(DISTINCT way_id) FILTER (WHERE NOT none) AS n FROM rpiece GROUP BY group_key) w ON w.group_key = r.group_key GROUP BY r.group_key, w.n
        UNION ALL SELECT r.group_key, 'output_filter', w.n, CAST(sum(n_segments) AS BIGINT), count(*), round(sum(ps), 2), round(sum(l), 2) FROM good r JOIN (SELECT p.group_key, count(DISTINCT way_id) AS n FROM rseg p JOIN good g ON g.group_key = p.group_key AND g.sub_index = p.sub_index GROUP BY p.group_key) w ON w.group_key = r.group_key GROUP BY r.group_key, w.n""",
        ["key", "total", "ge", "chunked", "rquiet", "rpiece", "road", "good", "rseg"],
    ),
    "group_detail": (
        "SELECT q.group_key, q.component, n_ways, n_chunks, n_pieces, before AS score_before, after AS score_after, zeroed FROM (SELECT group_key, component, count(DISTINCT way_id) AS n_ways, count(DISTINCT chunk) AS n_chunks, round(sum(was), 2) AS before, round(sum(score), 2) AS after, count(*) FILTER (WHERE was <> 0 AND score = 0) AS zeroed FROM rquiet GROUP BY group_key, component) q JOIN (SELECT group_key, component, count(DISTINCT row(chunk, piece)) AS n_pieces FROM rpiece GROUP BY group_key, component) p ON p.group_key = q.group_key AND p.component = q.component",
        ["rquiet", "rpiece"],
    ),
    "proximity_links": ("SELECT group_key, a, b FROM link", ["link"]),
    "road_components": ("SELECT group_key, way_id, component FROM comp", ["comp"]),
    "continuity": (
        "SELECT group_key, CAST(sum(n) AS BIGINT) AS n_ways, CAST(sum(nodes) AS BIGINT) AS n_nodes, round(sum(l), 2) AS length, count(*) AS n_components, max(n) AS largest, count(*) = 1 AS contiguous, min(south) AS south, min(west) AS west, max(north) AS north, max(east) AS east FROM (SELECT group_key, component, count(*) AS n, coalesce(sum(nodes), 0) AS nodes, coalesce(sum(total.l), 0) AS l, min(south) AS south, min(west) AS west, max(north) AS north, max(east) AS east FROM comp LEFT JOIN (SELECT way_id, count(*) AS nodes, min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM n GROUP BY way_id) b USING (way_id) LEFT JOIN total USING (way_id) GROUP BY group_key, component) GROUP BY group_key",
        ["comp", "n", "total"],
    ),
    "component_gaps": (
        f"SELECT p.group_key, p.component AS x, q.component AS y, round(min({hav('p.lat', 'p.lon', 'q.lat', 'q.lon')}), 2) AS gap_m FROM (SELECT pt.*, component FROM pt JOIN comp USING (group_key, way_id)) p JOIN (SELECT pt.*, component FROM pt JOIN comp USING (group_key, way_id)) q ON p.group_key = q.group_key AND p.component < q.component GROUP BY 1, 2, 3",
        ["pt", "comp"],
    ),
    "component_links": ("SELECT group_key, x, y, gap_m FROM prim WHERE x IS NOT NULL", ["prim"]),
    "straight_splits": (
        "SELECT road, piece, count(*) FILTER (WHERE NOT none) AS n, round(sum(CASE WHEN none THEN 0 ELSE length END), 2) AS length, round(sum(CASE WHEN none THEN 0 ELSE score END), 2) AS score FROM fsplit WHERE NOT long OR none GROUP BY road, piece",
        ["fsplit"],
    ),
    "tier_runs": (
        "SELECT road, run, min(tier) AS tier, count(*) AS n, round(sum(length), 2) AS length FROM (SELECT *, CAST(sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY road ORDER BY idx) - 1 AS BIGINT) AS run FROM (SELECT *, coalesce(lag(tier) OVER (PARTITION BY road ORDER BY idx) <> tier, true) AS first FROM flat)) GROUP BY road, run",
        ["flat"],
    ),
    "tier_histogram": (
        "SELECT road, " + ", ".join([f"count(*) FILTER (WHERE tier = {t}) AS n_{t}" for t in range(5)] + [f"round(sum(CASE WHEN tier = {t} THEN {c} ELSE 0 END), 2) AS {c}_{t}" for c in ("score", "length") for t in range(5)]) + " FROM seg GROUP BY road",
        ["seg"],
    ),
    "viewport_score": (
        f"SELECT round(coalesce(sum(score), 0), 1) AS score, round(coalesce(sum(length), 0), 1) AS length, round(CASE WHEN sum(length) > 0 THEN sum(score) / (sum(length) / 1000) ELSE 0 END, 2) AS per_km FROM seg WHERE {_inside('lat', 'lon')} OR {_inside('lat1', 'lon1')}",
        ["seg"],
    ),
    "route_stats": ("SELECT request_id, route_idx, round(d, 2) AS distance, round(ind, 4) AS indirectness, round(dens, 2) AS angular_density, round(score, 2) AS score FROM rstat", ["rstat"]),
    "nearest_ways": ("SELECT request_id, route_idx, leg, way_id FROM near", ["near"]),
    "route_quality": ("SELECT request_id, route_idx, round(dq, 4) AS disqualified, round(sp, 4) AS surface_penalty, round(tp, 4) AS through_penalty, round(lb, 4) AS local_share, round(adj, 2) AS adjusted_score FROM adj", ["adj"]),
    "route_choice": (
        f"SELECT request_id, route_idx, round(sel, 3) AS sel FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY sel DESC, route_idx) AS r FROM (SELECT request_id, route_idx, {TWIST} * ({_norm('adj')}) + {1 - TWIST} * (1 - ({_norm('duration')})) AS sel FROM adj JOIN dur USING (request_id, route_idx) WINDOW w AS (PARTITION BY request_id))) WHERE r = 1",
        ["adj", "dur"],
    ),
    "route_comparison": (
        "SELECT request_id, route_idx, round(d / 1000, 3) AS km, CAST(duration / 60 AS DOUBLE) AS minutes, row_number() OVER (PARTITION BY request_id ORDER BY duration, route_idx) = 1 AS selected FROM rstat JOIN dur USING (request_id, route_idx)",
        ["rstat", "dur"],
    ),
    "route_boxes": ("SELECT request_id, round(min(lat) - 0.01, 7) AS south, round(min(lon) - 0.01, 7) AS west, round(max(lat) + 0.01, 7) AS north, round(max(lon) + 0.01, 7) AS east FROM rp GROUP BY request_id", ["rp"]),
    "corridor_segments": ("SELECT way_id, seg_idx FROM along", ["along"]),
    "route_view": ("SELECT round(sum(score), 1) AS score, round(sum(length), 1) AS length, round(sum(score) / (sum(length) / 1000), 2) AS per_km FROM along", ["along"]),
    "roads_in_box": (f"SELECT DISTINCT group_key, sub_index FROM rseg WHERE {_inside('lat', 'lon')} OR {_inside('lat1', 'lon1')}", ["rseg"]),
    "overlay_roads": ("SELECT group_key, sub_index FROM road WHERE s >= 200 AND tagged > 0 AND vl / tagged >= 40", ["road"]),
    "find_roads": ("SELECT DISTINCT 'way 2' AS wanted, group_key, sub_index FROM rseg WHERE way_id = 2 UNION ALL SELECT 'R4', group_key, sub_index FROM road WHERE group_key = 'R4'", ["rseg", "road"]),
    "pass_lines": ("SELECT r.group_key, r.sub_index, g.group_key IS NOT NULL AS passes, g.group_key IS NOT NULL AS says_so FROM road r LEFT JOIN good g ON g.group_key = r.group_key AND g.sub_index = r.sub_index", ["road", "good"]),
    "ingest_count": ("SELECT count(*) AS n_ways FROM tag", ["tag"]),
    "tile_segments": (f"SELECT lat_idx, lon_idx, count(*) AS n, round(sum(score), 2) AS score FROM seg JOIN ft USING (way_id) WHERE lat_idx BETWEEN floor({S} / {TILE}) AND floor({N} / {TILE}) AND lon_idx BETWEEN floor({W} / {TILE}) AND floor({E} / {TILE}) GROUP BY lat_idx, lon_idx", ["seg", "ft"]),
    "road_spacing": (
        f"SELECT a.road AS a, b.road AS b, round(min({hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}), 2) AS away_m FROM rend a JOIN rend b ON a.road < b.road AND abs(a.lat - b.lat) < 0.05 WHERE {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 5000 GROUP BY a.road, b.road",
        ["rend"],
    ),
    "nearest_roads": (
        f"SELECT id, other, round(away, 2) AS away_m FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(away, 3), other) AS r FROM (SELECT a.road AS id, b.road AS other, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS away FROM rend a JOIN rend b ON a.road <> b.road)) WHERE r = 1",
        ["rend"],
    ),
    "tile_rings": (f"SELECT lat_idx, lon_idx, bool_or(way_id % 4 = 0) AS loaded, 5 AS n_points, round((lon_idx + 1) * {TILE}, 6) AS east, round((lat_idx + 1) * {TILE}, 6) AS north, true AS closed FROM wt GROUP BY lat_idx, lon_idx", ["wt"]),
    "region_order": ("SELECT 0 AS kind, way_id * 1000 + node_idx AS id FROM nodes UNION ALL SELECT 1, way_id FROM tag UNION ALL SELECT 2, way_id FROM tag WHERE way_id % 7 = 0", ["nodes", "tag"]),
    "region_files": (
        "SELECT 'node' AS kind, way_id * 1000 + node_idx AS id, lat7 AS a, lon7 AS b, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS tag FROM nodes UNION ALL SELECT 'way', way_id, min(way_id * 1000 + node_idx), max(way_id * 1000 + node_idx), count(*), any_value(ref) FROM nodes JOIN tag USING (way_id) GROUP BY way_id UNION ALL SELECT 'relation', road, min(way_id), max(way_id), count(DISTINCT way_id), 'route & <more>' FROM nodes GROUP BY road",
        ["nodes", "tag"],
    ),
    "stale_tiles": ("SELECT lat_idx, lon_idx, count(*) AS n_ways FROM ft GROUP BY lat_idx, lon_idx HAVING min(way_id) % 3 = 0 OR min(way_id) % 5 = 0", ["ft"]),
    "fresh_scores": ("SELECT tag.way_id, round(s, 2) AS score FROM tag JOIN total USING (way_id) WHERE highway = 'primary' AND s > 100 AND way_id % 5 <> 0", ["tag", "total"]),
    "kept_tiles": ("SELECT lat_idx, lon_idx FROM ft JOIN orders ON o_orderkey + 1 = way_id GROUP BY lat_idx, lon_idx HAVING max(CAST(o_orderdate AS TIMESTAMP)) >= (SELECT max(CAST(o_orderdate AS TIMESTAMP)) FROM orders) - INTERVAL 90 DAY", ["ft"]),
    "tiles_outside_box": (f"SELECT lat_idx, lon_idx, count(*) AS n_ways FROM ft WHERE NOT (lat_idx BETWEEN floor({S} / {TILE}) AND floor({N} / {TILE}) AND lon_idx BETWEEN floor({W} / {TILE}) AND floor({E} / {TILE})) GROUP BY lat_idx, lon_idx", ["ft"]),
    "trip_routes": ("SELECT request_id, route_idx, n AS n_points, lat_sum, lon_sum, CAST(30 * (n + legs - 1) AS DOUBLE) AS duration, CAST(50 * (n + legs - 1) AS DOUBLE) AS distance FROM rlegs", ["rlegs"]),
    "coded_routes": (
        "SELECT request_id, route_idx, count(*) AS n_points, CAST(sum(CAST(round(lat * 1e5) AS BIGINT)) AS BIGINT) AS lat_sum, CAST(sum(CAST(round(lon * 1e5) AS BIGINT)) AS BIGINT) AS lon_sum, CAST(30 * count(*) AS DOUBLE) AS duration, CAST(50 * count(*) AS DOUBLE) AS distance FROM rp WHERE request_id % 10 <> 3 GROUP BY request_id, route_idx",
        ["rp"],
    ),
    "trip_stops": (
        f"SELECT s.request_id, s.route_idx, stop, CASE WHEN stop = 0 THEN c_name END AS name, round(round(lat * 1e6) / 1e6, 6) AS lat, round(round(lon * 1e6) / 1e6, 6) AS lon FROM (SELECT *, unnest(range(0, legs + 1)) AS stop FROM rlegs) s JOIN rp ON rp.request_id = s.request_id AND rp.route_idx = s.route_idx AND pt_idx = least(stop * {adapter.LEG_STEPS}, n - 1) LEFT JOIN customer ON c_custkey = s.request_id",
        ["rlegs", "rp"],
    ),
    "trip_turns": (
        f"SELECT s.request_id, s.route_idx, pos, CASE WHEN pos % 2 = 0 THEN '{adapter.WORDING[:-1]}' ELSE 'Arrive' END AS name, CASE WHEN pos % 2 = 0 THEN '{adapter.WORDING} ' || CAST(pos // 2 AS VARCHAR) || ' (12 s, 0.4 km)' ELSE 'Arrive (0 s, 0.0 km)' END AS description, CASE WHEN pos % 2 = 0 THEN round(round(lat * 1e6) / 1e6, 6) ELSE 0.0 END AS lat, CASE WHEN pos % 2 = 0 THEN round(round(lon * 1e6) / 1e6, 6) ELSE 0.0 END AS lon FROM (SELECT *, unnest(range(0, 2 * legs)) AS pos FROM rlegs) s JOIN rp ON rp.request_id = s.request_id AND rp.route_idx = s.route_idx AND pt_idx = least(pos // 2 * {adapter.LEG_STEPS}, n - 1)",
        ["rlegs", "rp"],
    ),
    "tile_table": (
        f"SELECT lat_idx, lon_idx, count(*) FILTER (WHERE stays) AS n_ways, count(*) FILTER (WHERE stays AND new) AS n_new, CAST(coalesce(sum(nodes) FILTER (WHERE stays), 0) AS BIGINT) AS n_nodes FROM (SELECT ft.*, (lat_idx + lon_idx) % 3 = 0 AS new, NOT ((lat_idx + lon_idx) % 3 = 0 AND way_id % 4 = 0) AS stays, nodes FROM ft JOIN (SELECT way_id, count(*) AS nodes FROM n GROUP BY way_id) USING (way_id)) WHERE lat_idx BETWEEN floor({S} / {TILE}) AND floor({N} / {TILE}) AND lon_idx BETWEEN floor({W} / {TILE}) AND floor({E} / {TILE}) GROUP BY lat_idx, lon_idx",
        ["ft", "n"],
    ),
    "loaded_tiles": ("SELECT DISTINCT lat_idx, lon_idx FROM ft", ["ft"]),
    "status_counts": ("SELECT status, count(*) AS n FROM (SELECT lat_idx, lon_idx, CASE WHEN bool_or(way_id % 4 = 0) THEN 'present' WHEN bool_or(way_id % 4 = 1) THEN 'failed' ELSE 'missing' END AS status FROM wt GROUP BY lat_idx, lon_idx) GROUP BY status", ["wt"]),
    "way_headings": (
        "SELECT way_id, round(mod(leave - entry + 540.0, 360.0) - 180.0, 4) AS turned, round(degrees(la), 6) AS lat, round(bo7 / 1e7 + degrees(atan2(sin(radians(leave)) * sin(d) * cos(lo), cos(d) - sin(lo) * sin(la))), 6) AS lon FROM (SELECT *, asin(sin(lo) * cos(d) + cos(lo) * sin(d) * cos(radians(leave))) AS la FROM (SELECT *, radians(b7 / 1e7) AS lo, 1000.0 / 6371000.0 AS d FROM wend JOIN wdir USING (way_id)))",
        ["wend", "wdir"],
    ),
    "circle_tiles": (
        f"SELECT way_id, lat_idx, unnest(range(j, greatest(jj, j) + 1)) AS lon_idx FROM (SELECT way_id, j, jj, unnest(range(i, greatest(ii, i) + 1)) AS lat_idx FROM (SELECT way_id, CAST(floor((lat - dy) / {TILE}) AS BIGINT) AS i, CAST(ceil((lat + dy) / {TILE}) AS BIGINT) - 1 AS ii, CAST(floor((lon - dx) / {TILE}) AS BIGINT) AS j, CAST(ceil((lon + dx) / {TILE}) AS BIGINT) - 1 AS jj FROM (SELECT *, 3.0 / 111.32 AS dy, 3.0 / (111.32 * cos(radians(lat))) AS dx FROM ft)))",
        ["ft"],
    ),
    "valid_points": ("SELECT way_id, lat * 2.5 BETWEEN -90 AND 90 AND lon * 2.1 BETWEEN -180 AND 180 AS valid FROM ft", ["ft"]),
    "route_durations": ("SELECT request_id, route_idx, CASE WHEN m >= 60 THEN CAST(m // 60 AS VARCHAR) || 'h' || CAST(m % 60 AS VARCHAR) || 'm' ELSE CAST(m AS VARCHAR) || 'm' END AS text FROM (SELECT *, CAST(floor(duration / 60) AS BIGINT) AS m FROM dur)", ["dur"]),
    "ride_cells": (
        f"SELECT c_custkey AS request_id, round(35 * 1.60934 * 2 / (2 * pi()), 4) AS radius_km, CAST(floor({hav('lat', 'lon', 'lat + 0.01', 'lon')} / 500) AS BIGINT) AS i, CAST(floor({hav('lat', 'lon', 'lat', 'lon + 0.01')} / 500) AS BIGINT) AS j FROM (SELECT c_custkey, 35.0 + (c_custkey % 50) * 0.2 AS lat, -85.0 + floor(c_custkey / 50.0) * 0.2 AS lon FROM customer)",
        [],
    ),
    "way_inspection": ("SELECT k.way_id, count(*) AS n_points FROM key JOIN kept k ON k.way_id = key.way_id JOIN n ON n.way_id = k.way_id WHERE group_key = 'R1' AND contains(ref, 'R1') GROUP BY k.way_id HAVING count(*) >= 2", ["key", "kept", "n"]),
    "raw_way_kml": (
        "SELECT group_key, way_id, seq, '<Folder><name>Way ' || way_id || '</name><description>name=' || group_key || ' | ref=' || coalesce(ref, '') || ' | highway=' || highway || ' | nodes=' || n || '</description><Placemark><name>Way ' || way_id || '</name><Style><LineStyle><color>' "
        f"|| ({export.PALETTE!r})[seq % {len(export.PALETTE)} + 1] || '</color><width>4</width></LineStyle></Style><LineString><coordinates>' || line || '</coordinates></LineString></Placemark></Folder>' AS folder "
        "FROM (SELECT t.name AS group_key, t.way_id, t.ref, t.highway, n, line, row_number() OVER (PARTITION BY t.name ORDER BY coalesce(lat7, 0), coalesce(lon7, 0), t.way_id) - 1 AS seq FROM tag t LEFT JOIN "
        f"(SELECT way_id, count(*) AS n, arg_min(lat7, node_idx) AS lat7, arg_min(lon7, node_idx) AS lon7, string_agg({six('lon7')} || ',' || {six('lat7')} || ',0', ' ' ORDER BY node_idx) AS line FROM nodes GROUP BY way_id) g ON g.way_id = t.way_id WHERE t.name IS NOT NULL) WHERE n >= 2",
        ["tag", "nodes"],
    ),
    "kml_entries": (
        "SELECT name, string_agg(CAST(way_id AS VARCHAR), ',' ORDER BY way_id) AS way_ids, CAST(sum(n) AS BIGINT) + 1 AS n_points FROM (SELECT name, way_id, count(*) AS n FROM rseg WHERE name LIKE 'R1%' GROUP BY name, way_id) GROUP BY name",
        ["rseg"],
    ),
    "route_gpx": (
        f"""SELECT request_id, route_idx, '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="hairpin" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>Route ' || CAST(request_id AS VARCHAR) || '-' || CAST(route_idx AS VARCHAR) || '</name><trkseg>' || string_agg('<trkpt lat="' || {six('lat7')} || '" lon="' || {six('lon7')} || '"></trkpt>', '' ORDER BY pt_idx) || '</trkseg></trk></gpx>' AS document FROM route GROUP BY request_id, route_idx""",
        ["route"],
    ),
    "route_kml": (
        f"""SELECT request_id, route_idx, '{export.KML_HEAD}<Placemark><name>Route ' || CAST(request_id AS VARCHAR) || '-' || CAST(route_idx AS VARCHAR) || '</name><Style><LineStyle><color>ff0000ff</color><width>4</width></LineStyle></Style><LineString><coordinates>' || string_agg({six('lon7')} || ',' || {six('lat7')} || ',0', ' ' ORDER BY pt_idx) || '</coordinates></LineString></Placemark>{export.KML_FOOT}' AS document FROM route GROUP BY request_id, route_idx""",
        ["route"],
    ),
    "leg_snaps": (
        f"SELECT r.request_id, r.route_idx, round({hav('z.lat', 'z.lon', 'r.lat', 'r.lon')}, 2) AS start_m, round({hav('z.lat1', 'z.lon1', 'r.lat1', 'r.lon1')}, 2) AS end_m, greatest({hav('z.lat', 'z.lon', 'r.lat', 'r.lon')}, {hav('z.lat1', 'z.lon1', 'r.lat1', 'r.lon1')}) > 150 AS gap FROM rends r JOIN rends z ON z.request_id = r.request_id AND z.route_idx = 0",
        ["rends"],
    ),
    "ride_waypoints": ("SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY bearing, group_key, sub_index) AS INTEGER) AS stop, group_key, CAST(sub_index AS INTEGER) AS sub_index, round(bearing, 3) AS bearing, round(away, 1) AS away_m FROM lot", ["lot"]),
    "sector_lobes": ("SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY back, CASE WHEN back THEN -away ELSE away END, group_key, sub_index) AS INTEGER) AS stop, group_key, CAST(sub_index AS INTEGER) AS sub_index, round(bearing, 3) AS bearing, round(away, 1) AS away_m FROM lobes", ["lobes"]),
    "ride_chains": ("SELECT request_id, step, group_key, sub_index, reversed, round(used, 1) AS used FROM ridewalk", ["ridewalk"]),
    "ride_stops": ("SELECT group_key AS request_id, row_number() OVER (PARTITION BY group_key ORDER BY o) - 1 AS stop, round(lat, 7) AS lat, round(lon, 7) AS lon FROM rdwalk WHERE keep", ["rdwalk"]),
    "dense_stops": ("SELECT group_key, row_number() OVER (PARTITION BY group_key ORDER BY o) - 1 AS stop, round(lat, 7) AS lat, round(lon, 7) AS lon FROM dwalk WHERE keep", ["dwalk"]),
    "refreshed_roads": (
        "SELECT group_key, n_ways, round(s, 2) AS total_score, round(l, 2) AS total_length FROM road",
        ["road"],
        {
            "tag0": PARTS["tag"],
            "tag": (
                "SELECT t.way_id, CASE WHEN h % 7 = 0 THEN name || ' (new)' ELSE name END AS name, CAST(NULL AS VARCHAR) AS ref, highway, surface, access, oneway, maxspeed FROM tag0 t LEFT JOIN (SELECT way_id, CAST(floor(lat7 / 1e7) * 31 + floor(lon7 / 1e7) AS BIGINT) AS h FROM nodes WHERE node_idx = 0) f ON f.way_id = t.way_id WHERE coalesce(h % 11, 1) <> 0",
                ["tag0", "nodes"],
            ),
        },
    ),
    "tile_feed": (
        "WITH t AS (SELECT lat_idx, lon_idx, min(way_id) AS w FROM wt GROUP BY lat_idx, lon_idx), s AS (SELECT 0 AS batch, 'pending' AS status FROM t UNION ALL SELECT 1, CASE w % 4 WHEN 0 THEN 'cached' WHEN 1 THEN 'failed' ELSE 'pending' END FROM t UNION ALL SELECT 2, CASE WHEN w % 4 = 0 THEN 'cached' WHEN w % 8 = 5 THEN 'failed' ELSE 'pending' END FROM t) SELECT CAST(batch AS BIGINT) AS batch, status, count(*) AS n FROM s GROUP BY ALL",
        ["wt"],
    ),
    "rescored_tiles": ("SELECT CAST(floor(lat) AS BIGINT) || '_' || CAST(floor(lon) AS BIGINT) AS tile, CASE WHEN bool_or(way_id % 50 = 0) THEN 2 ELSE 1 END AS versions FROM ft GROUP BY tile", ["ft"]),
    "unique_segments": ("SELECT count(*) AS n FROM (SELECT DISTINCT way_id, lat, lon FROM seg JOIN kept USING (way_id))", ["seg", "kept"]),
    "tile_features": ("SELECT tier, count(*) AS n, round(sum(length), 1) AS length FROM seg JOIN kept USING (way_id) GROUP BY tier", ["seg", "kept"]),
}


def _sql(text: str, parts: list[str], other: dict[str, tuple[str, list[str]]] | None = None) -> str:
    """The query with the parts that it needs; ``other`` parts stand in for those of the same name."""
    known, order = PARTS | (other or {}), []

    def add(name: str) -> None:
        if name not in order:
            for one in known[name][1]:
                add(one)
            order.append(name)

    for p in parts:
        add(p)
    if not order:
        return text
    if text.startswith("WITH "):
        text = text.removeprefix("WITH ")
        return f"WITH {', '.join(f'{p} AS ({known[p][0]})' for p in order)}, {text}"
    return f"WITH {'RECURSIVE ' if {'reach', 'fwalk', 'prim'} & {*order} else ''}{', '.join(f'{p} AS ({known[p][0]})' for p in order)} {text}"


def oracle_sql() -> dict[str, str]:
    return {name: _sql(*spec) for name, spec in TEXTS.items()}
