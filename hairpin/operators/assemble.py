"""From grouped ways to continuous roads: proximity links, components, chains, gaps, wobbles and straights."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hairpin.functions import geo, tags
from hairpin.operators import squares, stretches
from hairpin.operators.components import connected_components
from hairpin.operators.stretches import turn_of
from hairpin.plans.lineage import discard, store

NEAR_M = 100.0
STRAIGHT_M = 2414.0
LOOK_AHEAD_M = 2400.0
MIN_TURN = 20.0
#: Components of more ways are ordered by their stretches.
FOLDED_WAYS = 20000
#: Degrees of latitude of a cell: a little more than twice NEAR_M, so that most ends are copied to few cells.
CELL = 0.002


def _across(lon, band):
    """Where a longitude lies in a band of latitude, in cells; a cell is as wide as a band is high, or wider."""
    return lon * F.cos(F.radians((F.abs(band) + 2) * CELL)) / CELL


def proximity_links(ends: DataFrame, key: str = "group_key", near_m: float = NEAR_M) -> DataFrame:
    """(key, a, b) of the ways of a group, a < b, with ends within ``near_m``.

    An equi-join on (key, cell): one side is copied to the cells that ``near_m`` reaches, the distance is checked on what meets.
    """
    reach = near_m / 111_000.0 / CELL
    floor = lambda c: F.floor(c).cast("long")
    rows = ends.where(F.col("first").isNotNull()).select(key, "way_id", F.explode(F.array("first", "last")).alias("p"))
    up = F.col("p.lat") / CELL
    left = rows.select(key, F.col("way_id").alias("a"), F.col("p").alias("pa"), floor(up).alias("band"))
    left = left.withColumn("col", floor(_across(F.col("pa.lon"), F.col("band"))))
    probe = rows.select(key, F.col("way_id").alias("b"), F.col("p").alias("pb"), F.explode(F.sequence(floor(up - reach), floor(up + reach))).alias("band"))
    at = _across(F.col("pb.lon"), F.col("band"))
    right = probe.select(key, "b", "pb", "band", F.explode(F.sequence(floor(at - reach), floor(at + reach))).alias("col"))
    met = left.join(right, [key, "band", "col"]).where((F.col("a") < F.col("b")) & (geo.haversine(F.col("pa"), F.col("pb")) <= near_m))
    return met.select(key, "a", "b").distinct()


def components(ends: DataFrame, links: DataFrame, key: str = "group_key") -> DataFrame:
    """``ends`` with component: the smallest way_id that is reached within the group; a way without links is its own."""
    vertex = lambda c: F.struct(F.col(key), F.col(c).alias("way_id"))
    found = connected_components(links.select(vertex("a").alias("a"), vertex("b").alias("b")), "a", "b")
    named = found.select(F.col(f"id.{key}").alias(key), F.col("id.way_id").alias("way_id"), F.col("component.way_id").alias("_c"))
    return ends.join(named, [key, "way_id"], "left").withColumn("component", F.coalesce("_c", "way_id")).drop("_c")


def near_components(ends: DataFrame, key: str = "group_key", near_m: float = NEAR_M) -> DataFrame:
    """``ends`` with component, as :func:`components` gives it for :func:`proximity_links`, without a table of links.

    Ends are dealt out by (key, square), those near a border to the neighbours as well; a task joins what meets in a square, see
    :mod:`hairpin.operators.squares`, and gives each way the smallest one that it reaches there. Only ways that got different ones in several
    squares make links, and these go through :func:`connected_components`.
    """
    reach, square = near_m / 111_000.0, near_m * squares.SQUARE
    at = lambda c: F.floor(c / square).cast("long")
    rows = ends.where(F.col("first").isNotNull()).select(key, "way_id", F.inline(F.array("first", "last")))
    wide = F.least(reach / F.cos(F.radians(F.least(F.abs("lat") + 2 * reach, F.lit(89.9999)))), F.lit(360.0))
    rows = rows.withColumns({"_wide": wide, "band": F.explode(F.sequence(at(F.col("lat") - reach), at(F.col("lat") + reach)))})
    rows = rows.withColumn("col", F.explode(F.sequence(at(F.col("lon") - F.col("_wide")), at(F.col("lon") + F.col("_wide"))))).drop("_wide")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [key, "band", "col"]):
            yield from squares.joined(table, key, near_m)

    kind = ends.schema[key].dataType.simpleString()
    dealt = rows.repartition(key, "band", "col").sortWithinPartitions(key, "band", "col")
    own = store(dealt.mapInArrow(run, f"{key} {kind}, way_id long, root long"))
    least = store(own.groupBy(key, "way_id").agg(F.min("root").alias("_c"), (F.min("root") < F.max("root")).alias("_several")))
    vertex = lambda c: F.struct(F.col(key), F.col(c).alias("way_id"))
    links = own.join(least.where("_several").drop("_several"), [key, "way_id"]).where(F.col("root") != F.col("_c"))
    met = connected_components(links.select(vertex("root").alias("a"), vertex("_c").alias("b")), "a", "b")
    discard(own)
    further = met.select(F.col(f"id.{key}").alias(key), F.col("id.way_id").alias("_c"), F.col("component.way_id").alias("_to"))
    named = least.join(further, [key, "_c"], "left").select(key, "way_id", F.coalesce("_to", "_c").alias("_c"))
    return ends.join(named, [key, "way_id"], "left").withColumn("component", F.coalesce("_c", "way_id")).drop("_c")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of ``batches``, which are in order of ``keys``, in tables that hold every group whole: it may go on in the next batch, so the last
    one's rows are kept until another begins."""
    left: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        same = pc.equal(table[keys[0]], table[keys[0]][-1])
        for k in keys[1:]:
            same = pc.and_(same, pc.equal(table[k], table[k][-1]))
        begins = pc.index(same, True).as_py()
        if begins or (left and any(left[-1][k][-1] != table[k][0] for k in keys)):
            yield pa.concat_tables([*left, table.slice(0, begins)]).combine_chunks()
            left = []
        left.append(table.slice(begins))
    if left:
        yield pa.concat_tables(left).combine_chunks()


def chain(ways: list[dict]) -> list[tuple[int, int, bool]]:
    """(way_id, pos, reversed) of the ways of one component, given in order of way_id.

    A way: way_id, oneway, ends a and b (pairs of coordinates or None), bearings entry, exit, back_entry and back_exit.
    """
    touching: dict[tuple, list[tuple[int, bool]]] = {}
    for i, w in enumerate(ways):
        if w["a"] is not None:
            touching.setdefault(w["a"], []).append((i, False))
            touching.setdefault(w["b"], []).append((i, True))
    # a terminus is touched once; a oneway's end isn't a start
    starts = [(p, e[0]) for p, e in touching.items() if len(e) == 1 and not (e[0][1] and ways[e[0][0]]["oneway"])]
    at, flip = min(starts)[1] if starts else (0, False)
    left, out = set(range(len(ways))), []
    while True:
        left.discard(at)
        out.append((at, flip))
        w = ways[at]
        if w["a"] is None:
            break
        end = w["a"] if flip else w["b"]
        heading = w["back_exit"] if flip else w["exit"]
        best = None
        for i, backwards in touching.get(end, []):
            if i in left and not (backwards and ways[i]["oneway"]):
                enter = ways[i]["back_entry"] if backwards else ways[i]["entry"]
                angle = turn_of(heading, enter)
                if best is None or angle < best[0]:
                    best = (angle, i, backwards)
        if best is None:
            break
        _, at, flip = best
    out += [(i, False) for i in sorted(left)]
    return [(ways[i]["way_id"], pos, flip) for pos, (i, flip) in enumerate(out)]


def chained(table: pa.Table, key: str, columns: list[str]) -> list[pa.RecordBatch]:
    """``columns`` of the components in ``table``, whose rows are in order of key, component and way_id, with pos and reversed."""
    names, parts, ids, oneway = (table[c].to_pylist() for c in (key, "component", "way_id", "_oneway"))
    ay, ax, by, bx, *bearings = (table[c].to_pylist() for c in ("_ay", "_ax", "_by", "_bx", "entry", "exit", "back_entry", "back_exit"))
    place, reverse = [0] * len(ids), [False] * len(ids)
    begin = 0
    for end in range(1, len(ids) + 1):
        if end == len(ids) or parts[end] != parts[begin] or names[end] != names[begin]:
            rows = [
                {"way_id": i, "oneway": oneway[i], "a": None if ay[i] is None else (ay[i], ax[i]), "b": None if by[i] is None else (by[i], bx[i])}
                | {c: v[i] for c, v in zip(("entry", "exit", "back_entry", "back_exit"), bearings, strict=True)}
                for i in range(begin, end)
            ]
            for i, pos, flip in chain(rows):
                place[i], reverse[i] = pos, flip
            begin = end
    out = table.select(columns).append_column("pos", pa.array(place, pa.int32())).append_column("reversed", pa.array(reverse, pa.bool_()))
    return out.combine_chunks().to_batches()


def ordered(ends: DataFrame, key: str = "group_key", folded: int = FOLDED_WAYS) -> DataFrame:
    """``ends`` with pos and reversed: the place in its component's chain.

    Python sees one small row for each way of a component with several; single ways never leave the JVM. Components of more than
    ``folded`` ways, read once to find them, are ordered by :mod:`hairpin.operators.stretches` instead, with the same result. Ends are
    matched on coordinates in units of 1e-7 degrees.
    """
    # in one order with what Python reads, so that rows are moved and sorted once
    sized = ends.withColumn("_n", F.count("*").over(Window.partitionBy(key, "component").orderBy("way_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    unit = lambda p, c: F.round(F.col(f"{p}.{c}") * 1e7).cast("long")
    oneway = (F.coalesce(F.col("oneway"), F.lit("")) == "yes").alias("_oneway")
    thin = sized.where(f"_n > 1 AND _n <= {folded}").select(*ends.columns, oneway, *[unit(p, c).alias(f"_{n}{y}") for p, n in (("first", "a"), ("last", "b")) for c, y in (("lat", "y"), ("lon", "x"))])
    columns = ends.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, [key, "component"]):
            yield from chained(table, key, columns)

    # many components a task, one after the other: a call for each would cost more than the chain
    shape = T.StructType([*ends.schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("reversed", T.BooleanType())])
    placed = thin.sortWithinPartitions(key, "component", "way_id").mapInArrow(run, shape)
    long = ends.groupBy(key, "component").agg(F.count("*").alias("_n")).where(F.col("_n") > folded).select(key, "component")
    if not long.isEmpty():
        rows = ends.join(long, [key, "component"], "left_semi")
        at = lambda p: F.when(F.col(p).isNotNull(), F.struct(unit(p, "lat").alias("y"), unit(p, "lon").alias("x")))
        own = rows.select(key, "component", "way_id", oneway.alias("oneway"), at("first").alias("a"), at("last").alias("b"), "entry", "exit", "back_entry", "back_exit")
        placed = placed.unionByName(rows.join(stretches.order(own, key), [key, "way_id"]))
    return placed.unionByName(sized.where("_n = 1").drop("_n").withColumns({"pos": F.lit(0), "reversed": F.lit(False)}))


def with_gaps(placed: DataFrame, key: str = "group_key", gap_m: float = NEAR_M) -> DataFrame:
    """``placed`` with chunk: a new one begins where the next way starts more than ``gap_m`` from the end. Where rows have n_segments, also with
    offset: how many segments of the chunk come before the way's."""
    w = Window.partitionBy(key, "component").orderBy("pos")
    begin, end = F.when(F.col("reversed"), F.col("last")).otherwise(F.col("first")), F.when(F.col("reversed"), F.col("first")).otherwise(F.col("last"))
    gap = F.coalesce(geo.haversine(F.lag(end).over(w), begin) > gap_m, F.lit(False))
    out = placed.withColumn("_gap", gap.cast("int")).withColumn("chunk", F.sum("_gap").over(w))
    if "n_segments" in placed.columns:
        before = F.coalesce(F.sum("n_segments").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn("_before", before)
        out = out.withColumn("offset", F.col("_before") - F.coalesce(F.max(F.when(F.col("_gap") == 1, F.col("_before"))).over(w), F.lit(0))).drop("_before")
    return out.drop("_gap")


def flattened(chunks: DataFrame, key: str = "group_key") -> DataFrame:
    """The segments of each chunk in one sequence idx, 0-based; those of reversed ways run backwards. Places are counted by way: segments
    aren't sorted."""
    if "offset" not in chunks.columns:
        before = Window.partitionBy(key, "component", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        chunks = chunks.withColumn("offset", F.coalesce(F.sum(F.size("segments")).over(before), F.lit(0)))
    # seg_idx counts a way's segments from 0
    s = chunks.select(key, "component", "chunk", "pos", "reversed", "way_id", "highway", "maxspeed", "offset", F.size("segments").alias("_n"), F.inline_outer("segments")).where("seg_idx IS NOT NULL")
    place = F.when(F.col("reversed"), F.col("_n") - 1 - F.col("seg_idx")).otherwise(F.col("seg_idx"))
    return s.select(
        key, "component", "chunk", "pos", "way_id", "highway", "maxspeed", "seg_idx",
        F.when(F.col("reversed"), F.col("end")).otherwise(F.col("start")).alias("start"), F.when(F.col("reversed"), F.col("start")).otherwise(F.col("end")).alias("end"),
        "radius", "tier", "weight", "length", "score", (F.col("offset") + place).cast("int").alias("idx"),
    )


def wobbles(flat: DataFrame, key: str = "group_key") -> DataFrame:
    """(key, component, chunk, idx, _until, _o): the stretches of chunks where the road's heading changes little over the look-ahead, as rows before
    their first segments that say where they end.

    Where a window ends and how much it turns are prefix sums; of the windows that fire, those that begin in an
    earlier one are skipped, in a fold over the firing windows alone.
    """
    parts = [key, "component", "chunk"]
    w = Window.partitionBy(*parts).orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    b = flat.withColumn("_b", geo.bearing(F.col("start"), F.col("end")))
    b = b.withColumns({"_at": F.coalesce(F.sum("length").over(before), F.lit(0.0)), "_t": F.coalesce(geo.turn(F.lag("_b").over(w), F.col("_b")), F.lit(0.0))})
    b = b.withColumn("_turned", F.sum("_t").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # strictly within the look-ahead: the segment that crosses its end is the last one that begins in it
    ahead = f"PARTITION BY {', '.join(parts)} ORDER BY _at RANGE BETWEEN CURRENT ROW AND {math.nextafter(LOOK_AHEAD_M, 0)!r}D FOLLOWING"
    b = b.withColumn("_e", F.expr(f"max(struct(idx, _turned)) OVER ({ahead})"))
    fires = b.where((F.col("score") != 0) & (F.col("_e._turned") - F.col("_turned") < MIN_TURN))
    windows = fires.groupBy(*parts).agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), F.col("_e.idx").alias("e")))).alias("f"))
    empty = F.array().cast("array<struct<i:int,e:int>>")
    kept = F.aggregate("f", empty, lambda s, x: F.when(F.coalesce(F.try_element_at(s, F.lit(-1)).e < x.i, F.lit(True)), F.concat(s, F.array(x))).otherwise(s))
    return windows.select(*parts, F.explode(kept).alias("k")).select(*parts, F.col("k.i").alias("idx"), F.col("k.e").alias("_until"), F.lit(0).alias("_o"))


def without_wobbles(flat: DataFrame, key: str = "group_key", marks: DataFrame | None = None) -> DataFrame:
    """``flat`` with score, tier and weight zeroed where the road's heading changes little over the look-ahead; was_score and was_tier keep theirs.
    ``marks``: the :func:`wobbles`, where they are known."""
    parts = [key, "component", "chunk"]
    marks = wobbles(flat, key) if marks is None else marks
    # they don't overlap, so the last end so far decides
    rows = flat.withColumn("_o", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    so_far = Window.partitionBy(*parts).orderBy("idx", "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_z", F.coalesce(F.max("_until").over(so_far) >= F.col("idx"), F.lit(False))).where("_o = 1").drop("_o", "_until")
    out = rows.withColumns({"was_score": F.col("score"), "was_tier": F.col("tier")})
    z = F.col("_z")
    zero = {"score": F.when(z, 0.0).otherwise(F.col("score")), "weight": F.when(z, 0.0).otherwise(F.col("weight")) if "weight" in flat.columns else None, "tier": F.when(z, 0).otherwise(F.col("tier"))}
    return out.withColumns({c: v for c, v in zero.items() if v is not None}).drop("_z")


def straights(flat: DataFrame, key: str = "group_key", straight_m: float = STRAIGHT_M) -> DataFrame:
    """``flat`` with piece, the number of straight runs longer than ``straight_m`` so far, and with _long where a segment is in one; _none in the first
    row of a chunk that is one."""
    parts = [key, "component", "chunk"]
    w = Window.partitionBy(*parts).orderBy("idx")
    straight = F.col("tier") == 0
    begins = (F.coalesce(F.lag(straight).over(w) != straight, F.lit(True))).cast("int")
    r = flat.withColumn("_begin", begins).withColumn("_run", F.sum("_begin").over(w))
    r = r.withColumn("_len", F.sum("length").over(Window.partitionBy(*parts, "_run")))
    long = straight & (F.col("_len") > straight_m)
    r = r.withColumn("_long", long).withColumn("piece", F.sum((F.col("_long") & (F.col("_begin") == 1)).cast("int")).over(w))
    none = F.min("_long").over(Window.partitionBy(*parts)) & (F.col("idx") == 0)
    return r.withColumn("_none", none).drop("_begin", "_run", "_len")


def split_straights(flat: DataFrame, key: str = "group_key", straight_m: float = STRAIGHT_M) -> DataFrame:
    """``flat`` without the straight runs longer than ``straight_m``, with piece: the number of such runs before.

    A chunk of which nothing stays is one empty piece: a row without way_id and without length.
    """
    r = straights(flat, key, straight_m).where(~F.col("_long") | F.col("_none"))
    gone = {c: F.when(~F.col("_none"), F.col(c)) for c in ("way_id", "highway", "maxspeed") if c in flat.columns}
    zero = {c: F.when(F.col("_none"), 0.0).otherwise(F.col(c)) for c in ("length", "score")}
    return r.withColumns({**gone, **zero, "piece": F.when(F.col("_none"), 0).otherwise(F.col("piece"))}).drop("_long", "_none")


def numbered_pieces(flat: DataFrame, key: str = "group_key") -> DataFrame:
    """The segments of all roads as :func:`split_straights` leaves them of :func:`without_wobbles`, with the sub_index that :func:`build_roads` gives their road.

    Only what decides where roads begin is read to count them, chunk by chunk; the segments themselves are moved once, by chunk, and meet the
    number of their chunk's first road there.
    """
    parts = [key, "component", "chunk"]
    marks = store(wobbles(flat, key))
    w = Window.partitionBy(*parts).orderBy("idx")
    split = lambda rows: split_straights(without_wobbles(rows, key, marks), key)
    counted = lambda rows: rows.withColumn("_p", F.sum(F.coalesce(F.lag("piece").over(w) != F.col("piece"), F.lit(False)).cast("int")).over(w))
    own = counted(split(flat.select(*parts, "idx", "tier", "length", "score"))).groupBy(*parts).agg((F.max("_p") + 1).alias("_m"))
    first = store(own.select(*parts, (F.sum("_m").over(Window.partitionBy(key).orderBy("component", "chunk")) - F.col("_m")).alias("_first")))
    return counted(split(flat)).join(first, parts).withColumn("sub_index", (F.col("_first") + F.col("_p")).cast("int")).drop("_first", "_p")


#: What a road's segments have after their place and way.
SEGMENT = ("seg_idx", "start", "end", "radius", "tier", "weight", "length", "score")


def build_roads(pieces: DataFrame, key: str = "group_key", fields: tuple[str, ...] = SEGMENT, **made: Column) -> DataFrame:
    """One row for each piece: totals, the ways and classes in the order in which they are first met, and speeds by way. An empty
    piece is a road without ways and length.

    sub_index counts the pieces of a group, ordered by component, chunk and piece. ``fields``: what segments have; length and score always.
    Columns ``made`` of the segments stand in their place, if given: the segments go before the roads of a group are brought together to be counted.
    """
    parts = [key, "component", "chunk", "piece"]
    held = [c for c in SEGMENT if c in fields or c in ("length", "score")]
    by_way = pieces.groupBy(*parts, "way_id").agg(
        F.min("idx").alias("_i"), F.first("highway").alias("highway"), F.first("maxspeed").alias("maxspeed"), F.sum("length").alias("_l"),
        F.collect_list(F.struct("idx", "way_id", *held)).alias("_s"),
    )
    row = F.struct("_i", "way_id", "highway", "maxspeed", F.col("_l").alias("l"), F.col("_s").alias("s"))
    rows = by_way.groupBy(*parts).agg(F.sort_array(F.collect_list(F.when(F.col("way_id").isNotNull(), row))).alias("w"))
    total = lambda f: F.aggregate("segments", F.lit(0.0), lambda s, x: s + x[f])
    rows = rows.select(*parts, *_of_ways(), F.sort_array(F.flatten(F.transform("w", lambda x: x.s))).alias("segments"))
    rows = rows.withColumns({"total_score": total("score"), "total_length": total("length"), **made})
    return _counted(rows.drop("segments") if made else rows, parts)


def summed_roads(pieces: DataFrame, key: str = "group_key", **inside: Column) -> DataFrame:
    """The rows of :func:`build_roads` with n_segments instead of the segments, and with their box (south, west, north, east) and the ends first and
    last; null without segments. Each of ``inside``, conditions on a segment, is a column that tells whether any meets it.

    Segments become sums by way as they come, and only a row for each way is held: nothing of a road but its ways is in one row.
    """
    parts = [key, "component", "chunk", "piece"]
    bound = lambda f, g, c: f(g(f"start.{c}"), g(f"end.{c}"))
    at = lambda f, p, c: f(F.col(f"{p}.{c}"), F.col("idx"))
    ends = {"first": (F.min_by, "start"), "last": (F.max_by, "end")}
    # class and speed are the way's own: as keys they need no aggregate of texts, for which rows would be sorted
    by_way = pieces.groupBy(*parts, "way_id", "highway", "maxspeed").agg(
        F.min("idx").alias("_i"), F.max("idx").alias("_j"), F.sum("length").alias("_l"), F.sum("score").alias("_s"), F.count("way_id").alias("_n"),
        bound(F.least, F.min, "lat").alias("south"), bound(F.least, F.min, "lon").alias("west"), bound(F.greatest, F.max, "lat").alias("north"), bound(F.greatest, F.max, "lon").alias("east"),
        *[at(f, p, c).alias(f"_{n}_{c}") for n, (f, p) in ends.items() for c in ("lat", "lon")], *[F.max(c).alias(n) for n, c in inside.items()],
    )
    some = F.col("way_id").isNotNull()
    point = lambda n: F.when(some, F.struct(F.col(f"_{n}_lat").alias("lat"), F.col(f"_{n}_lon").alias("lon")))
    box = {c: f(F.when(some, F.col(c))) for f, c in ((F.min, "south"), (F.min, "west"), (F.max, "north"), (F.max, "east"))}
    return roads_of_ways(by_way, key, **box, first=F.min_by(point("first"), "_i"), last=F.max_by(point("last"), "_j"), **{n: F.coalesce(F.max(F.col(n) & some), F.lit(False)) for n in inside})


def roads_of_ways(by_way: DataFrame, key: str = "group_key", **more: Column) -> DataFrame:
    """The rows of :func:`summed_roads` of what each way has of each piece: (key, component, chunk, piece, way_id, highway, maxspeed, _i, _l, _s, _n), its
    first place, length, score and number of segments there. ``more``: aggregates over these."""
    parts = [key, "component", "chunk", "piece"]
    row = F.struct("_i", "way_id", "highway", "maxspeed", F.col("_l").alias("l"), F.col("_s").alias("s"))
    whole = F.sort_array(F.collect_list(F.when(F.col("way_id").isNotNull(), row))).alias("w")
    rows = by_way.groupBy(*parts).agg(whole, F.sum("_n").alias("n_segments"), *[c.alias(n) for n, c in more.items()])
    total = lambda f: F.aggregate("w", F.lit(0.0), lambda s, x: s + x[f])
    return _counted(rows.select(*parts, *_of_ways(), "n_segments", *more, total("s").alias("total_score"), total("l").alias("total_length")), parts)


def _of_ways() -> list[Column]:
    """way_ids, highway_types and way_speeds of the ways w of a road."""
    classes = F.array_distinct(F.filter(F.transform("w", lambda x: x.highway), lambda h: h.isNotNull() & (h != "")))
    speeds = F.transform("w", lambda x: F.struct(tags.speed_mph(x.maxspeed).alias("speed_mph"), x.l.alias("length_m")))
    return [F.transform("w", lambda x: x.way_id).alias("way_ids"), classes.alias("highway_types"), speeds.alias("way_speeds")]


def _counted(rows: DataFrame, parts: list[str]) -> DataFrame:
    km = F.col("total_length") / 1000
    order = Window.partitionBy(parts[0]).orderBy(*parts[1:])
    return rows.withColumns({"score_per_km": F.when(km > 0, F.col("total_score") / km).otherwise(0.0), "sub_index": F.row_number().over(order) - 1})


def penalised(roads: DataFrame) -> DataFrame:
    f = tags.class_factor(F.col("highway_types"))
    return roads.withColumn("penalty_factor", f).withColumns({"penalized_score": F.col("total_score") * F.col("penalty_factor"), "penalized_per_km": F.col("score_per_km") * F.col("penalty_factor")})


def display_name(key: str = "group_key"):
    return F.when(F.col("sub_index") > 0, F.format_string("%s (%d)", F.col(key), F.col("sub_index") + 1)).otherwise(F.col(key))
