"""Chain order of components of any size: ways between two junctions are ranked by pointer jumping, only stretches go through the fold.

The order is that of :func:`hairpin.operators.assemble.chain`. A point where two ways meet and no third leaves no choice, so the chain runs
through a stretch of such ways to its end, or to the first oneway that it would enter from behind.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hairpin.plans.lineage import discard, store


def turn_of(a: float, b: float) -> float:
    return abs((b - a + 180) % 360 - 180)


def follow(rows: list[dict], start: tuple[int, bool]) -> list[tuple[int, bool, int, int]]:
    """(way_id, flip, base, taken) of the stretches that the chain of one component runs through, in order: base ways come before a
    stretch, and taken ways of it are in the chain. A row is one direction of a stretch, named by its first way and whether that is flipped;
    twin names the other one."""
    by_point: dict[tuple, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["way_id"], r["flip"])):
        by_point.setdefault((r["p"]["y"], r["p"]["x"]), []).append(r)
    at = next(r for r in rows if (r["way_id"], r["flip"]) == start)
    seen, base, out = set(), 0, []
    while at is not None:
        seen |= {(at["way_id"], at["flip"]), (at["twin"]["way_id"], at["twin"]["flip"])}
        taken = at["n"] if at["barred"] is None else at["barred"]
        out.append((at["way_id"], at["flip"], base, taken))
        base += taken
        if taken < at["n"]:
            break
        further = [r for r in by_point.get((at["q"]["y"], at["q"]["x"]), []) if (r["way_id"], r["flip"]) not in seen and r["barred"] != 0]
        at = min(further, key=lambda r: turn_of(at["leave"], r["enter"]), default=None)  # noqa: B023
    return out


def ranked(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, way_id, flip, to_way, to_flip, dist): the last way of the stretch that each way, run in each direction, is in, and how many
    steps away. ``edges`` leads from some of the ``nodes`` to the next (next_way, next_flip). Rings without an end have no rows.

    The pointers of a round lead to different nodes until they are at an end, and nodes at their end stop, so no key of a join is hot.
    """
    at = [key, "way_id", "flip"]
    first = nodes.select(*at).join(edges, at, "left")
    state = store(
        first.select(*at, F.coalesce("next_way", "way_id").alias("to_way"), F.coalesce("next_flip", "flip").alias("to_flip"), F.when(F.col("next_way").isNull(), 0).otherwise(1).cast("long").alias("dist"), F.col("next_way").isNull().alias("done"))
    )
    open_, before = state.where("NOT done").count(), None
    while open_ and open_ != before:
        there = state.select(key, F.col("way_id").alias("to_way"), F.col("flip").alias("to_flip"), F.col("to_way").alias("w"), F.col("to_flip").alias("f"), F.col("dist").alias("more"), F.col("done").alias("end"))
        jumped = state.where("NOT done").join(there, [key, "to_way", "to_flip"])
        jumped = jumped.select(*at, F.col("w").alias("to_way"), F.col("f").alias("to_flip"), (F.col("dist") + F.col("more")).alias("dist"), F.col("end").alias("done"))
        old, state = state, store(state.where("done").unionByName(jumped))
        discard(old)
        open_, before = state.where("NOT done").count(), open_
    return state.where("done").drop("done")


def order(ways: DataFrame, key: str) -> DataFrame:
    """(key, way_id, pos, reversed) of ``ways`` (key, component, way_id, oneway, a, b, entry, exit, back_entry, back_exit); a and b are points
    of whole numbers (y, x). One row for each direction of a stretch goes through Python, all others stay in the JVM."""
    group = [key, "component"]
    rows = store(ways)
    sides = rows.select(*group, "way_id", "oneway", F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("a").alias("p")), F.struct(F.lit(True).alias("back"), F.col("b").alias("p")))).alias("s")).select(*group, "way_id", "oneway", "s.*")
    end = F.struct("way_id", "back", "oneway")
    points = store(sides.groupBy(*group, "p").agg(F.count("*").alias("n"), F.min(end).alias("e"), F.max(end).alias("f")))
    # where the chain begins: at the least terminus that isn't a oneway's end, else at the first way, of which a stretch of its own is made
    terminus = points.where("n = 1 AND NOT (e.back AND e.oneway)").groupBy(*group).agg(F.min(F.struct("p", "e")).alias("t"))
    first = rows.groupBy(*group).agg(F.min(F.struct("way_id", "a", "b")).alias("w"))
    starts = store(first.join(terminus, group, "left").select(*group, F.coalesce("t.e.way_id", "w.way_id").alias("start_way"), F.coalesce("t.e.back", F.lit(False)).alias("start_flip"), F.when(F.col("t").isNull(), F.array("w.a", "w.b")).alias("parted")))
    through = points.where("n = 2 AND e.way_id <> f.way_id").join(starts, group).where("parted IS NULL OR NOT array_contains(parted, p)")
    step = lambda x, y: F.struct(F.col(f"{x}.way_id").alias("way_id"), (~F.col(f"{x}.back")).alias("flip"), F.col(f"{y}.way_id").alias("next_way"), F.col(f"{y}.back").alias("next_flip"))
    edges = through.select(key, F.explode(F.array(step("e", "f"), step("f", "e"))).alias("x")).select(key, "x.*")
    nodes = rows.withColumn("flip", F.explode(F.array(F.lit(False), F.lit(True))))
    after = ranked(nodes, edges, key)
    # the steps before a way are those after it when it is run the other way, and the first way is the last one of that direction
    behind = after.select(key, "way_id", (~F.col("flip")).alias("flip"), F.col("to_way").alias("head_way"), (~F.col("to_flip")).alias("head_flip"), F.col("dist").alias("place"))
    facing = lambda x, y: F.when(F.col("flip"), F.col(y)).otherwise(F.col(x))
    placed = nodes.select(*group, "way_id", "flip", (F.col("flip") & F.col("oneway")).alias("bar"), facing("a", "b").alias("p"), facing("b", "a").alias("q"), facing("entry", "back_entry").alias("enter"), facing("exit", "back_exit").alias("leave"))
    placed = store(placed.join(behind, [key, "way_id", "flip"]))
    lines = placed.groupBy(*group, F.col("head_way").alias("way_id"), F.col("head_flip").alias("flip")).agg(
        F.count("*").alias("n"), F.min(F.when(F.col("bar"), F.col("place"))).alias("barred"), F.min_by(F.struct("p", "enter"), "place").alias("h"),
        F.max_by(F.struct("q", "leave", F.struct("way_id", (~F.col("flip")).alias("flip")).alias("twin")), "place").alias("t"),
    )
    lines = lines.select(*group, "way_id", "flip", "n", "barred", "h.*", "t.*").join(starts.drop("parted"), group)
    kind = ways.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        found = table.to_pylist()
        own = follow(found, (found[0]["start_way"], found[0]["start_flip"]))
        columns = list(zip(*own, strict=True))
        return pa.table({key: [found[0][key]] * len(own), "head_way": columns[0], "head_flip": columns[1], "base": columns[2], "taken": columns[3]})

    chosen = store(lines.groupBy(*group).applyInArrow(run, f"{key} {kind}, head_way long, head_flip boolean, base long, taken long"))
    along = placed.join(chosen, [key, "head_way", "head_flip"]).where("place < taken").select(*group, "way_id", (F.col("base") + F.col("place")).alias("pos"), F.col("flip").alias("reversed"))
    along = store(along)
    used = along.groupBy(*group).agg(F.count("*").alias("used"))
    left = rows.select(*group, "way_id").join(along.select(key, "way_id"), [key, "way_id"], "left_anti").join(used, group)
    left = left.select(key, "way_id", (F.col("used") + F.row_number().over(Window.partitionBy(*group).orderBy("way_id")) - 1).alias("pos"), F.lit(False).alias("reversed"))
    out = store(along.select(key, "way_id", "pos", "reversed").unionByName(left).withColumn("pos", F.col("pos").cast("int")))
    discard(rows, points, starts, after, placed, chosen, along)
    return out
