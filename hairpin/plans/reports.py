"""Reports of what each stage of the road table holds, for all groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.operators import assemble, segments
from hairpin.operators.ways import copy_keys, grouped, hard_filter
from hairpin.plans import roads
from hairpin.plans.lineage import cut, scratch, store


def _totals(ways: DataFrame) -> DataFrame:
    """(way_id, n, s, l), with the tile where there is one: the segments, score and length of each copy of a way."""
    keys = copy_keys(ways)
    t = segments.way_totals(segments.score_ways(ways.dropDuplicates(keys)), *keys[1:])
    return t.select(*keys, F.col("n_segments").alias("n"), F.col("score").alias("s"), F.col("length").alias("l"))


def stage_report(ways: DataFrame, min_score: float, min_mph: float) -> DataFrame:
    """(group_key, stage, n_ways, n_segments, n_parts, score, length) after each of ten stages.

    Parts are components, chunks, pieces or roads. Scores before the scoring stage are 0. The last stage has the roads that are published. What is
    left of each way after each stage is summed as the segments come; they are stored once, and no road is put together.
    """
    with scratch(ways.sparkSession) as keep:
        return keep(_stages(store(ways), min_score, min_mph))


def _stages(ways: DataFrame, min_score: float, min_mph: float) -> DataFrame:
    keys = copy_keys(ways)
    raw = grouped(ways).select("group_key", *keys).join(_totals(ways), keys)
    own, distinct = roads.kept_ways(ways)
    totals = store(_totals(own))
    kept = grouped(own).select("group_key", *keys).join(totals, keys)
    chunked = store(roads.chunks(own, distinct=distinct).select("group_key", "component", "chunk", "pos", "reversed", "offset", *keys))
    placed = chunked.select("group_key", "component", "chunk", *keys).join(totals, keys)
    flat = store(assemble.flattened(roads.with_segments(chunked, own, distinct=True)).drop("radius", "weight", "pos", "seg_idx"))
    whole = assemble.straights(assemble.without_wobbles(flat))
    stays = ~F.col("_long")
    of = lambda f, c: f(F.when(stays, F.col(c)))
    left = store(
        whole.groupBy("group_key", "component", "chunk", "piece", "way_id", "highway", "maxspeed").agg(
            F.count("*").alias("n"), F.sum("score").alias("s"), F.sum("length").alias("l"), F.count_if(stays).alias("_n"), of(F.sum, "score").alias("_s"), of(F.sum, "length").alias("_l"),
            of(F.min, "idx").alias("_i"), F.max("_none").alias("_none"),
        )
    )
    zero, one = F.lit(0.0), F.lit(1).cast("long")
    # a chunk of which nothing stays is one piece without ways
    some, rest = F.col("_n") > 0, left.where("_n > 0 OR _none")
    rest = rest.withColumns({"piece": F.when(some, F.col("piece")).otherwise(0), **{c: F.coalesce(c, zero) for c in ("_s", "_l")}, **{c: F.when(some, F.col(c)) for c in ("way_id", "highway", "maxspeed")}})
    table = store(assemble.penalised(assemble.roads_of_ways(rest)))

    def by_way(stage: str, rows: DataFrame, parts=one, score=None) -> DataFrame:
        return rows.groupBy("group_key").agg(F.lit(stage).alias("stage"), F.count("*").alias("n_ways"), F.sum("n").alias("n_segments"), parts.alias("n_parts"), (F.sum("s") if score is None else F.max(score)).alias("score"), F.sum("l").alias("length"))

    def by_part(stage: str, rows: DataFrame, *parts: str, n: str, s: str, l: str) -> DataFrame:  # noqa: E741
        return rows.groupBy("group_key").agg(F.lit(stage).alias("stage"), F.countDistinct("way_id").alias("n_ways"), F.sum(n).alias("n_segments"), F.countDistinct(*parts).alias("n_parts"), F.sum(s).alias("score"), F.sum(l).alias("length"))

    def by_road(stage: str, rows: DataFrame) -> DataFrame:
        ways_of = F.size(F.array_distinct(F.flatten(F.collect_list("way_ids")))).cast("long")
        return rows.groupBy("group_key").agg(F.lit(stage).alias("stage"), ways_of.alias("n_ways"), F.sum("n_segments").alias("n_segments"), F.count("*").alias("n_parts"), F.sum("penalized_score").alias("score"), F.sum("total_length").alias("length"))

    stages = [
        by_way("tile_cache", raw, score=zero), by_way("hard_filter", kept, score=zero), by_way("scoring", kept), by_way("grouping", kept),
        by_way("connected_components", placed, F.countDistinct("component")), by_way("ordering", placed, F.countDistinct("component", "chunk")),
        by_part("deflection_filter", left, "component", "chunk", n="n", s="s", l="l"), by_part("straight_gap_split", rest, "component", "chunk", "piece", n="_n", s="_s", l="_l"),
        by_road("penalties", table), by_road("output_filter", roads.published(table, min_score, min_mph=min_mph)),
    ]
    out = stages[0]
    for s in stages[1:]:
        out = out.unionByName(s)
    return out


def group_detail(ways: DataFrame) -> DataFrame:
    """(group_key, component, n_ways, n_chunks, n_pieces, score_before, score_after, zeroed): each component before and after the wobble
    filter; zeroed counts the segments that had a score."""
    kept, distinct = roads.kept_ways(ways)
    quiet = store(assemble.without_wobbles(roads.flat_segments(kept, distinct)))
    pieces = assemble.split_straights(quiet).groupBy("group_key", "component").agg(F.countDistinct("chunk", "piece").alias("n_pieces"))
    before = quiet.groupBy("group_key", "component").agg(
        F.countDistinct("way_id").alias("n_ways"), F.countDistinct("chunk").alias("n_chunks"), F.sum("was_score").alias("score_before"), F.sum("score").alias("score_after"),
        F.count_if((F.col("was_score") != 0) & (F.col("score") == 0)).alias("zeroed"),
    )
    return before.join(pieces, ["group_key", "component"])


def continuity(ways: DataFrame) -> DataFrame:
    """Per group: ways, nodes, length, components and the ways of the largest, whether there is one only, and its box."""
    ways = store(ways)
    ends = cut(roads.group_ends(ways))
    found = assemble.near_components(ends).select("group_key", *copy_keys(ways), "component")
    g = F.col("geometry")
    bound = lambda f, c: f(F.transform(g, lambda p: p[c]))
    own = segments.score_ways(hard_filter(ways).dropDuplicates(copy_keys(ways)))
    own = own.select(
        *copy_keys(ways), F.size(g).alias("nodes"), F.aggregate("segments", F.lit(0.0), lambda s, x: s + x.length).alias("l"),
        bound(F.array_min, "lat").alias("south"), bound(F.array_min, "lon").alias("west"), bound(F.array_max, "lat").alias("north"), bound(F.array_max, "lon").alias("east"),
    )
    sums = [F.sum("nodes").alias("nodes"), F.sum("l").alias("l"), F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east")]
    by = found.join(own, copy_keys(ways)).groupBy("group_key", "component").agg(F.count("*").alias("n"), *sums)
    return by.groupBy("group_key").agg(
        F.sum("n").alias("n_ways"), F.sum("nodes").alias("n_nodes"), F.sum("l").alias("length"), F.count("*").alias("n_components"), F.max("n").alias("largest"), (F.count("*") == 1).alias("contiguous"),
        F.min("south").alias("south"), F.min("west").alias("west"), F.max("north").alias("north"), F.max("east").alias("east"),
    )
