"""The whole road table: from ways to ranked roads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hairpin.functions import tags
from hairpin.operators import assemble, segments
from hairpin.operators.ways import copy_keys, group_keys, grouped, hard_filter
from hairpin.plans.lineage import cut, discard, scratch, store


def group_ends(ways: DataFrame, with_refs: bool = True, distinct: bool = False) -> DataFrame:
    """Kept ways, once for each of their groups, with their ends and the number of their segments: small rows, without geometry and
    segments. ``distinct``: no way has several rows."""
    n = F.greatest(F.size("geometry") - 1, F.lit(0)).alias("n_segments")
    small = ["oneway", "first", "last", "entry", "exit", "back_entry", "back_exit"]
    # ends first: geometry isn't moved
    ends = segments.way_ends(hard_filter(ways)).select(*copy_keys(ways), "name", "ref", *small, n)
    rows = ends.withColumn("group_key", F.explode(group_keys(with_refs))) if distinct else grouped(ends, with_refs)
    return rows.select("group_key", *copy_keys(ways), *small, "n_segments")


def chunks(ways: DataFrame, with_refs: bool = True, distinct: bool = False) -> DataFrame:
    """Each way of each group with component, pos, reversed, chunk and offset: the segments before it in its chunk."""
    ends = store(group_ends(ways, with_refs, distinct))
    return assemble.with_gaps(assemble.ordered(store(assemble.near_components(ends))))


def kept_ways(ways: DataFrame) -> tuple[DataFrame, bool]:
    """The kept ways as a stored table with one row for each copy of a way, and whether a way has one copy only. Rows are moved for it only
    if a copy stands in several."""
    keys, kept = copy_keys(ways), store(hard_filter(ways))
    if not cut(kept.groupBy(*keys).count().where("count > 1").limit(1)).isEmpty():
        several, kept = kept, store(kept.dropDuplicates(keys))
        discard(several)
    return kept, keys == ["way_id"]


def with_segments(rows: DataFrame, ways: DataFrame, distinct: bool = False) -> DataFrame:
    """``rows`` with the segments, class and speed of their ways, of the copy that their ends came from: the one join that moves segments.
    ``distinct``: no copy of a way has several rows."""
    keys = copy_keys(ways)
    own = hard_filter(ways) if distinct else hard_filter(ways).dropDuplicates(keys)
    return rows.join(segments.score_ways(own).select(*keys, "highway", "maxspeed", "segments"), keys)


def flat_segments(kept: DataFrame, distinct: bool, with_refs: bool = True, unread: tuple[str, ...] = ()) -> DataFrame:
    """The segments of all chunks of the ways of :func:`kept_ways`, stored, without the fields ``unread``."""
    with scratch(kept.sparkSession) as keep:
        placed = chunks(kept, with_refs, distinct).select("group_key", "component", "chunk", "pos", "reversed", "offset", *copy_keys(kept))
        return keep(assemble.flattened(with_segments(placed, kept, distinct=True)).drop(*unread))


def pieces(ways: DataFrame, with_refs: bool = True, unread: tuple[str, ...] = ()) -> DataFrame:
    """The segments of all roads with piece, without the fields ``unread``."""
    return assemble.split_straights(assemble.without_wobbles(_flat(ways, with_refs, unread)))


def numbered_segments(ways: DataFrame, with_refs: bool = True, unread: tuple[str, ...] = ()) -> DataFrame:
    """The segments of all roads with the sub_index of their road, without the fields ``unread``: no road is put together."""
    return assemble.numbered_pieces(_flat(ways, with_refs, unread)).where("way_id IS NOT NULL")


def _flat(ways: DataFrame, with_refs: bool, unread: tuple[str, ...]) -> DataFrame:
    # read twice, for the ends and for the segments: the ways aren't put together again
    kept, distinct = kept_ways(ways)
    flat = flat_segments(kept, distinct, with_refs, unread)
    discard(kept)
    return flat


def road_table(ways: DataFrame, with_refs: bool = True, fields: tuple[str, ...] = assemble.SEGMENT, **made: Column) -> DataFrame:
    """All roads with their segments, which have ``fields``, length and score; or with columns ``made`` of them, see :func:`assemble.build_roads`."""
    unread = ("pos", *(c for c in ("radius", "weight") if c not in fields))
    return assemble.penalised(assemble.build_roads(pieces(ways, with_refs, unread), fields=fields, **made))


def road_sums(ways: DataFrame, with_refs: bool = True, **inside: Column) -> DataFrame:
    """The rows of :func:`road_table` with what is summed over segments instead of the segments, see :func:`assemble.summed_roads`."""
    return assemble.penalised(assemble.summed_roads(pieces(ways, with_refs, ("radius", "weight", "pos")), **inside))


def published(roads: DataFrame, min_score: float = 0.0, min_length: float = tags.MIN_LENGTH_M, min_mph: float = 0.0) -> DataFrame:
    """The roads that are good and long enough, and fast enough on most of their tagged length."""
    out = roads.where((F.col("penalized_score") >= min_score) & (F.col("total_length") >= min_length))
    if min_mph > 0:
        out = out.where(tags.passing_fraction(F.col("way_speeds"), F.col("total_length"), min_mph) >= 0.5)
    return out


def ranked(roads: DataFrame) -> DataFrame:
    return roads.orderBy(F.desc("penalized_score"), "group_key", "sub_index")


def top_roads(roads: DataFrame, k: int = 5) -> DataFrame:
    """The best k of all roads; a bounded sort in each task."""
    return ranked(roads).limit(k)
