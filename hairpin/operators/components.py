"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.plans.lineage import cut, in_tasks

#: Links that a task of a round takes. A round has many steps, and contracted graphs are small.
LINKS_OF_TASK = 200_000


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every id that occurs in ``links``; component is the smallest id of the component.

    Each round points every vertex at the smallest of itself and its neighbours, follows the pointers to their end by
    doubling and contracts the graph to what they point at, so a round at least halves the vertices that still have links.
    Hubs are pre-aggregated by the partial minimum; nothing is collected. Links with a null end don't count. Tasks are as many as the links need,
    not as the session has shuffle partitions.
    """
    # both ways from one reading: what makes the links is worked out once
    both = F.array(F.struct(F.col(src).alias("a"), F.col(dst).alias("b")), F.struct(F.col(dst).alias("a"), F.col(src).alias("b")))
    edges = cut(links.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.inline(both)).distinct())
    rows = edges.count()
    few = lambda df: cut(in_tasks(df, rows, LINKS_OF_TASK))
    edges = in_tasks(edges, rows, LINKS_OF_TASK)
    found = edges.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct()
    edges = edges.where("a <> b")
    for _ in range(max_rounds):
        if edges.isEmpty():
            return found
        point = few(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("to")))
        while True:
            jump = point.alias("p").join(point.alias("q"), F.col("p.to") == F.col("q.a")).select(F.col("p.a").alias("a"), F.col("q.to").alias("to"), (F.col("p.to") != F.col("q.to")).alias("moved"))
            jump = few(jump)
            moved = not jump.where("moved").isEmpty()
            point = jump.select("a", "to")
            if not moved:
                break
        found = few(found.join(point, F.col("component") == F.col("a"), "left").select("id", F.coalesce("to", "component").alias("component")))
        side = edges.join(point, "a").select(F.col("to").alias("x"), "b")
        edges = few(side.join(point.select(F.col("a").alias("b"), F.col("to").alias("y")), "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
