"""Near-duplicate vectors by a forest of random-projection trees.

Equal vectors are one class. Each tree splits the classes at the median of a random projection, again and again, until
a node is a leaf; classes near a split go to both sides (spill), as their partners may stand beyond it. Leaves of many trees are
compared, and pairs of enough cosine, in double precision, are links.

The upper levels of a tree are learned from a bounded sample of SAMPLE vectors, so executors are sent TREES small tables; every vector is
routed through every tree. Where the table asks for more levels than the sample can tell, nodes are split further in the table itself:
a node's direction follows from its number, its median and spread from all its vectors. So a leaf stays of one size as the table
grows. A leaf that holds more than LEAF_LIMIT classes (vectors close together, which no split parts) is compared in blocks: each block
against each other in a task of its own.

No pairs are stored. A pair counts in the first of the places (tree, leaf) that its two vectors share; a task hands on how many
links each vector has there, and links enough to join what its links join.

Defined results: a null vector, one with a null, nan or infinite component, and a zero vector link with nothing and have
component vec_id; equal vectors link, as do repeated rows; a vector of another length than most links with those of its own length; a
null vec_id has null component; an empty table gives an empty table; other columns don't take part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hairpin.llm.batches import arrow_rows
from hairpin.operators.components import connected_components
from hairpin.plans.lineage import discard, store

COSINE = 0.9
TREES = 12
#: Classes of a leaf, expected, before spill; vectors within SPILL of the spread around a split go both ways.
LEAF = 250
SPILL = 0.15
#: Levels at which a vector may go both ways, which bounds its copies in a tree to 2^SPILLS.
SPILLS = 3
SAMPLE = 20_000
LEAF_LIMIT = 2_000
#: Vectors of the sample for each of its leaves, at least.
SAMPLE_LEAF = 8
#: Bits of a leaf's number within a place, the tree in the bits above.
LEAF_BITS = 48
SEED = 20240131


def _good():
    """True where the column v is a vector that may link."""
    v = F.col("v")
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, v, key) of the rows that may link; key tells different directions and lengths apart."""
    # -0.0 and 0.0 are one number
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(_good())
    return rows.withColumn("key", F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)), F.size("v")))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length, of vectors of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    big = np.abs(flat).max(1, keepdims=True)
    flat = flat / big  # no overflow in squares
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def _grow(sample: np.ndarray, depth: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A tree's levels: (directions, medians, spill widths) of the nodes of each level."""
    rng = np.random.default_rng(seed)
    node = np.zeros(len(sample), np.int64)
    levels = []
    for level in range(depth):
        n = 1 << level
        # the difference of two vectors of a node parts its sample better than any direction does
        direction = rng.standard_normal((n, sample.shape[1]))
        order = np.argsort(node, kind="stable")
        first = np.searchsorted(node[order], np.arange(n + 1))
        for k in range(n):
            own = order[first[k] : first[k + 1]]
            if len(own) >= 2:
                a, b = rng.choice(own, 2, replace=False)
                if np.abs(sample[a] - sample[b]).max() > 1e-9:
                    direction[k] = sample[a] - sample[b]
        direction /= np.sqrt((direction * direction).sum(1, keepdims=True))
        at = np.einsum("ij,ij->i", sample, direction[node])
        median, width = np.zeros(n), np.zeros(n)
        for k in range(n):
            own = at[order[first[k] : first[k + 1]]]
            if len(own):
                median[k], width[k] = np.median(own), SPILL * own.std()
        levels.append((direction.astype(np.float32), median, width))
        node = 2 * node + (at > median[node])
    return levels


def _leaves(units: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of each vector in a tree, several where it spills."""
    row, node, spilt = np.arange(len(units)), np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
    for direction, median, width in levels:
        at = np.einsum("ij,ij->i", units[row], direction[node]) - median[node]
        right = at > 0
        both = (np.abs(at) < width[node]) & (spilt < SPILLS)
        row, node, spilt = np.concatenate([row, row[both]]), np.concatenate([2 * node + right, 2 * node[both] + ~right[both]]), np.concatenate([spilt + both, spilt[both] + 1])
    return row, node


def _labels(close: np.ndarray) -> np.ndarray:
    """For a symmetric matrix, the lowest row that each row is joined with."""
    label, step = np.arange(len(close), dtype=np.int32), max(1, (1 << 22) // max(1, len(close)))
    while True:
        least = np.concatenate([np.where(close[i : i + step], label, len(close)).min(1, initial=len(close)) for i in range(0, len(close), step)] or [label])
        new = np.minimum(label, least).astype(np.int32)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _earlier(places: pa.Array, rows: np.ndarray, others: np.ndarray, place: int) -> np.ndarray:
    """Which of ``rows`` and ``others`` share a place before ``place``."""
    first, flat = places.offsets.to_numpy(), places.values.to_numpy()
    found = []
    for of in (rows, others):
        size = first[of + 1] - first[of]
        at = np.repeat(first[of] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        owner = np.repeat(np.arange(len(of)), size)
        keep = flat[at] < place
        found.append((flat[at][keep], owner[keep]))
    both = np.intersect1d(found[0][0], found[1][0])
    out = np.zeros((len(rows), len(others)), bool)
    for a in range(0, len(both), 512):
        sides = []
        for (code, owner), n in zip(found, (len(rows), len(others)), strict=True):
            at = np.searchsorted(both[a : a + 512], code)
            good = (at < len(both[a : a + 512])) & (both[a : a + 512][np.minimum(at, len(both[a : a + 512]) - 1)] == code)
            one = np.zeros((n, 512), np.float32)
            one[owner[good], at[good]] = 1
            sides.append(one)
        out |= sides[0] @ sides[1].T > 0
    return out


def compare_blocks(units: np.ndarray, key: np.ndarray, size: np.ndarray, places: pa.Array, x: np.ndarray, y: np.ndarray, place: int, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, of, n): links (a, b) that join what the close pairs of rows x and y join, and how many vectors each of ``of`` is linked with
    by pairs that count here. x and y are the same rows or have none in common."""
    same = len(x) == len(y) and (x == y).all()
    close = np.concatenate([units[x[i : i + 1024]] @ units[y].T >= cosine for i in range(0, len(x), 1024)] or [np.zeros((0, len(y)), bool)])
    if same:
        np.fill_diagonal(close, False)
    p, q = np.flatnonzero(close.any(1)), np.flatnonzero(close.any(0))
    x, y, close = x[p], y[q], close[np.ix_(p, q)]
    counts = close & ~_earlier(places, x, y, place)
    if same:
        of, n = x, counts @ size[y]
        whole, rows = close, x
    else:
        of, n = np.concatenate([x, y]), np.concatenate([counts @ size[y], counts.T @ size[x]])
        rows = of
        whole = np.zeros((len(rows), len(rows)), bool)
        whole[: len(x), len(x) :], whole[len(x) :, : len(x)] = close, close.T
    label = _labels(whole)
    at = np.flatnonzero(label != np.arange(len(label)))
    return key[rows[at]], key[rows[label[at]]], key[of], n


def _split_further(placed: DataFrame, classes: DataFrame, rounds: int) -> DataFrame:
    """``placed`` (d, t, leaf, key) with each node split in two ``rounds`` more times, at the median of all its vectors along a
    direction that follows from its number."""
    for _ in range(rounds):
        held = placed.join(classes.select("key", "v"), "key")

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                d, t, leaf = (batch.column(c).to_numpy() for c in ("d", "t", "leaf"))
                at = np.zeros(batch.num_rows)
                for size in np.unique(d).tolist():
                    own = np.flatnonzero(d == size)
                    units = _units(batch.column("v").take(pa.array(own)))
                    nodes, of = np.unique(t[own].astype(np.int64) << LEAF_BITS | leaf[own], return_inverse=True)
                    ways = np.stack([np.random.default_rng([SEED, node]).standard_normal(size) for node in nodes.tolist()])
                    ways /= np.sqrt((ways * ways).sum(1, keepdims=True))
                    at[own] = np.einsum("ij,ij->i", units, ways[of])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("d", "t", "leaf", "key")), pa.array(at)], names=["d", "t", "leaf", "key", "at"])

        at = store(held.select("d", "t", "leaf", "key", "v").mapInArrow(project, "d int, t int, leaf long, key long, at double"))
        middle = at.groupBy("d", "t", "leaf").agg(F.percentile_approx("at", 0.5, 1000).alias("m"), (F.coalesce(F.stddev_pop("at"), F.lit(0.0)) * SPILL).alias("w"))
        right = (F.col("at") > F.col("m")).cast("long")
        both = F.abs(F.col("at") - F.col("m")) < F.col("w")
        sides = F.when(both, F.array(right, 1 - right)).otherwise(F.array(right))
        after = store(at.join(middle, ["d", "t", "leaf"]).select("d", "t", "key", "leaf", F.explode(sides).alias("side")).select("d", "t", (2 * F.col("leaf") + F.col("side")).alias("leaf"), "key"))
        discard(at, placed)
        placed = after
    return placed


def links(classes: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf_limit: int = LEAF_LIMIT) -> DataFrame:
    """Of classes (key, v, size): rows (a, b) of links that join what the links of at least this cosine join, and rows (a, n) of vectors that a class is
    linked with, to be summed."""
    spark = classes.sparkSession
    sizes = {r["d"]: r["n"] for r in classes.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    forest: dict[tuple[int, int], list] = {}
    more: dict[int, int] = {}
    for d, n in sizes.items():
        share = min(1.0, SAMPLE / n)
        rows = classes.where((F.size("v") == d) & (F.pmod("key", F.lit(1 << 30)) <= int(share * (1 << 30)))).select("v").toArrow()
        sample = _units(rows.column("v").combine_chunks()) if rows.num_rows else np.zeros((0, d))
        wanted = max(0, math.ceil(math.log2(n / LEAF)))
        depth = min(wanted, max(0, int(math.log2(max(1, len(sample) / SAMPLE_LEAF)))))
        more[d] = wanted - depth
        for t in range(trees):
            forest[d, t] = _grow(sample, depth, SEED + t) if len(sample) else []
    shared = spark.sparkContext.broadcast(forest)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("v").value_lengths().to_numpy()
            for d in np.unique(size).tolist():
                part = batch.filter(pa.array(size == d))
                units = _units(part.column("v"))
                for (dim, t), levels in shared.value.items():
                    if dim != d:
                        continue
                    row, leaf = _leaves(units, levels)
                    order = np.argsort(leaf, kind="stable")
                    row, leaf = row[order], leaf[order]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), d, np.int32)), pa.array(np.full(len(row), t, np.int32)), pa.array(leaf), part.column("key").take(pa.array(row))], names=["d", "t", "leaf", "key"])

    placed = store(classes.select("key", "v").mapInArrow(route, "d int, t int, leaf long, key long"))
    rounds = max(more.values(), default=0)
    if rounds:
        # vectors of a rarer length that need fewer levels stay as they are
        small = [d for d, k in more.items() if not k]
        kept = placed.where(F.col("d").isin(small)) if small else None
        split = _split_further(store(placed.where(~F.col("d").isin(small)) if small else placed), classes, rounds)
        placed = split if kept is None else store(split.unionByName(kept))
    place = placed.select("d", "key", (F.shiftleft(F.col("t").cast("long"), LEAF_BITS) + F.col("leaf")).alias("place"))
    # a leaf is cut into blocks of leaf_limit; each pair of blocks is a task's group
    blocks = place.groupBy("d", "place").count().select("d", "place", F.ceil(F.col("count") / leaf_limit).cast("int").alias("blocks"))
    cut = place.join(blocks, ["d", "place"]).withColumn("block", F.pmod(F.xxhash64("key", "place"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = cut.select("d", "place", "key", "block", other).select("d", "place", "key", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block")
    known = classes.select("key", "v", "size").join(place.groupBy("key").agg(F.collect_list("place").alias("places")), "key")
    held = cut.join(known, "key")

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        units, key, size = _units(table.column("v").chunk(0)), table.column("key").to_numpy(), table.column("size").to_numpy()
        block, p, q, own = table.column("block").to_numpy(), table.column("p")[0].as_py(), table.column("q")[0].as_py(), table.column("place")[0].as_py()
        a, b, of, n = compare_blocks(units, key, size, table.column("places").chunk(0), np.flatnonzero(block == p), np.flatnonzero(block == q), own, cosine)
        some = n > 0
        of, n = of[some], n[some]
        return pa.table({"a": np.concatenate([a, of]), "b": pa.array(np.concatenate([b, of]), mask=np.arange(len(a) + len(of)) >= len(a)), "n": pa.array(np.concatenate([np.zeros(len(a), np.int64), n]))})

    return held.groupBy("d", "place", "p", "q").applyInArrow(compare, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, trees: int = TREES, leaf_limit: int = LEAF_LIMIT) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    arrow_rows(spark, 4096)
    rows = _usable(vectors, vec_id, embedding)
    classes = store(rows.groupBy("key").agg(F.first("v").alias("v"), F.min("id").alias("least"), F.count("*").alias("size")))
    found = store(links(classes.select("key", "v", "size"), cosine, trees, leaf_limit))
    joined = connected_components(found.where("b IS NOT NULL").select("a", "b").distinct(), "a", "b")
    degree = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("others"))
    named = classes.join(joined, F.col("key") == F.col("id"), "left").join(degree, F.col("key") == F.col("a"), "left").select("key", "least", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("component", "key").alias("c"))
    named = named.join(named.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("key", "n", "component_id")
    keyed = rows.select("id", "key").join(named, "key").select("id", "n", "component_id")
    rest = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(~F.coalesce(_good(), F.lit(False))).select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("component_id"))
    out = keyed.unionByName(rest)
    return out.select(F.col("id").alias(vec_id), F.col("n").cast("long").alias("n_links"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
