"""Chains by stretches against the sequential fold over whole components."""

import random

from pyspark.sql import functions as F

from hairpin.operators import assemble, stretches

POINT = "struct<y:long,x:long>"
SHAPE = f"group_key string, component long, way_id long, oneway boolean, a {POINT}, b {POINT}, entry double, exit double, back_entry double, back_exit double"


def graph(rng, name, component, edges, first_id):
    """Rows of ways between the given points, with made-up bearings, shuffled directions and ids."""
    ids = rng.sample(range(first_id, first_id + 10 * len(edges)), len(edges))
    rows = []
    for way_id, (p, q) in zip(ids, edges, strict=True):
        if rng.random() < 0.5:
            p, q = q, p
        # bearings repeat, so that ties are met
        rows.append((name, component, way_id, rng.random() < 0.12, p, q, *[float(rng.choice(range(0, 360, 30))) for _ in range(4)]))
    return rows


def shapes(rng):
    line = [((0, k), (0, k + 1)) for k in range(40)]
    ring = [((50, k), (50, (k + 1) % 12)) for k in range(12)]
    yield line
    yield ring
    yield line + ring  # a ring that nothing touches
    yield line + [((0, 20), (9, 0))] + [((9, k), (9, k + 1)) for k in range(10)]
    yield ring + [((50, 3), (60, 0)), ((60, 0), (61, 0))]
    yield [((0, 0), (0, 0)), ((0, 0), (0, 1)), ((0, 1), (0, 2)), ((0, 2), (0, 0))]  # a way that ends where it begins
    yield [((0, 0), (0, 0)), ((5, 5), (5, 5))]
    yield [((0, 0), (0, 1)), ((0, 0), (0, 1)), ((0, 1), (0, 0))]  # ways side by side
    for k in range(60):
        size = rng.randint(2, 14)
        yield [((rng.randrange(size), 0), (rng.randrange(size), 0)) for _ in range(rng.randint(2, 18))]
    for k in range(12):
        arms = [[((k, 0), (k, 100 * a + 1))] + [((k, 100 * a + s), (k, 100 * a + s + 1)) for s in range(1, rng.randint(2, 30))] for a in range(1, rng.randint(2, 6))]
        yield [e for arm in arms for e in arm]


def want(rows):
    out, by = {}, {}
    for r in rows:
        by.setdefault(r[:2], []).append(dict(zip(("way_id", "oneway", "a", "b", "entry", "exit", "back_entry", "back_exit"), r[2:], strict=True)))
    for (name, _), ways in by.items():
        for way_id, pos, flip in assemble.chain(sorted(ways, key=lambda w: w["way_id"])):
            out[name, way_id] = (pos, flip)
    return out


def got(spark, rows):
    return {(r.group_key, r.way_id): (r.pos, r.reversed) for r in stretches.order(spark.createDataFrame(rows, SHAPE), "group_key").collect()}


def test_stretches_equal_the_fold(spark):
    rng = random.Random(4)
    rows = [r for k, edges in enumerate(shapes(rng)) for r in graph(rng, f"g{k % 5}", k, edges, 10000 * k)]
    # every way in one group, so that components of a name are told apart
    rows += [("g0", 900 + c, *r[2:]) for c, r in enumerate(graph(rng, "g0", 0, [((1, 1), (2, 2))] * 3, 5_000_000))]
    assert got(spark, rows) == want(rows)


def test_a_long_road_of_many_ways(spark):
    rng = random.Random(8)
    edges = [((k // 1000, k % 1000), ((k + 1) // 1000, (k + 1) % 1000)) for k in range(20000)]
    rows = [(*r[:3], False, *r[4:]) for r in graph(rng, "long", 1, edges, 0)]
    found = got(spark, rows)
    assert found == want(rows) and sorted(p for p, _ in found.values()) == list(range(20000))


def test_ordered_is_the_same_by_fold_and_by_stretches(spark):
    rng = random.Random(5)
    rows = [r for k, edges in enumerate(shapes(rng)) for r in graph(rng, "all", k, edges, 10000 * k)]
    degrees = lambda c: F.struct((F.col(f"{c}.y") / 1e7).alias("lat"), (F.col(f"{c}.x") / 1e7).alias("lon"))
    ends = spark.createDataFrame(rows, SHAPE).withColumns({"first": degrees("a"), "last": degrees("b"), "oneway": F.when(F.col("oneway"), "yes")}).drop("a", "b")
    whole, parted = (sorted((r.way_id, r.pos, r.reversed) for r in assemble.ordered(ends, folded=n).collect()) for n in (10**6, 5))
    assert whole == parted and len(whole) == len(rows)
