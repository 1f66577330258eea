"""Nearest roads against all pairs."""

import math
import random

from hairpin.operators import rank


def hav(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h)))


def test_neighbours_at_any_distance(spark):
    rng = random.Random(6)
    spread = [0.001, 0.01, 0.1, 1.0, 20.0]
    ends = lambda s: (60 + rng.uniform(-s, s), 10 + rng.uniform(-s, s))
    rows = [(f"{'AB'[k % 2]}{k}", ends(spread[k % 5]), ends(spread[k % 5]) if k % 7 else None) for k in range(60)]
    rows += [("B far", (-85.0, 150.0), (-80.0, 150.0)), ("A far", (-60.0, -120.0), None), ("C alone", (0.0, 0.0), None), ("A gone", None, None)]
    table = spark.createDataFrame(rows, "id string, first struct<lat:double,lon:double>, last struct<lat:double,lon:double>")
    for prefix in (None, "A", "C"):
        own = [r for r in rows if r[0].startswith(prefix or "")]
        want = {}
        for a, *p in own:
            met = [(round(hav(x, y), 3), b) for b, *q in own if b != a for x in p for y in q if x and y]
            if met:
                want[a] = min(met)
        got = {r.id: (round(r.away_m, 3), r.other) for r in rank.neighbours(table, prefix=prefix).collect()}
        assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 0.01 for k in want)
    assert rank.neighbours(table.where("false")).count() == 0
