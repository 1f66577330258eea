"""Which ways of a group come near each other in one square of the map: the step that a task takes for :func:`assemble.near_components`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hairpin.functions.geo import EARTH_M

#: Degrees of a square for each metre of the distance; a square has 160 cells a side.
SQUARE = 0.001
#: Cells for each degree, times the distance: points of one cell, 69.5 by 69.5 m of 100 m, are within the distance.
CELLS = 160_000.0
#: Bits of a cell's number in its group: bands of latitude and columns of longitude.
BAND, COLUMN = 10, 27
PAIRS = 1 << 21


def joined(table: pa.Table, key: str, near_m: float) -> list[pa.RecordBatch]:
    """(key, way_id, root) of the ways of the groups (key, band, col) in ``table``, whose rows are in order of these; root is the smallest
    way_id of the group that a way reaches by ends within ``near_m``. Ways that reach no other have no row."""
    lat, lon = (table[c].to_numpy() for c in ("lat", "lon"))
    names = table[key].combine_chunks().dictionary_encode().indices.to_numpy()
    new = np.ones(len(lat), bool)
    new[1:] = (names[1:] != names[:-1]) | np.any([table[c].to_numpy()[1:] != table[c].to_numpy()[:-1] for c in ("band", "col")], axis=0)
    group, way, row = np.cumsum(new) - 1, table["way_id"].to_numpy(), np.arange(len(lat))
    real = np.isfinite(lat) & np.isfinite(lon)
    if not real.all():
        lat, lon, group, way, row = (x[real] for x in (lat, lon, group, way, row))
    if not len(lat):
        return []
    # vertices: the ways of a group, numbered in order of group and way
    order = np.lexsort((way, group))
    first = np.ones(len(order), bool)
    first[1:] = (group[order][1:] != group[order][:-1]) | (way[order][1:] != way[order][:-1])
    vertex = np.empty(len(order), np.int64)
    vertex[order] = np.cumsum(first) - 1
    root = _roots(int(first.sum()), *_near(group, vertex, lat, lon, near_m))
    some = np.bincount(root, minlength=len(root))[root] > 1
    at = order[first]
    picked = pa.array(row[at[some]])
    return pa.table({key: pc.take(table[key], picked), "way_id": pa.array(way[at[some]]), "root": pa.array(way[at[root[some]]])}).combine_chunks().to_batches()


def _near(group: np.ndarray, vertex: np.ndarray, lat: np.ndarray, lon: np.ndarray, near_m: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between vertices that join those which have points within ``near_m``."""
    per_degree = CELLS / near_m
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    number = group - group[0]

    def inside(x: np.ndarray) -> np.ndarray:
        return x - np.repeat(np.minimum.reduceat(x, starts), np.diff(np.r_[starts, len(x)]))

    band, col = (inside(np.floor(x * per_degree).astype(np.int64)) for x in (lat, lon))
    code = (((number << BAND) + band) << COLUMN) + col
    order = np.lexsort((lon, lat, code))
    code, vertex, lat, lon, col = (x[order] for x in (code, vertex, lat, lon, col))
    fresh = np.r_[True, code[1:] != code[:-1]]
    # points of a cell are near each other, whatever their number
    u, v = [vertex[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]], [vertex]
    # points of other cells: each different place once
    place = fresh | np.r_[True, (lat[1:] != lat[:-1]) | (lon[1:] != lon[:-1])]
    code, vertex, lat, lon, col = (x[place] for x in (code, vertex, lat, lon, col))
    reach = near_m / 111_000.0
    wide = np.minimum(reach / np.cos(np.radians(np.minimum(np.abs(lat) + 2 * reach, 89.9999))), 360.0)
    cells = np.ceil(wide * per_degree).astype(np.int64) + 1
    low, high = np.maximum(col - cells, 0), np.minimum(col + cells, (1 << COLUMN) - 1)
    for up in range(3):
        base = ((code >> COLUMN) + up) << COLUMN
        begin = np.searchsorted(code, code + 1 if up == 0 else base + low, "left")
        count = np.maximum(np.searchsorted(code, base + high, "right") - begin, 0)
        done = 0
        total = np.cumsum(count)
        while done < len(count):
            upto = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")), done + 1)
            n = count[done:upto]
            a = np.repeat(np.arange(done, upto), n)
            b = np.repeat(begin[done:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            la, lb = np.radians(lat[a]), np.radians(lat[b])
            h = np.sin(np.radians(lat[b] - lat[a]) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin(np.radians(lon[b] - lon[a]) / 2) ** 2
            met = 2 * EARTH_M * np.arcsin(np.minimum(np.sqrt(h), 1.0)) <= near_m
            pairs = np.unique(np.stack([vertex[a[met]], vertex[b[met]]]), axis=1) if met.any() else np.empty((2, 0), np.int64)
            u.append(pairs[0])
            v.append(pairs[1])
            done = upto
    return np.concatenate(u), np.concatenate(v)


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Of each of n vertices the smallest that links (u, v) lead to."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return root
        u, v, a, b = (x[apart] for x in (u, v, a, b))
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
