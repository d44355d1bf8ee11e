from __future__ import annotations

import math
import random

import numpy as np

from rollcall.operators.spatial import EARTH_M, VantageTree, arc, points_in_zones, radius_pairs, unit


def metres(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


def brute(points, r):
    ok = {i: (a, b) for i, a, b in points if a is not None and b is not None and -90 <= a <= 90 and -180 <= b <= 180 and (a, b) != (0, 0)}
    ids = sorted(ok)
    return sorted(((i, j) for k, i in enumerate(ids) for j in ids[k + 1 :] if metres(ok[i], ok[j]) <= r), key=repr)


def table(spark, points):
    return spark.createDataFrame(points, "id long, lat double, lon double")


def test_tree_finds_all_in_reach():
    rng = np.random.default_rng(5)
    v = unit(rng.uniform(-90, 90, 900), rng.uniform(-180, 180, 900))
    q = v[:50]
    a, b = VantageTree(v).within(q, 400_000)
    want = {(i, j) for i in range(50) for j in np.nonzero(arc(q[i][None, :], v) <= 400_000)[0]}
    assert set(zip(a.tolist(), b.tolist(), strict=True)) == want


def test_pairs_match_brute_force_in_crowds_at_poles_and_the_date_line(spark, rows):
    rng = random.Random(3)
    pts = [(i, 50 + rng.gauss(0, 0.0006), 8 + rng.gauss(0, 0.0009)) for i in range(150)]
    pts += [(200 + i, 89.9999 + rng.random() * 1e-4, rng.uniform(-180, 180)) for i in range(12)]
    pts += [(300 + i, 10 + rng.random() * 1e-4, s * (180 - rng.random() * 2e-4)) for i, s in enumerate([1, -1] * 8)]
    pts += [(400 + i, 20.0, 20.0) for i in range(5)] + [(500, None, 3.0), (501, 91.0, 3.0), (502, 0.0, 0.0), (503, 3.0, None)]
    df = table(spark, pts)
    want = brute(pts, 75.0)
    assert rows(radius_pairs(df, "id", "lat", "lon", 75.0)) == want
    # small cells and blocks: many pivots, hot cells split
    assert rows(radius_pairs(df, "id", "lat", "lon", 75.0, cell_size=10, block=7)) == want


def test_empty_and_clashing_columns(spark, rows):
    assert rows(radius_pairs(table(spark, []), "id", "lat", "lon", 75.0)) == []
    df = spark.createDataFrame([(1, 1.0, 1.0, "x", 3), (2, 1.0, 1.0, "y", 4)], "site long, lat double, lon double, cell string, loc int")
    assert rows(radius_pairs(df, "site", "lat", "lon", 75.0)) == [(1, 2)]


def test_zones_with_holes_parts_and_overlap(spark, rows):
    zones = spark.createDataFrame(
        [
            (1, "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"),
            (2, "MULTIPOLYGON (((20 20, 21 20, 21 21, 20 21, 20 20)), ((-3 -3, -2 -3, -2 -2, -3 -2, -3 -3)))"),
            (3, "POLYGON ((5 1, 12 1, 12 3, 5 3, 5 1))"), (4, None), (5, ""), (6, "POLYGON EMPTY"),
        ],
        "zone_id long, boundary_wkt string",
    )
    pts = table(spark, [(1, 5.0, 5.0), (2, 2.0, 7.0), (3, -2.5, -2.5), (4, 20.5, 20.5), (5, 50.0, 50.0), (6, None, 1.0), (7, 1.5, 2.0)])
    assert rows(points_in_zones(pts, "id", "lat", "lon", zones, "zone_id", "boundary_wkt")) == [(2, 1), (2, 3), (3, 2), (4, 2), (7, 1)]
