"""Points near other points or in regions (problem 2).

Radius join: a bounded sample of the locations gives pivots; each location belongs to the Voronoi cell of its nearest
pivot and is copied to every other cell whose pivot is at most 2 r farther away than its own, which by the triangle
inequality covers all partners within r. A cell that holds too many locations is parted again, by pivots of its own, in
the same way, so that cells stay small however large the table. In a cell a vantage-point tree with the great-circle
metric answers the queries of the cell's own locations. What is too crowded even then is worked off as pairs of blocks.

Containment: zones are cut into bands of latitude and longitude, each with the edges that a ray in the band can
cross; points meet them by an equi-join, and a crossing count decides, all in column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.session import cut, ship

EARTH_M = 6_371_008.8


def usable(lat: Column, lon: Column) -> Column:
    """Neither null nor NaN, in range, not both zero; false where unknown."""
    ok = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(ok, F.lit(False))


def unit(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], axis=1)


def arc(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distances in metres between rows of a and of b (broadcast), exact for short and long arcs."""
    chord = np.sqrt(((a - b) ** 2).sum(axis=-1))
    return 2 * EARTH_M * np.arcsin(np.minimum(chord / 2, 1.0))


class VantageTree:
    """A vantage-point tree over unit vectors; `within` answers a block of queries in one walk."""

    LEAF = 48

    def __init__(self, points: np.ndarray):
        self.points = points
        self.root = self._build(np.arange(len(points)))

    def _build(self, index: np.ndarray):
        stack_root: list = [None]
        todo = [(index, stack_root, 0)]
        while todo:
            idx, parent, at = todo.pop()
            if len(idx) <= self.LEAF:
                parent[at] = idx
                continue
            far = idx[np.argmax(arc(self.points[idx], self.points[idx[0]]))]  # a point at the rim parts best
            d = arc(self.points[idx], self.points[far])
            mid = np.median(d)
            near = d <= mid
            if near.all():  # so many at one distance that the median parts nothing
                near = d < mid
                if not near.any():
                    parent[at] = idx
                    continue
                mid = d[near].max()
            node = [far, mid, None, None]
            parent[at] = node
            todo += [(idx[near], node, 2), (idx[~near], node, 3)]
        return stack_root[0]

    def within(self, queries: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
        """Positions (query, point) of all pairs at most r metres apart."""
        slack, out_q, out_p = 1e-3, [], []
        todo = [(self.root, np.arange(len(queries)))]
        while todo:
            node, q = todo.pop()
            if not len(q):
                continue
            if isinstance(node, np.ndarray):
                step = max(1, 2_000_000 // max(1, len(node)))
                for s in range(0, len(q), step):
                    part = q[s : s + step]
                    d = arc(queries[part][:, None, :], self.points[node][None, :, :])
                    a, b = np.nonzero(d <= r)
                    out_q.append(part[a])
                    out_p.append(node[b])
                continue
            centre, mid, near, far = node
            d = arc(queries[q], self.points[centre])
            todo += [(near, q[d - r <= mid + slack]), (far, q[d + r >= mid - slack])]
        if not out_q:
            return np.empty(0, int), np.empty(0, int)
        return np.concatenate(out_q), np.concatenate(out_p)


def pick_pivots(locs: DataFrame, n: int, r: float) -> np.ndarray:
    """At most n pivots as unit vectors, from a hashed sample of 4 n locations; those within 8 r of an earlier one are left
    out, so that a crowd narrower than the radius isn't copied into many cells."""
    rows = locs.select("lat", "lon").orderBy(F.xxhash64("lat", "lon"), "lat", "lon").limit(4 * n).toPandas()
    return spread_out(unit(rows["lat"].to_numpy(), rows["lon"].to_numpy()), n, r)


def spread_out(vectors: np.ndarray, n: int, r: float) -> np.ndarray:
    """At most n of the vectors, in their order, without those within 8 r of an earlier one."""
    picked = np.empty((0, 3))
    for v in vectors:
        if len(picked) < n and (not len(picked) or arc(picked, v).min() > 8 * r):
            picked = np.vstack([picked, v])
    return picked


def nearest_cells(v: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, cell, home): of each point its nearest centre, and the others at most reach metres farther away.

    Many centres are parted by leaders, a square root of them, each with the centres nearest to it; a leader is passed over
    for the points that can have no such centre with it, by the triangle inequality.
    """
    n, m = len(v), len(centres)
    apart = lambda a, b: EARTH_M * np.arccos(np.clip(a @ b.T, -1, 1))
    if m <= 64:
        d = apart(v, centres)
        home = d.argmin(axis=1)
        best = d[np.arange(n), home]
        # Distances by dot product are coarse for short arcs; one metre of slack makes up for it.
        i, j = np.nonzero(d <= (best + reach + 1.0 + best * 1e-7)[:, None])
        return i, j, home[i] == j
    lead = centres[:: max(1, math.isqrt(m))]
    to = apart(centres, lead)
    own = to.argmin(axis=1)
    radius = np.array([to[own == g, g].max(initial=0.0) for g in range(len(lead))])
    far = apart(v, lead)
    limit = far.min(axis=1) + reach + 3.0  # a leader is itself a centre, so none farther than this counts
    near = [], [], []
    for g in range(len(lead)):
        rows = np.nonzero(far[:, g] - radius[g] <= limit * (1 + 1e-7))[0]
        cols = np.nonzero(own == g)[0]
        if len(rows) and len(cols):
            d = apart(v[rows], centres[cols])
            a, b = np.nonzero(d <= (limit[rows] * (1 + 1e-7))[:, None])
            for out, x in zip(near, (rows[a], cols[b], d[a, b]), strict=True):
                out.append(x)
    i, j, d = (np.concatenate(x) for x in near)
    order = np.lexsort((j, d, i))
    i, j, d = i[order], j[order], d[order]
    first = np.r_[True, i[1:] != i[:-1]]
    best = d[first][np.cumsum(first) - 1]
    keep = d <= best + reach + 1.0 + best * 1e-7
    return i[keep], j[keep], first[keep]


def radius_pairs(
    points: DataFrame,
    key: str,
    lat: str,
    lon: str,
    metres: float,
    cell_size: int = 2_000,
    max_pivots: int = 2_048,
    block: int = 6_000,
    max_inner: int = 1_000_000,
) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of usable points at most metres apart on the sphere, each once.

    Points without usable coordinates take part in no pair; repeated ids on one row set are kept as one; an empty
    table gives no rows. Points at exactly one place are worked off as one location and expanded at the end. Other
    columns are ignored. max_pivots bounds the pivots of the first level, max_inner those of all cells of the second,
    about one for cell_size locations; together they bound what is sent along, at 24 bytes each. What is still beyond block
    locations is split into blocks, so no task holds an unbounded cell.
    """
    pts = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    # -0.0 and 0.0, and the two names of the date line, are one place.
    pts = pts.filter(usable(F.col("lat"), F.col("lon"))).withColumns({"lat": F.col("lat") + 0.0, "lon": F.when(F.col("lon") == -180, 180.0).otherwise(F.col("lon") + 0.0)}).dropDuplicates(["id"])
    ship(points.sparkSession)
    locs = pts.groupBy("lat", "lon").agg(F.min("id").alias("loc"))
    n = locs.count()
    centres = pick_pivots(locs, max(1, min(max_pivots, math.ceil(n / cell_size))), metres)
    reach = 2 * metres + 1e-3

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for s in range(0, len(whole), 2_000):
                b = whole.iloc[s : s + 2_000]
                v = unit(b["lat"].to_numpy(), b["lon"].to_numpy())
                i, j, home = nearest_cells(v, centres, reach)
                yield pd.DataFrame({"cell": j.astype("int64"), "home": home, "loc": b["loc"].to_numpy()[i], "lat": b["lat"].to_numpy()[i], "lon": b["lon"].to_numpy()[i]})

    kind = dict(pts.dtypes)["id"]
    shape = f"cell long, home boolean, loc {kind}, lat double, lon double"
    cells = cut(locs.mapInPandas(assign, shape))
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    asked_for = {r["cell"]: r["n"] for r in crowded.collect()} if n > block else {}
    if asked_for:
        rate = min(1.0, 4 / cell_size, 4 * max_inner / n)
        drawn = cells.join(crowded.select("cell"), "cell").filter(F.col("home") & (F.pmod(F.xxhash64("lat", "lon", F.lit(5)), F.lit(1 << 20)) < rate * (1 << 20)))
        inner: dict[int, np.ndarray] = {}
        for c, part in drawn.select("cell", "lat", "lon").toPandas().groupby("cell"):
            inner[int(c)] = spread_out(unit(part["lat"].to_numpy(), part["lon"].to_numpy()), max(1, len(part) // 4), metres)

        def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for c, b in whole.groupby("cell", sort=False):
                    own = inner.get(int(c))
                    if own is None or len(own) < 2:
                        yield b
                        continue
                    for s in range(0, len(b), 2_000):
                        p = b.iloc[s : s + 2_000]
                        i, j, home = nearest_cells(unit(p["lat"].to_numpy(), p["lon"].to_numpy()), own, reach)
                        q = p.iloc[i]
                        # A location asks where it is at home on both levels.
                        yield q.assign(cell=max_pivots + int(c) * (1 << 24) + j, home=q["home"].to_numpy() & home)

        cells = cut(cells.mapInPandas(again, shape))
    sizes = cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells = cells.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("loc"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asked = cells.filter("home").select("cell", F.col("own").alias("qb"), F.explode(every).alias("pb"), F.lit(True).alias("ask"), "loc", "lat", "lon")
    found = cells.select("cell", F.explode(every).alias("qb"), F.col("own").alias("pb"), F.lit(False).alias("ask"), "loc", "lat", "lon")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        q, p = pdf[pdf["ask"]], pdf[~pdf["ask"]]
        if not len(q) or not len(p):
            return pd.DataFrame({"loc_a": q["loc"][:0], "loc_b": p["loc"][:0]})
        tree = VantageTree(unit(p["lat"].to_numpy(), p["lon"].to_numpy()))
        a, b = tree.within(unit(q["lat"].to_numpy(), q["lon"].to_numpy()), metres)
        la, lb = q["loc"].to_numpy()[a], p["loc"].to_numpy()[b]
        keep = la < lb  # the pair is also found from its other end
        return pd.DataFrame({"loc_a": la[keep], "loc_b": lb[keep]})

    near = asked.unionByName(found).groupBy("cell", "qb", "pb").applyInPandas(search, f"loc_a {kind}, loc_b {kind}")
    members = pts.join(locs, ["lat", "lon"]).select("id", "loc")
    a, b = members.select(F.col("id").alias("a"), F.col("loc").alias("loc_a")), members.select(F.col("id").alias("b"), F.col("loc").alias("loc_b"))
    apart = near.join(a, "loc_a").join(b, "loc_b").select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b"))
    shared = members.groupBy("loc").agg(F.count("*").alias("n")).filter("n > 1").select("loc")
    same = members.join(shared, "loc")
    same = same.select(F.col("id").alias("id_a"), "loc").join(same.select(F.col("id").alias("id_b"), "loc"), "loc").filter("id_a < id_b").select("id_a", "id_b")
    return apart.unionByName(same)


def zone_edges(zones: DataFrame, key: str, wkt: str) -> DataFrame:
    """(zone, edges): the edges array<struct<x1,y1,x2,y2>> of all rings of POLYGON and MULTIPOLYGON texts.

    A null, empty or malformed text gives no edges, so its zone holds no point.
    """
    number = r"[-+0-9.eE]+"
    rings = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    one = zones.select(F.col(key).alias("zone"), F.explode(rings).alias("ring"))
    xy = F.transform(F.regexp_extract_all("ring", F.lit(rf"({number}\s+{number})"), F.lit(1)), lambda p: F.struct(F.split(p, r"\s+")[0].try_cast("double").alias("x"), F.split(p, r"\s+")[1].try_cast("double").alias("y")))
    one = one.withColumn("xy", F.filter(xy, lambda p: p.x.isNotNull() & p.y.isNotNull())).filter(F.size("xy") >= 3)
    follow = F.slice("xy", 2, F.size("xy"))
    closed = F.concat(follow, F.slice("xy", 1, 1))  # closes an open ring; of a closed one the last edge has no length
    edge = F.zip_with("xy", closed, lambda p, q: F.struct(p.x.alias("x1"), p.y.alias("y1"), q.x.alias("x2"), q.y.alias("y2")))
    return one.select("zone", F.filter(edge, lambda e: e.y1 != e.y2).alias("edges"))


def points_in_zones(points: DataFrame, key: str, lat: str, lon: str, zones: DataFrame, zone_key: str, wkt: str, band: float = 1.0) -> DataFrame:
    """(id, zone): usable points inside zones, edges straight in degrees, holes outside, zones may overlap.

    band is the width in degrees of the cells by which points and zones meet.
    """
    rings = zone_edges(zones, zone_key, wkt).select("zone", F.explode("edges").alias("e"))
    edges = rings.select("zone", "e", F.greatest(F.lit(-90.0), F.least("e.y1", "e.y2")).alias("lo"), F.least(F.lit(90.0), F.greatest("e.y1", "e.y2")).alias("hi")).filter("lo <= hi")
    width = edges.groupBy("zone").agg(F.greatest(F.lit(-180.0), F.min(F.least("e.x1", "e.x2"))).alias("x_lo"), F.least(F.lit(180.0), F.max(F.greatest("e.x1", "e.x2"))).alias("x_hi")).filter("x_lo <= x_hi")
    at = lambda c: F.floor(c / band).cast("int")
    banded = edges.select("zone", "e", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi")))).alias("by")).groupBy("zone", "by").agg(F.collect_list("e").alias("edges"))
    cells = banded.join(width, "zone").select("zone", "by", "edges", "x_lo", "x_hi", F.explode(F.sequence(at(F.col("x_lo")), at(F.col("x_hi")))).alias("bx"))
    pts = points.select(F.col(key).alias("id"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    pts = pts.filter(usable(F.col("y"), F.col("x"))).withColumns({"by": at(F.col("y")), "bx": at(F.col("x"))})
    y, x = F.col("y"), F.col("x")
    crossed = lambda e: ((e.y1 > y) != (e.y2 > y)) & (x < (e.x2 - e.x1) * (y - e.y1) / (e.y2 - e.y1) + e.x1)
    met = pts.join(cells, ["by", "bx"]).filter((x >= F.col("x_lo")) & (x <= F.col("x_hi")))
    inside = F.size(F.filter("edges", crossed)) % 2 == 1
    return met.filter(inside).select("id", "zone")
