"""Geospatial queries over the domain tables, each with its SQL.

Population cells stand in for a grid: every usable site is a cell with a population made of its id.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions import geo as G
from rollcall.operators.clusters import greedy_clusters
from rollcall.operators.ranges import near_box, within_km
from rollcall.plans.registry import Registry
from rollcall.plans.relational import author_counts
from rollcall.session import table

R = Registry()
query = R.query

_USABLE = "lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)"
_CELLS_SQL = f"SELECT site_id AS id, lat, lon, cast(site_id % 100 + 1 AS BIGINT) AS pop FROM institutions_geocoded_precise WHERE {_USABLE}"
RADII = (3, 5, 10, 15, 25, 40)


def _km(a: str, b: str) -> str:
    return f"(2 * 6371.0088 * asin(least(1, sqrt(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"


def cells(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "institutions_geocoded_precise").filter(_USABLE).select(F.col("site_id").alias("id"), "lat", "lon", (F.col("site_id") % 100 + 1).alias("pop"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "city_list").filter("lat is not null and lon is not null").select("city_id", "city", "country", "lat", "lon")


def _left(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias("lid"), F.col("lat").alias("llat"), F.col("lon").alias("llon"), *more)


def _right(df: DataFrame, key: str, *more: str) -> DataFrame:
    return df.select(F.col(key).alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), *more)


@query(f"SELECT p.site_id, round({_km('p', 'i')}, 4) AS km FROM institutions_geocoded_precise p JOIN institutions_geocoded i USING (inst_id) WHERE p.lat BETWEEN -90 AND 90 AND i.lat IS NOT NULL AND p.lon IS NOT NULL")
def haversine(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "institutions_geocoded_precise").filter("lat between -90 and 90 and lon is not null").select("site_id", "inst_id", "lat", "lon")
    i = table(spark, d, "institutions_geocoded").filter("lat is not null").select("inst_id", F.col("lat").alias("ilat"), F.col("lon").alias("ilon"))
    return p.join(i, "inst_id").select("site_id", F.round(G.haversine(F.col("lat"), F.col("lon"), F.col("ilat"), F.col("ilon")), 4).alias("km"))


def _laea_sql() -> str:
    e2 = 2 * G.GRS80_F - G.GRS80_F**2
    e = math.sqrt(e2)
    q = lambda p: (1 - e2) * (math.sin(p) / (1 - e2 * math.sin(p) ** 2) - math.log((1 - e * math.sin(p)) / (1 + e * math.sin(p))) / (2 * e))
    qp = q(math.pi / 2)
    rq = G.GRS80_A * math.sqrt(qp / 2)
    b0 = math.asin(q(math.radians(52)) / qp)
    dd = G.GRS80_A * math.cos(math.radians(52)) / math.sqrt(1 - e2 * math.sin(math.radians(52)) ** 2) / (rq * math.cos(b0))
    n = lambda x: f"{x!r}::DOUBLE"
    return f"""
WITH g AS (SELECT site_id, 4321000 + cast(floor(lon * 20000) AS BIGINT) AS east, 3210000 + cast(floor((lat - 50) * 40000) AS BIGINT) AS north FROM institutions_geocoded_precise WHERE {_USABLE}),
a AS (SELECT site_id, (east - 4321000) / {n(dd)} AS x, (north - 3210000) * {n(dd)} AS y FROM g), r AS (SELECT *, sqrt(x * x + y * y) AS rho FROM a),
c AS (SELECT *, 2 * asin(least(rho / (2 * {n(rq)}), 1)) AS c FROM r),
b AS (SELECT *, asin(greatest(-1, least(1, cos(c) * {n(math.sin(b0))} + CASE WHEN rho = 0 THEN 0 ELSE y * sin(c) * {n(math.cos(b0))} / rho END))) AS beta FROM c)
SELECT site_id, round(CASE WHEN rho = 0 THEN 52 ELSE degrees(beta + {n(e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040)} * sin(2 * beta) + {n(23 * e2**2 / 360 + 251 * e2**3 / 3780)} * sin(4 * beta) + {n(761 * e2**3 / 45360)} * sin(6 * beta)) END, 6) AS lat,
 round(CASE WHEN rho = 0 THEN 10 ELSE 10 + degrees(atan2(x * sin(c), rho * {n(math.cos(b0))} * cos(c) - y * {n(math.sin(b0))} * sin(c))) END, 6) AS lon FROM b"""


@query(_laea_sql())
def laea_inverse(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "institutions_geocoded_precise").filter(_USABLE)
    lat, lon = G.laea_inverse(4321000 + F.floor(F.col("lon") * 20000), 3210000 + F.floor((F.col("lat") - 50) * 40000))
    return s.select("site_id", F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


@query(f"SELECT id, cast(trunc((90 - lat) * 120) AS BIGINT) AS px_row, cast(trunc((lon + 180) * 120) AS BIGINT) AS px_col, round(90 - (trunc((90 - lat) * 120) + 0.5) / 120, 6) AS centre_lat, round(-180 + (trunc((lon + 180) * 120) + 0.5) / 120, 6) AS centre_lon FROM ({_CELLS_SQL})")
def raster_affine(spark: SparkSession, d: str) -> DataFrame:
    """Pixel of a half-minute raster by truncation, and the pixel's centre."""
    row, col = ((90 - F.col("lat")) * 120).cast("long"), ((F.col("lon") + 180) * 120).cast("long")
    return cells(spark, d).select("id", row.alias("px_row"), col.alias("px_col"), F.round(90 - (row + 0.5) / 120, 6).alias("centre_lat"), F.round(-180 + (col + 0.5) / 120, 6).alias("centre_lon"))


@query(f"SELECT id, round((lon - 10) * {math.cos(math.radians(50))!r} * 8, 6) AS x, round((50 - lat) * 8, 6) AS y FROM ({_CELLS_SQL})")
def equirect(spark: SparkSession, d: str) -> DataFrame:
    x, y = G.equirect(F.col("lat"), F.col("lon"), 50.0, 10.0, 8.0)
    return cells(spark, d).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


_NEAR = "EXISTS (SELECT 1 FROM city_list p WHERE abs(c.lat - p.lat) < 0.6 AND abs(c.lon - p.lon) < 0.9)"


def _points(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d).select(F.col("lat").alias("plat"), F.col("lon").alias("plon"))


@query(f"SELECT id FROM ({_CELLS_SQL}) c WHERE {_NEAR}")
def join_range_semi(spark: SparkSession, d: str) -> DataFrame:
    return near_box(cells(spark, d), _points(spark, d), 0.6, 0.9).select("id")


@query(f"SELECT id FROM ({_CELLS_SQL}) c WHERE NOT {_NEAR}")
def join_range_anti(spark: SparkSession, d: str) -> DataFrame:
    return near_box(cells(spark, d), _points(spark, d), 0.6, 0.9, near=False).select("id")


@query(f"""
WITH c AS ({_CELLS_SQL}), n AS (SELECT * FROM c WHERE {_NEAR}), f AS (SELECT * FROM c WHERE NOT {_NEAR})
SELECT 'fine' AS tier, cast(round_even(lat / 0.02, 0) AS INTEGER) AS la, cast(round_even(lon / 0.02, 0) AS INTEGER) AS lo, cast(sum(pop) AS BIGINT) AS pop FROM n GROUP BY ALL HAVING sum(pop) > 20
UNION ALL SELECT 'coarse', cast(round_even(lat / 0.1, 0) AS INTEGER), cast(round_even(lon / 0.1, 0) AS INTEGER), cast(sum(pop) AS BIGINT) FROM f GROUP BY ALL HAVING sum(pop) > 50
""")
def agg_grid_having(spark: SparkSession, d: str) -> DataFrame:
    """A fine grid near the cities and a coarse one elsewhere, each above a floor; indices stay two columns."""

    def tier(name: str, step: float, floor: int, near: bool) -> DataFrame:
        c = near_box(cells(spark, d), _points(spark, d), 0.6, 0.9, near)
        g = c.groupBy(G.cell(F.col("lat"), step).alias("la"), G.cell(F.col("lon"), step).alias("lo")).agg(F.sum("pop").alias("pop"))
        return g.filter(F.col("pop") > floor).select(F.lit(name).alias("tier"), "la", "lo", "pop")

    return tier("fine", 0.02, 20, True).unionByName(tier("coarse", 0.1, 50, False))


@query(f"SELECT a.city_id, p.id, round({_km('a', 'p')}, 4) AS km FROM city_list a JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 25")
def join_distance(spark: SparkSession, d: str) -> DataFrame:
    m = within_km(_left(anchors(spark, d), "city_id"), _right(cells(spark, d), "id"), 25.0)
    return m.select(F.col("lid").alias("city_id"), F.col("rid").alias("id"), F.round("km", 4).alias("km"))


@query(f"SELECT a.city_id, coalesce(cast(sum(p.pop) AS BIGINT), 0) AS pop, count(p.id) AS cells FROM city_list a LEFT JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 25 GROUP BY a.city_id")
def pop_within(spark: SparkSession, d: str) -> DataFrame:
    """Population within 25 km of each city, 0 where there is none."""
    a = anchors(spark, d)
    m = within_km(_left(a, "city_id"), _right(cells(spark, d), "id", "pop"), 25.0).groupBy("lid").agg(F.sum("pop").alias("p"), F.count("*").alias("n"))
    return a.join(m, F.col("city_id") == F.col("lid"), "left").select("city_id", F.coalesce("p", F.lit(0)).alias("pop"), F.coalesce("n", F.lit(0)).alias("cells"))


@query(f"SELECT country, cast(sum(pop) AS BIGINT) AS pop FROM (SELECT DISTINCT a.country, p.id, p.pop FROM city_list a JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 25) GROUP BY country")
def pop_union_discs(spark: SparkSession, d: str) -> DataFrame:
    """Population in the union of a country's discs, each cell once."""
    m = within_km(_left(anchors(spark, d), "city_id", "country"), _right(cells(spark, d), "id", "pop"), 25.0)
    return m.select("country", "rid", "pop").distinct().groupBy("country").agg(F.sum("pop").alias("pop"))


@query(f"SELECT r.km AS radius, cast(sum(q.pop) AS BIGINT) AS pop FROM (SELECT unnest({list(RADII)}) AS km) r JOIN (SELECT p.id, p.pop, min({_km('a', 'p')}) AS km FROM city_list a JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 40 GROUP BY p.id, p.pop) q ON q.km <= r.km GROUP BY r.km")
def radius_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The union of discs at several radii: the nearest city of each cell decides, found once at the largest radius."""
    near = within_km(_left(anchors(spark, d), "city_id"), _right(cells(spark, d), "id", "pop"), float(max(RADII))).groupBy("rid").agg(F.min("km").alias("km"), F.first("pop").alias("pop"))
    each = near.withColumn("radius", F.explode(F.filter(F.array(*map(F.lit, RADII)), lambda r: r >= F.col("km"))))
    return each.groupBy("radius").agg(F.sum("pop").alias("pop"))


@query(f"WITH c AS ({_CELLS_SQL}), n AS (SELECT a.id, count(b.id) - 1 AS n FROM c a JOIN c b ON {_km('a', 'b')} <= 10 GROUP BY a.id) SELECT count(*) AS points, median(n) AS median_neighbours FROM n")
def neighbour_median(spark: SparkSession, d: str) -> DataFrame:
    """The median number of others within 10 km."""
    c = cells(spark, d)
    n = within_km(_left(c, "id"), _right(c, "id"), 10.0).groupBy("lid").agg((F.count("*") - 1).alias("n"))
    return n.agg(F.count("*").alias("points"), F.median("n").alias("median_neighbours"))


@query(f"SELECT a.city_id, count(p.id) AS cells, cast(coalesce(sum(p.pop), 0) AS BIGINT) AS pop FROM city_list a LEFT JOIN ({_CELLS_SQL}) p ON abs(p.lat - a.lat) < 0.5 AND abs(p.lon - a.lon) < 0.5 GROUP BY a.city_id")
def agg_box_probe(spark: SparkSession, d: str) -> DataFrame:
    """Cells strictly inside the box of half a degree around each city."""
    at = lambda c: F.floor(c / 0.5).cast("int")
    a = anchors(spark, d).select("city_id", F.col("lat").alias("y"), F.col("lon").alias("x"))
    around = lambda c: F.explode(F.array(*[at(F.col(c)) + i for i in (-1, 0, 1)]))
    binned = a.withColumn("by", around("y")).withColumn("bx", around("x"))
    c = cells(spark, d).withColumns({"by": at(F.col("lat")), "bx": at(F.col("lon"))})
    hit = binned.join(c, ["by", "bx"]).filter((F.abs(F.col("lat") - F.col("y")) < 0.5) & (F.abs(F.col("lon") - F.col("x")) < 0.5))
    g = hit.groupBy("city_id").agg(F.count("*").alias("n"), F.sum("pop").alias("p"))
    return a.join(g, "city_id", "left").select("city_id", F.coalesce("n", F.lit(0)).alias("cells"), F.coalesce("p", F.lit(0)).alias("pop"))


@query(f"""
WITH c AS ({_CELLS_SQL}), a AS (SELECT cast(floor(lat) AS BIGINT) AS band, sum(pop) AS x, sum(pop + id % 7) AS y FROM c GROUP BY 1)
SELECT band, round(100.0 * (y - x) / x, 6)::DOUBLE AS pct FROM a
""")
def agg_relative_diff(spark: SparkSession, d: str) -> DataFrame:
    """How far two grids differ, in percent, by band."""
    g = cells(spark, d).groupBy(F.floor("lat").alias("band")).agg(F.sum("pop").alias("x"), F.sum(F.col("pop") + F.col("id") % 7).alias("y"))
    return g.select("band", F.round(100.0 * (F.col("y") - F.col("x")).cast("double") / F.col("x"), 6).alias("pct"))


_RANK_SQL = f"""
WITH n AS (SELECT i.city_expected AS city, lower(i.country) AS country, count(DISTINCT r.name) AS people FROM roster r JOIN institutions_geocoded i USING (inst_id) JOIN (SELECT author, count(*) FILTER (layer = 'core' AND NOT is_findings) AS core FROM authorships GROUP BY author) c ON c.author = r.name AND c.core >= 3 GROUP BY ALL),
p AS (SELECT a.city_id, a.city, a.country, cast(sum(p.pop) AS BIGINT) AS pop FROM city_list a LEFT JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 50 GROUP BY ALL)
SELECT p.city, p.country, n.people, coalesce(p.pop, 0) AS pop, CASE WHEN p.pop > 0 THEN round(100000.0 * n.people / p.pop, 4)::DOUBLE ELSE 0 END AS per100k FROM n JOIN p ON n.city = p.city AND n.country = p.country
"""


def city_rates(spark: SparkSession, d: str, km: float = 50.0, core_min: int = 3) -> DataFrame:
    """People with enough core papers on the rosters of a city, the population around it, and the rate per 100,000."""
    i = table(spark, d, "institutions_geocoded").select("inst_id", F.col("city_expected").alias("city"), F.lower("country").alias("country"))
    active = author_counts(spark, d).filter(F.col("core") >= core_min).select("author")
    people = table(spark, d, "roster").select("inst_id", "name").join(active, F.col("name") == F.col("author"), "left_semi").join(i, "inst_id")
    n = people.groupBy("city", "country").agg(F.count_distinct("name").alias("people"))
    a = anchors(spark, d)
    p = within_km(_left(a, "city_id"), _right(cells(spark, d), "id", "pop"), km).groupBy(F.col("lid").alias("city_id")).agg(F.sum("pop").alias("p"))
    rate = F.when(F.col("p") > 0, F.round(F.lit(100000.0).cast("double") * F.col("people") / F.col("p"), 4)).otherwise(F.lit(0.0))
    return a.join(p, "city_id", "left").join(n, ["city", "country"]).select("city", "country", "people", F.coalesce("p", F.lit(0)).alias("pop"), rate.alias("per100k"))


@query(f"SELECT *, row_number() OVER (ORDER BY per100k DESC, city, country) AS place FROM ({_RANK_SQL}) ORDER BY per100k DESC, city, country LIMIT 40")
def city_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The forty cities with the highest rate, numbered after the cut, so that the one-task window sees forty rows."""
    from pyspark.sql import Window

    order = [F.desc("per100k"), F.asc("city"), F.asc("country")]
    top = city_rates(spark, d).orderBy(*order).limit(40)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))


@query(f"SELECT city, country, round(people / (pop / 50.0), 6)::DOUBLE AS per_km2 FROM ({_RANK_SQL}) WHERE pop > 0")
def per_km2(spark: SparkSession, d: str) -> DataFrame:
    """A ratio over a given area column; the area here is a fiftieth of the population."""
    return city_rates(spark, d).filter("pop > 0").select("city", "country", F.round(F.col("people") / (F.col("pop") / 50.0), 6).alias("per_km2"))


@query(f"SELECT city, country, round(log10(people), 6) AS log_people, round(log10(pop), 6) AS log_pop FROM ({_RANK_SQL}) WHERE pop > 0 AND people > 0")
def scatter_log(spark: SparkSession, d: str) -> DataFrame:
    return city_rates(spark, d).filter("pop > 0 and people > 0").select("city", "country", F.round(F.log10("people"), 6).alias("log_people"), F.round(F.log10("pop"), 6).alias("log_pop"))


@query(f"SELECT a.city_id, count(*) AS sites, round(100000.0 * count(*) / sum(p.pop), 4)::DOUBLE AS rate FROM city_list a JOIN ({_CELLS_SQL}) p ON {_km('a', 'p')} <= 30 GROUP BY a.city_id")
def radius_selection(spark: SparkSession, d: str) -> DataFrame:
    """Sites around a centre and their rate over the population."""
    m = within_km(_left(anchors(spark, d), "city_id"), _right(cells(spark, d), "id", "pop"), 30.0)
    return m.groupBy(F.col("lid").alias("city_id")).agg(F.count("*").alias("sites"), F.round(F.lit(100000.0).cast("double") * F.count("*") / F.sum("pop"), 4).alias("rate"))


@query(f"SELECT r.roster_id, a.city_id, round(min({_km('a', 'p')}), 4) AS km FROM city_list a JOIN institutions_geocoded_precise p ON p.lat BETWEEN -90 AND 90 AND p.lon BETWEEN -180 AND 180 AND NOT (p.lat = 0 AND p.lon = 0) AND {_km('a', 'p')} <= 5 JOIN roster r ON r.inst_id = p.inst_id GROUP BY r.roster_id, a.city_id")
def roster_in_range(spark: SparkSession, d: str) -> DataFrame:
    """Roster rows whose institution has a site within 5 km of a city: the nearest site counts."""
    p = table(spark, d, "institutions_geocoded_precise").select(F.col("site_id"), "inst_id", "lat", "lon")
    m = within_km(_left(anchors(spark, d), "city_id"), _right(p, "site_id", "inst_id"), 5.0).groupBy("inst_id", F.col("lid").alias("city_id")).agg(F.min("km").alias("km"))
    return table(spark, d, "roster").select("roster_id", "inst_id").join(m, "inst_id").select("roster_id", "city_id", F.round("km", 4).alias("km"))


@query("""SELECT mode, round(sum(CASE mode WHEN 'all' THEN 1 WHEN 'split' THEN 1.0 / greatest(len(string_split(a, '|')), 1) ELSE CASE WHEN len(string_split(a, '|')) > 1 THEN 0 ELSE 1 END END)::DOUBLE, 4) AS weight
FROM (SELECT coalesce(affiliations_current, '') AS a, unnest(['all', 'split', 'primary']) AS mode FROM dblp_persons) GROUP BY mode""")
def attribution_modes(spark: SparkSession, d: str) -> DataFrame:
    """Whole, split and primary-only counts of people with several affiliations, in one pass."""
    n = F.size(F.split(F.coalesce("affiliations_current", F.lit("")), r"\|"))
    p = table(spark, d, "dblp_persons").select(n.alias("n"), F.explode(F.array(*map(F.lit, ("all", "split", "primary")))).alias("mode"))
    w = F.when(F.col("mode") == "all", 1.0).when(F.col("mode") == "split", 1.0 / F.col("n")).otherwise(F.when(F.col("n") > 1, 0.0).otherwise(1.0))
    return p.groupBy("mode").agg(F.round(F.sum(w), 4).alias("weight"))


@query()
def greedy_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Greedy clusters of institutions by size, 10 km from the seed; order-dependent, no SQL equivalent."""
    i = table(spark, d, "institutions_geocoded").select(F.col("inst_key").alias("id"), "lat", "lon", F.coalesce("csrankings_faculty", F.lit(0)).alias("size"))
    return greedy_clusters(i, 10.0)


@query("""
WITH r AS (SELECT city, country, lat, lon, city_id FROM city_list), i AS (SELECT inst_key, city_expected, lower(country) AS country, lat, lon FROM institutions_geocoded)
SELECT i.inst_key, coalesce(i.lat, min_by(r.lat, r.city_id)) AS lat, coalesce(i.lon, min_by(r.lon, r.city_id)) AS lon FROM i LEFT JOIN r ON i.city_expected = r.city AND i.country = r.country GROUP BY i.inst_key, i.lat, i.lon
""")
def city_anchor(spark: SparkSession, d: str) -> DataFrame:
    """Own coordinates, else those of the listed city."""
    c = anchors(spark, d).groupBy(F.col("city").alias("city_expected"), "country").agg(F.min_by(F.struct("lat", "lon"), "city_id").alias("c"))
    i = table(spark, d, "institutions_geocoded").select("inst_key", "city_expected", F.lower("country").alias("country"), "lat", "lon")
    return i.join(c, ["city_expected", "country"], "left").select("inst_key", F.coalesce("lat", "c.lat").alias("lat"), F.coalesce("lon", "c.lon").alias("lon"))
