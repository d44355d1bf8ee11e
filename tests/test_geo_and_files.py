from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.functions import geo as G
from rollcall.functions import names as N
from rollcall.functions.normalize import mend_encoding
from rollcall.operators.clusters import greedy_clusters
from rollcall.operators.ranges import near_box, within_km
from rollcall.sources import files
from rollcall.sources.raster import register, write_raster


def test_projection_origin_is_exact(spark):
    lat, lon = G.laea_inverse(F.lit(4321000.0), F.lit(3210000.0))
    assert tuple(spark.range(1).select(lat, lon).first()) == (52.0, 10.0)


def test_clusters_are_not_transitive(spark, rows):
    step = 8 / 111.195
    pts = spark.createDataFrame([(1, 50.0, 5.0, 9), (2, 50.0 + step, 5.0, 5), (3, 50.0 + 2 * step, 5.0, 7), (4, None, 5.0, 99), (5, 10.0, 1.0, 1)], "id long, lat double, lon double, size int")
    assert rows(greedy_clusters(pts)) == [(1, 1), (2, 1), (3, 3), (5, 5)]
    assert rows(greedy_clusters(pts.filter("false"))) == []


def test_distance_join_across_the_date_line_and_poles(spark):
    rng = np.random.default_rng(0)
    a = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-90, 90, 120), rng.uniform(-180, 180, 120), strict=True))] + [(900, 0.5, 179.99), (901, 89.99, 3.0), (902, None, 1.0)]
    b = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-90, 90, 120), rng.uniform(-180, 180, 120), strict=True))] + [(900, 0.5, -179.99), (901, 89.99, -170.0)]
    left, right = spark.createDataFrame(a, "lid long, llat double, llon double"), spark.createDataFrame(b, "rid long, rlat double, rlon double")

    def km(p, q):
        h = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * G.EARTH_KM * math.asin(min(1, math.sqrt(h)))

    for r in (30.0, 900.0, 4000.0):
        want = {(i, j) for i, x, y in a if x is not None for j, u, v in b if km((x, y), (u, v)) <= r}
        assert {(x["lid"], x["rid"]) for x in within_km(left, right, r).collect()} == want


def test_box_is_strict_and_negative_cells_decode(spark, rows):
    cells = spark.createDataFrame([(1, -0.125, -0.125), (2, 0.5, 0.5), (3, 9.0, 9.0)], "id long, lat double, lon double")
    pts = spark.createDataFrame([(0.0, -0.625), (0.5, 1.0), (None, 1.0)], "plat double, plon double")
    assert rows(near_box(cells, pts, 0.5, 0.5).select("id")) == []
    assert rows(near_box(cells, pts, 0.6, 0.6).select("id")) == [(1,), (2,)]
    assert rows(near_box(cells, pts, 0.6, 0.6, near=False).select("id")) == [(3,)]
    got = spark.createDataFrame([(-31.078,), (0.05,), (0.25,)], "x double").select(G.cell(F.col("x"), 0.1)).collect()
    assert [r[0] for r in got] == [-311, 0, 2]  # half to even


def test_folds(spark):
    def f(fn, text):
        return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t"))).first()[0]

    assert f(N.fold_name, "Prof. Dr.-Ing. José  Núñez 0003") == "jose nunez"
    assert f(N.fold_name, "Dr Em") == "em" and f(N.fold_name, None) == "" and f(N.fold_name, "Prof") == "prof"
    assert f(N.fold_keep_suffix, "José Núñez 0003") == "jose nunez 0003"
    assert f(N.city_key, "Muenchen") == "munich" and f(N.city_key, "Zürich") == "zurich"
    assert f(N.normalise_title, "Prof. Dr. rer. nat. habil.") == "prof"
    assert f(mend_encoding, "SÃ¸ren Ã‰pi") == "Søren Épi" and f(mend_encoding, "plain Å") == "plain Å"


def test_strict_width_and_round_trip(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.csv").write_text('a,b\n1,2\n3\n')
    with pytest.raises(Exception):
        files.read_csv(spark, str(tmp_path / "bad"), ["a", "b"], strict=True).select(F.struct("a", "b")).collect()
    df = spark.createDataFrame([("1", ' "q", x\ny '), ("2", None), ("3", "")], "a string, b string")
    files.write_csv(df, str(tmp_path / "good"))
    back = {r["a"]: r["b"] or "" for r in files.read_csv(spark, str(tmp_path / "good"), ["a", "b"]).collect()}
    assert back == {"1": ' "q", x\ny ', "2": "", "3": ""}


def test_broken_xml_harms_no_other(spark, tmp_path):
    (tmp_path / "d.xml").write_text('<dblp>\n<www key="homepages/1"><author pid="p1">A &uuml;</author></www>\n<www key="homepages/2"><author>B<x></author></www>\n<www key="homepages/3"><author>C</author><author>D</author></www>\n</dblp>')
    got = files.read_xml(spark, str(tmp_path), "www", "_key string, author array<struct<_pid:string,_VALUE:string>>").collect()
    assert len(got) == 3 and sum(r["_corrupt_record"] is not None for r in got) == 1
    assert [a["_VALUE"] for r in got if r["_key"] == "homepages/3" for a in r["author"]] == ["C", "D"]


def test_raster_window_and_georeference(spark, tmp_path):
    path = str(tmp_path / "r.tif")
    values = np.arange(600, dtype="f4").reshape(20, 30) - 10
    write_raster(path, values, west=5.0, north=50.0, step=0.1)
    register(spark)
    rows = spark.read.format("population_raster").option("path", path).option("rows", 7).load().collect()
    assert len(rows) == int((values > 0).sum()) and sum(r["pop"] for r in rows) == float(values[values > 0].sum())
    top = max(rows, key=lambda r: r["pop"])
    assert abs(top["lat"] - (50 - 19.5 * 0.1)) < 1e-9 and abs(top["lon"] - (5 + 29.5 * 0.1)) < 1e-9
    some = spark.read.format("population_raster").option("path", path).option("lat_max", 49.0).option("lon_min", 7.0).load()
    assert some.agg(F.max("lat"), F.min("lon")).first()[0] < 49.0
