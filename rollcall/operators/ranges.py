"""Range and distance joins as equi-joins on bins.

A latitude band is as wide as the range; in a band, longitude bins are as wide as the range at the band's highest
latitude. A row of the left side looks into its own and the neighbouring bins of the right side; a residual predicate
decides. Nothing is compared across bins, so no cross join arises.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.geo import EARTH_KM, haversine
from rollcall.operators.spatial import usable

KM_PER_DEGREE = EARTH_KM * math.pi / 180


def _bins(lat: Column, lon: Column, dlat: float) -> tuple[Column, Column]:
    return F.floor(lat / dlat).cast("int"), lon


def _width(band: Column, dlat: float) -> Column:
    """Degrees of longitude that cover the range anywhere in a band; the whole circle near a pole."""
    top = F.least(F.greatest(F.abs(band * dlat), F.abs((band + 1) * dlat)) + dlat, F.lit(90.0))
    cos = F.cos(F.radians(top))
    return F.when(cos < 0.01, 360.0).otherwise(F.least(F.lit(360.0), dlat / F.greatest(cos, F.lit(0.01))))


def within_km(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs of rows at most km apart on the sphere, with `km`.

    left (lid, llat, llon) and right (rid, rlat, rlon); rows with unusable coordinates match nothing.
    """
    dlat = km / KM_PER_DEGREE * (1 + 1e-9) + 1e-12
    band = lambda c: F.floor(c / dlat).cast("int")
    r = right.filter(usable(F.col("rlat"), F.col("rlon"))).withColumn("band", band(F.col("rlat")))
    r = r.withColumn("bin", F.floor((F.col("rlon") + 180) / _width(F.col("band"), dlat)).cast("int"))
    b = left.filter(usable(F.col("llat"), F.col("llon"))).withColumn("band", F.explode(F.array(*[band(F.col("llat")) + i for i in (-1, 0, 1)])))
    b = b.withColumn("w", _width(F.col("band"), dlat))
    # Beyond the date line the circle begins again.
    b = b.withColumn("x", F.explode(F.filter(F.array(F.col("llon"), F.col("llon") + 360, F.col("llon") - 360), lambda x: (x >= -180 - F.col("w")) & (x <= 180 + F.col("w")))))
    b = b.withColumn("bin", F.explode(F.array(*[F.floor((F.col("x") + 180) / F.col("w")).cast("int") + i for i in (-1, 0, 1)]))).drop("w", "x")
    d = haversine(F.col("llat"), F.col("llon"), F.col("rlat"), F.col("rlon"))
    met = b.join(r, ["band", "bin"]).withColumn("km", d).filter(F.col("km") <= km)
    return met.select(*[c for c in left.columns], *[c for c in right.columns], "km").dropDuplicates(["lid", "rid"])


def near_box(cells: DataFrame, points: DataFrame, dlat: float, dlon: float, near: bool = True) -> DataFrame:
    """Cells (lat, lon, ...) with, or with near=False without, a point (plat, plon) strictly inside the box around them."""
    at = lambda c, w: F.floor(c / w).cast("int")
    p = points.filter("plat is not null and plon is not null").select("plat", "plon", at(F.col("plat"), dlat).alias("by"), at(F.col("plon"), dlon).alias("bx"))
    p = p.withColumn("by", F.explode(F.array(*[F.col("by") + i for i in (-1, 0, 1)]))).withColumn("bx", F.explode(F.array(*[F.col("bx") + i for i in (-1, 0, 1)])))
    c = cells.withColumns({"by": at(F.col("lat"), dlat), "bx": at(F.col("lon"), dlon)})
    hit = (c["by"] == p["by"]) & (c["bx"] == p["bx"]) & (F.abs(F.col("lat") - F.col("plat")) < dlat) & (F.abs(F.col("lon") - F.col("plon")) < dlon)
    return c.join(p, hit, "left_semi" if near else "left_anti").drop("by", "bx")
