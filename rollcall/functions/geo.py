"""Distances, projections and grids as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
# The European equal-area projection (GRS80, origin 52 N 10 E).
GRS80_A, GRS80_F = 6378137.0, 1.0 / 298.257222101
ORIGIN_LAT, ORIGIN_LON, FALSE_EAST, FALSE_NORTH = 52.0, 10.0, 4321000.0, 3210000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def laea_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    """(lat, lon) in degrees of the equal-area projection; the origin maps to exactly its own coordinates."""
    e2 = 2 * GRS80_F - GRS80_F**2
    e = math.sqrt(e2)

    def authalic(phi: float) -> float:
        s = math.sin(phi)
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    qp = authalic(math.pi / 2)
    rq = GRS80_A * math.sqrt(qp / 2)
    beta0 = math.asin(authalic(math.radians(ORIGIN_LAT)) / qp)
    d = GRS80_A * math.cos(math.radians(ORIGIN_LAT)) / math.sqrt(1 - e2 * math.sin(math.radians(ORIGIN_LAT)) ** 2) / (rq * math.cos(beta0))
    x, y = (east - FALSE_EAST) / d, (north - FALSE_NORTH) * d
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(F.least(rho / (2 * rq), F.lit(1.0)))
    ratio = F.when(rho == 0, 0.0).otherwise(y * F.sin(c) * math.cos(beta0) / F.when(rho == 0, 1.0).otherwise(rho))
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(c) * math.sin(beta0) + ratio)))
    lon = ORIGIN_LON + F.degrees(F.atan2(x * F.sin(c), rho * math.cos(beta0) * F.cos(c) - y * math.sin(beta0) * F.sin(c)))
    e4, e6 = e2 * e2, e2**3
    lat = beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    return F.when(rho == 0, ORIGIN_LAT).otherwise(F.degrees(lat)), F.when(rho == 0, ORIGIN_LON).otherwise(lon)


def equirect(lat: Column, lon: Column, centre_lat: float, centre_lon: float, scale: float) -> tuple[Column, Column]:
    """(x, y) of the equirectangular map around a centre, true to scale at it."""
    return (lon - centre_lon) * math.cos(math.radians(centre_lat)) * scale, (centre_lat - lat) * scale


def cell(c: Column, step: float) -> Column:
    """The index of the grid cell around a coordinate, half to even."""
    return F.bround(c / F.lit(step)).cast("int")
