"""Great-circle distance and Cartesian coordinates on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the sphere's radius.
EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null if any coordinate is null."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    # least() and greatest() skip nulls, so they can't do the clipping.
    clipped = F.when(a < 0, 0.0).when(a > 1, 1.0).otherwise(a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(clipped))


def on_sphere(lat: Column, lon: Column, radius: float) -> tuple[Column, Column, Column]:
    """x, y, z of a point on the sphere, so that poles and the date line need no special case."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.lit(radius) * F.cos(la) * F.cos(lo), F.lit(radius) * F.cos(la) * F.sin(lo), F.lit(radius) * F.sin(la)
