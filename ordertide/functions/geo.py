"""Geographic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in kilometres.
RADIUS_KM = 6371.0


def valid_coordinate(lat: Column, lng: Column) -> Column:
    """Finite and within Earth bounds; missing is invalid."""
    ok = (F.abs(lat) <= 90) & (F.abs(lng) <= 180) & ~F.isnan(lat) & ~F.isnan(lng)
    return F.coalesce(ok, F.lit(False))


def in_envelope(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    low_lat, high_lat, low_lng, high_lng = box
    return F.coalesce(lat.between(low_lat, high_lat) & lng.between(low_lng, high_lng), F.lit(False))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null unless both ends are valid coordinates."""
    a = (F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.lit(2))
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lng2) - F.radians(lng1)) / 2), F.lit(2)))
    distance = 2 * RADIUS_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))
    return F.when(valid_coordinate(lat1, lng1) & valid_coordinate(lat2, lng2), distance)
