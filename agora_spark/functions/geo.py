"""Distances on the sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean Earth radius of fences and searches, and the rounder one that the duplicate finder uses.
EARTH_KM, EARTH_KM_DUPLICATES = 6371.0088, 6371.0


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def in_box(lat: Column, lng: Column, at_lat: float, at_lng: float, km: float) -> Column:
    """A box around a circle: pushed to the scan, it spares most rows the exact distance."""
    d_lat = math.degrees(km / EARTH_KM) * 1.001
    d_lng = min(180.0, d_lat / max(1e-6, math.cos(math.radians(at_lat))))
    return lat.between(at_lat - d_lat, at_lat + d_lat) & lng.between(at_lng - d_lng, at_lng + d_lng)
