"""Great-circle geometry: Column expressions that stay inside code generation, and numpy twins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0


def haversine_km(lat1, lng1, lat2, lng2, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance in km between two points in degrees; null where any field is null."""
    lat1, lng1, lat2, lng2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lng1, lat2, lng2))
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2.0)) + F.cos(p1) * F.cos(p2) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0)
    )
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(2.0 * radius) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def haversine_np(lat1, lng1, lat2, lng2, radius: float = EARTH_RADIUS_KM):
    """:func:`haversine_km` over numpy arrays."""
    p1, p2 = np.radians(lat1), np.radians(lat2)
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(lng2 - lng1) / 2) ** 2
    return 2 * radius * np.arcsin(np.sqrt(np.clip(a, 0, 1)))


def unit_vectors(lat, lng):
    """Points in degrees as (n, 3) vectors on the unit sphere; seamless at the poles and at 180 degrees."""
    p, q = np.radians(lat), np.radians(lng)
    return np.column_stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def decimal_degrees(degrees, minutes, seconds) -> Column:
    """Degrees, minutes and seconds as decimal degrees; the sign is that of the degrees."""
    d, m, s = (F.col(c) if isinstance(c, str) else c for c in (degrees, minutes, seconds))
    size = F.abs(d) + m / F.lit(60.0) + s / F.lit(3600.0)
    return F.when(d < 0, -size).otherwise(size)


# Km in a nautical mile, and its minutes in a degree.
KM_PER_NAUTICAL_MILE = 1.852
MINUTES_PER_DEGREE = 60.0


def degree_offsets(lat, distance_km: float) -> tuple[Column, Column]:
    """Offsets in degrees of latitude and longitude that span ``distance_km`` at latitude ``lat``."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    dlat = F.lit(distance_km / (KM_PER_NAUTICAL_MILE * MINUTES_PER_DEGREE))
    return dlat, dlat / F.cos(F.radians(lat))


def mercator_x(lng) -> Column:
    """Web-Mercator x in metres."""
    return F.radians(F.col(lng) if isinstance(lng, str) else lng) * F.lit(6378137.0)


def mercator_y(lat) -> Column:
    """Web-Mercator y in metres."""
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.lit(6378137.0) * F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2))


def mercator_lng(x) -> Column:
    return F.degrees((F.col(x) if isinstance(x, str) else x) / F.lit(6378137.0))


def mercator_lat(y) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y / F.lit(6378137.0))) - F.lit(np.pi / 2))
