"""Column functions over positions and depths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Depth zones as (label, lower bound inclusive, upper bound exclusive).
DEPTH_ZONES = [
    ("0-50m", 0.0, 50.0),
    ("50-200m", 50.0, 200.0),
    ("200-1000m", 200.0, 1000.0),
    ("1000-4000m", 1000.0, 4000.0),
    (">4000m", 4000.0, None),
]
UNKNOWN_ZONE = "(unknown depth)"
ZONE_ORDER = [label for label, _, _ in DEPTH_ZONES] + [UNKNOWN_ZONE]

# Mean Earth radii in use.
EARTH_RADIUS_KM = 6371.0088
EARTH_RADIUS_ROUNDED_KM = 6371.0


def depth_zone(metres: Column) -> Column:
    """Zone label; negative depths count as the surface and NULL gives an empty label."""
    depth = F.greatest(metres, F.lit(0.0))
    label = F.when(metres.isNull(), F.lit(""))
    for name, _, upper in DEPTH_ZONES[:-1]:
        label = label.when(depth < upper, F.lit(name))
    return label.otherwise(F.lit(DEPTH_ZONES[-1][0]))


def ocean_basin(lat: Column, lon: Column) -> Column:
    """Basin name from coarse boxes, first matching rule wins."""
    return (
        F.when(lat <= -60, "Southern Ocean")
        .when(lat >= 66, "Arctic Ocean")
        .when(lat.between(30, 46) & lon.between(-6, 42), "Mediterranean/Black Sea")
        .when(lon.between(-70, 20), "Atlantic Ocean")
        .when((lon > 20) & (lon <= 120), "Indian Ocean")
        .when(lat.isNotNull() & lon.isNotNull(), "Pacific Ocean")
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_RADIUS_KM) -> Column:
    """Great-circle distance; safe against rounding past one."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(half_lon), 2)
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def wrap_longitude(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def longitude_gap(lon1: Column, lon2: Column) -> Column:
    """Absolute longitude difference taken the short way round."""
    return F.abs(wrap_longitude(lon1 - lon2))


def cell_centre(degrees: Column) -> Column:
    """Centre of the one-degree cell that holds a coordinate."""
    return F.floor(degrees) + 0.5


def grid_cell(degrees: Column, size: int) -> Column:
    """Lower edge of the ``size``-degree cell that holds a coordinate."""
    return (F.floor(degrees / size) * size).cast("int")


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return F.cos(phi) * F.cos(lam), F.cos(phi) * F.sin(lam), F.sin(phi)
