"""Places on the map: boxes around a point, guards, and grid cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.32


def _value(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def box(lat: Column | float, lon: Column | float, radius_km: Column | float) -> dict[str, Column]:
    """South, north, west, east, and whether the circle crosses the antimeridian (then west..east is the whole world)."""
    lat, lon, radius = _value(lat), _value(lon), _value(radius_km)
    d_lat = radius / KM_PER_DEGREE
    d_lon = radius / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    crosses = (lon - d_lon < -180) | (lon + d_lon > 180)
    wide = crosses | (d_lon >= 180)
    return {
        "south": F.greatest(lat - d_lat, F.lit(-90.0)),
        "north": F.least(lat + d_lat, F.lit(90.0)),
        "west": F.when(wide, -180.0).otherwise(lon - d_lon),
        "east": F.when(wide, 180.0).otherwise(lon + d_lon),
        "crosses": crosses,
    }


def strips(lat: Column | float, lon: Column | float, radius_km: Column | float) -> Column:
    """array of (south, north, west, east): the box as it is on a globe. One that crosses the antimeridian is two strips, one wider than the globe is all of it."""
    lat, lon, radius = _value(lat), _value(lon), _value(radius_km)
    b = box(lat, lon, radius)
    d_lon = radius / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    strip = lambda west, east: F.struct(b["south"].alias("south"), b["north"].alias("north"), west.alias("west"), east.alias("east"))
    edge = lambda x: F.lit(x)
    west, east = lon - d_lon, lon + d_lon
    return (
        F.when(d_lon >= 180, F.array(strip(edge(-180.0), edge(180.0))))
        .when(west < -180, F.array(strip(edge(-180.0), east), strip(west + 360, edge(180.0))))
        .when(east > 180, F.array(strip(west, edge(180.0)), strip(edge(-180.0), east - 360)))
        .otherwise(F.array(strip(west, east)))
    )


def valid(lat: Column, lon: Column) -> Column:
    """Both present and in range; never null."""
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def inside(lat: Column, lon: Column, b: dict[str, Column]) -> Column:
    return lat.between(b["south"], b["north"]) & lon.between(b["west"], b["east"])


def cell(x: Column, size: float) -> Column:
    """Index of the grid cell of that size, in degrees."""
    return F.floor(x / size).cast("long")
