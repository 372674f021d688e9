"""Coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kilometres: the earth's radius, and how far a nearest place may be.
RADIUS, REACH = 6371.0088, 120.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def valid_fix(lat: Column, lon: Column) -> Column:
    """Whether coordinates are on the globe; (0, 0) means that there is no fix."""
    known = ~(F.isnan(lat) | F.isnan(lon)) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(known & ~((lat == 0) & (lon == 0)), F.lit(False))


def wrap_cell(cell: Column, parts: int = 1) -> Column:
    """A longitude cell of 1 / parts degrees brought into -180..179 degrees."""
    return F.pmod(cell + 180 * parts, F.lit(360 * parts)) - 180 * parts


def cell(x: Column, parts: int = 1) -> Column:
    return F.floor(x * parts).cast("int")


def cover(lat: Column, lon: Column, reach: float = REACH, parts: int = 1) -> Column:
    """The cells (cell_lat, cell_lon) of 1 / parts degrees that hold every place within reach: whole rows near the poles."""
    dlat = reach / (RADIUS * math.pi / 180)
    # The widest longitude of a circle of that radius.
    wide = F.degrees(F.asin(F.least(F.sin(F.lit(math.radians(dlat))) / F.cos(F.radians(F.abs(lat))), F.lit(1.0))))
    dlon = F.when(F.abs(lat) + dlat >= 89.0, F.lit(180.0)).otherwise(wide + 1e-9)
    lats = F.sequence(cell(lat - dlat, parts), cell(lat + dlat, parts))
    lons = F.when(dlon >= 179, F.sequence(F.lit(-180 * parts), F.lit(180 * parts - 1))).otherwise(
        F.array_distinct(F.transform(F.sequence(cell(lon - dlon, parts), cell(lon + dlon, parts)), lambda c: wrap_cell(c, parts)))
    )
    return F.flatten(
        F.transform(lats, lambda a: F.transform(lons, lambda o: F.struct(a.alias("cell_lat"), o.cast("int").alias("cell_lon"))))
    )


def mercator(lat: Column, lon: Column, zoom: int, tile: int = 256) -> Column:
    """(x, y) in pixels of Web Mercator."""
    size = float(tile << zoom)
    x = (lon + 180) / 360 * size
    sin = F.sin(F.radians(F.greatest(F.least(lat, F.lit(85.05112878)), F.lit(-85.05112878))))
    y = (0.5 - F.log((1 + sin) / (1 - sin)) / (4 * math.pi)) * size
    return F.struct(x.alias("x"), y.alias("y"))


def unproject(x: Column, y: Column, zoom: int, tile: int = 256) -> Column:
    """(lat, lon) of Web Mercator's pixels."""
    size = float(tile << zoom)
    lat = F.degrees(2 * F.atan(F.exp((0.5 - y / size) * 2 * math.pi)) - math.pi / 2)
    return F.struct(lat.alias("lat"), (x / size * 360 - 180).alias("lon"))


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    """Degrees, minutes, seconds and a hemisphere as decimal degrees."""
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def place_label(name: Column, region: Column, country: Column) -> Column:
    """'Name, Region, Country' without empty or repeated parts."""
    parts = F.filter(F.array(*(F.coalesce(c, F.lit("")) for c in (name, region, country))), lambda x: x != "")
    return F.array_join(F.array_distinct(parts), ", ")
