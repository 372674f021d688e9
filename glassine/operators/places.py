"""Nearest places and search by name."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.places import RADIUS, REACH, cell, cover, haversine, mercator, valid_fix, wrap_cell
from ..scratch import numbered, written


#: Places that the search of one position should meet, and the latitude from which cells narrow too much for a short search.
CROWD, STEEP = 16, 85.0


def _radii(spots: DataFrame, reach: float) -> list[float]:
    """Ascending radii up to reach, each four times the one before; the first meets some CROWD of the spots around a spot."""
    n = spots.groupBy(cell(F.col("plat")), cell(F.col("plon"))).agg(F.count("*").cast("double").alias("n"))
    around = n.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0] or 0.0
    # A one-degree cell is some 111 km wide; a search meets the cells of a square around its circle.
    crowd = around * max(1.0, (3 * reach / 111) ** 2)
    steps = math.ceil(math.log(crowd / CROWD, 16)) if crowd > CROWD else 0
    return [reach / 4**k for k in range(steps, -1, -1)]


def _meet(spots_of: DataFrame, spots: DataFrame, radius: float) -> DataFrame:
    """(lat, lon, place, km) of the positions (lat, lon) that have a spot within radius, with the nearest."""
    wide = radius * (1 + 1e-9)  # what rounding puts inside is inside the cells too
    parts = max(1, int(RADIUS * math.pi / 180 / wide))
    own = spots_of.withColumn("c", F.explode(cover(F.col("lat"), F.col("lon"), wide, parts)))
    own = own.select("lat", "lon", "c.cell_lat", "c.cell_lon")
    cells = spots.withColumn("cell_lat", cell(F.col("plat"), parts))
    cells = cells.withColumn("cell_lon", wrap_cell(cell(F.col("plon"), parts), parts).cast("int"))
    km = haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))
    near = own.join(cells, ["cell_lat", "cell_lon"]).withColumn("km", km).where(F.col("km") <= radius)
    first = F.min_by("place", F.struct("km", "place.place_id")).alias("place")
    return near.groupBy("lat", "lon").agg(first, F.min("km").alias("km"))


def nearest(points: DataFrame, places: DataFrame, id_col: str, reach: float = REACH) -> DataFrame:
    """points (id_col, lat, lon) with place (place_id, name, ...) and km, null beyond reach.

    Positions are searched once each, however many points or places share them, first within a short radius that follows
    how crowded the places are; only those without a place there look four times as far, up to reach.  A search is an
    equi-join on the cells that its circle covers, so the nearest place is exact at any latitude.  Equal distances go
    to the smaller place_id.
    """
    named = F.struct(*(c for c in places.columns if c not in ("lat", "lon")))
    # A null or a coordinate off the globe is near nothing.
    spots = places.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    spots = spots.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon"))
    spots = written(spots.agg(F.min_by(named, "place_id").alias("place")))
    left = written(points.where(valid_fix(F.col("lat"), F.col("lon"))).select("lat", "lon").distinct())
    found = []
    for radius in _radii(spots, reach):
        last = radius == reach
        asked = left if last else left.where(F.abs("lat") < STEEP)
        hit = written(_meet(asked, spots, radius))
        found.append(hit)
        left = left if last else written(left.join(hit, ["lat", "lon"], "left_anti"))
    best = reduce(DataFrame.union, found)
    joined = points.join(best, ["lat", "lon"], "left")
    return joined.select(id_col, *(c for c in points.columns if c != id_col), "place", "km")


def located(points: DataFrame) -> DataFrame:
    """(checked, found): of the rows looked at, those with a fix."""
    return points.agg(F.count("*").alias("checked"), F.count_if(valid_fix(F.col("lat"), F.col("lon"))).alias("found"))


def search(places: DataFrame, text: str, limit: int, exhaustive: bool = False) -> DataFrame:
    """The places whose name or plain spelling holds text: exact before prefix before the rest, then by population.

    Unless exhaustive, only the first 8 * limit + 1 matches by population are ranked.
    """
    text = text.strip().lower()
    if not text:
        return places.limit(0).withColumn("bucket", F.lit(0))
    spellings = [F.lower("name"), F.lower("ascii")]
    any_of = lambda test: F.coalesce(test(spellings[0]), F.lit(False)) | (
        F.coalesce((spellings[1] != "") & test(spellings[1]), F.lit(False))
    )
    bucket = (
        F.when(any_of(lambda c: c == text), 0)
        .when(any_of(lambda c: c.startswith(text)), 1)
        .when(any_of(lambda c: c.contains(text)), 2)
    )
    found = places.withColumn("bucket", bucket).where("bucket IS NOT NULL")
    if not exhaustive:
        found = found.orderBy("place_id").limit(8 * limit + 1)
    return found.orderBy("bucket", "place_id").limit(limit)


def pins(points: DataFrame, zoom: int, pixels: int = 64) -> DataFrame:
    """Map pins: points by squares of the map at a zoom, with their number and mean position."""
    at = mercator(F.col("lat"), F.col("lon"), zoom)
    square = lambda c: F.floor(c / pixels)
    return points.withColumn("at", at).groupBy(square(F.col("at.x")).alias("px"), square(F.col("at.y")).alias("py")).agg(
        F.count("*").alias("photos"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")
    )


def ranked_places(places: DataFrame) -> DataFrame:
    """places (…, population) with place_id, their rank by population."""
    return numbered(places, "place_id", F.desc("population"), "name").withColumn("place_id", F.col("place_id").cast("int"))
