"""Gazetteers: built from tables of places, written and read in a packed binary format."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import PLACES

#: The format's mark, and how many units make a degree.
MAGIC, SCALE = b"OFGEO2\n", 10_000


def build(cities: DataFrame, regions: DataFrame, countries: DataFrame) -> DataFrame:
    """PLACES and country_code from cities (name, ascii, lat, lon, country_code, region_code, population), regions (code, region) and
    countries (country_code, country), numbered by population."""
    key = F.concat_ws(".", "country_code", "region_code")
    rows = cities.withColumn("code", key).join(regions, "code", "left").join(countries, "country_code", "left")
    rank = (F.row_number().over(Window.orderBy(F.desc("population"), "name", "lat", "lon")) - 1).alias("place_id")
    plain = F.when(F.col("ascii") == F.col("name"), "").otherwise(F.coalesce("ascii", F.lit("")))
    return rows.select(
        rank, "name", plain.alias("ascii"), F.coalesce("region", F.lit("")).alias("region"),
        F.coalesce("country", "country_code").alias("country"), "lat", "lon", "country_code",
    )


class _Cursor:
    """Reads a packed file from front to back; an error where it is cut short."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        size = struct.calcsize("<" + form)
        if self.at + size > len(self.data):
            raise ValueError("the gazetteer is cut short")
        self.at += size
        return struct.unpack_from("<" + form, self.data, self.at - size)

    def text(self, length: str = "B") -> str:
        (n,) = self.take(length)
        return self.take(f"{n}s")[0].decode("utf-8", "replace")


def _short(text: str) -> bytes:
    raw = text.encode()[:255]
    return bytes([len(raw)]) + raw


def pack(places: list[tuple]) -> bytes:
    """places (name, ascii, region, country, lat, lon, country_code), most populous first, as one file.

    Fixed by the format: countries (code, name) and regions, each with their number before them, then the places, which
    refer to them; lengths of one byte, of two for regions; everything little-endian.
    """
    countries = {p[6]: p[3] for p in places}
    regions = sorted({p[2] for p in places})
    country_at = {c: i for i, c in enumerate(sorted(countries))}
    region_at = {r: i for i, r in enumerate(regions)}
    out = [MAGIC, struct.pack("<I", len(countries))]
    out += [_short(c) + _short(countries[c]) for c in country_at]
    out.append(struct.pack("<I", len(regions)))
    out += [struct.pack("<H", len(r.encode())) + r.encode() for r in regions]
    out.append(struct.pack("<I", len(places)))
    for name, ascii_, region, _, lat, lon, code in places:
        where = struct.pack("<iiHH", round(lat * SCALE), round(lon * SCALE), country_at[code], region_at[region])
        out.append(_short(name) + _short(ascii_) + where)
    return b"".join(out)


def unpack(data: bytes) -> Iterator[tuple]:
    """PLACES rows of a packed file; an error if it is cut short or something else."""
    if not data.startswith(MAGIC):
        raise ValueError("not a gazetteer")
    cursor = _Cursor(data)
    cursor.at = len(MAGIC)
    countries = [(cursor.text(), cursor.text()) for _ in range(cursor.take("I")[0])]
    regions = [cursor.text("H") for _ in range(cursor.take("I")[0])]
    for i in range(cursor.take("I")[0]):
        name, plain = cursor.text(), cursor.text()
        lat, lon, country, region = cursor.take("iiHH")
        yield i, name, plain, regions[region], countries[country][1], lat / SCALE, lon / SCALE


def read(spark: SparkSession, path: str) -> DataFrame:
    """PLACES of packed files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLACES.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                yield pd.DataFrame(list(unpack(data)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, PLACES)


def outlines(geojson: DataFrame, digits: int = 2) -> DataFrame:
    """(n, points) of GeoJSON geometries (value): rounded, without repeated neighbours, of at least four points."""
    shape = "features array<struct<geometry: struct<type: string, coordinates: string>>>"
    rows = geojson.select(F.explode(F.from_json("value", shape)["features"]).alias("f")).select("f.geometry.*")
    polygon = F.from_json("coordinates", "array<array<array<double>>>")
    many = F.flatten(F.from_json("coordinates", "array<array<array<array<double>>>>"))
    rings = rows.select(F.explode(F.when(F.col("type") == "Polygon", polygon).otherwise(many)).alias("ring"))
    rounded = F.transform("ring", lambda p: F.transform(p, lambda x: F.round(x, digits)))
    rings = rings.select(rounded.alias("ring"))
    kept = F.filter("ring", lambda p, i: (i == 0) | ~p.eqNullSafe(F.try_element_at("ring", F.greatest(i, F.lit(1)))))
    return rings.select(F.monotonically_increasing_id().alias("n"), kept.alias("points")).where(F.size("points") >= 4)
