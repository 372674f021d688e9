"""People and user metadata as rewrites of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labels a photo can have.
LABELS = "red orange yellow green blue purple grey".split()


def merge(refs: DataFrame, exclusions: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    """refs and exclusions with source's under target's name, none lost; the same name, whatever its case, is an error."""
    if source.lower() == target.lower():
        raise ValueError("a person can't be merged with themselves")
    rename = F.when(F.col("name") == source, target).otherwise(F.col("name"))
    return refs.withColumn("name", rename), exclusions.withColumn("name", rename).distinct()


def exclude(exclusions: DataFrame, name: str, hash: str) -> DataFrame:
    row = exclusions.sparkSession.createDataFrame([(name, hash)], "name string, hash string")
    return exclusions.union(row).distinct()


def dismiss(dismissed: DataFrame, faces: DataFrame) -> DataFrame:
    """(hash, idx) that were dismissed, with more of them."""
    return dismissed.union(faces.select("hash", "idx")).distinct()


def restore(dismissed: DataFrame, faces: DataFrame) -> DataFrame:
    return dismissed.join(faces.select("hash", "idx"), ["hash", "idx"], "left_anti")


def remove(refs: DataFrame, name: str) -> DataFrame:
    return refs.where(F.col("name") != name)


def to_pointers(refs: DataFrame, faces: DataFrame) -> DataFrame:
    """refs (name, ref_idx, embedding) with the face (hash, idx) that has the very same vector, or null.

    A face is pointed to once: the k-th reference of a vector takes the k-th face of it.
    """
    key = F.md5(F.to_json(F.struct("embedding")))
    rank = lambda *order: F.row_number().over(Window.partitionBy("vector").orderBy(*order))
    left = refs.withColumn("vector", key).withColumn("k", rank("name", "ref_idx"))
    right = faces.where("embedding IS NOT NULL").select("hash", "idx", key.alias("vector"))
    right = right.withColumn("k", rank("hash", "idx"))
    return left.join(right, ["vector", "k"], "left").drop("vector", "k")


def from_pointers(pointers: DataFrame, faces: DataFrame) -> DataFrame:
    """References of pointers (name, ref_idx, hash, idx, embedding): inline vectors stay, pointers that resolve to no
    face yield nothing."""
    found = faces.select("hash", "idx", F.col("embedding").alias("face"))
    out = pointers.join(found, ["hash", "idx"], "left").withColumn("embedding", F.coalesce("embedding", "face"))
    return out.where("embedding IS NOT NULL").select("name", "ref_idx", "embedding")


def clean_meta(meta: DataFrame) -> DataFrame:
    """User metadata with ratings of 0-5, known labels, and without rows that say nothing."""
    rating = F.greatest(F.lit(0), F.least(F.coalesce("rating", F.lit(0)), F.lit(5)))
    label = F.when(F.col("label").isin(LABELS), F.col("label"))
    out = meta.withColumns({"rating": rating, "label": label, "albums": F.coalesce("albums", F.array().cast("array<string>"))})
    return out.where((F.col("rating") > 0) | F.col("label").isNotNull() | (F.size("albums") > 0))


def set_album(meta: DataFrame, hashes: DataFrame, album: str, member: bool) -> DataFrame:
    """meta with the chosen photos in an album, or out of it."""
    chosen = meta.join(hashes.select("hash").distinct().withColumn("chosen", F.lit(True)), "hash", "left")
    without = F.array_remove("albums", album)
    albums = F.when(F.col("chosen"), F.array_append(without, F.lit(album)) if member else without).otherwise(F.col("albums"))
    return chosen.withColumn("albums", albums).drop("chosen")
