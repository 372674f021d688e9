"""Listings, details, work still to do and duplicates under review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import folder_of, in_folder, name_of, stem_of
from ..functions.times import batch
from ..scratch import numbered


def last_paths(files: DataFrame) -> DataFrame:
    """(hash, path): for every content the last path in order, as copies share a hash."""
    return files.groupBy("hash").agg(F.max("path").alias("path"))


def listing(files: DataFrame, signatures: DataFrame, meta: DataFrame, faces: DataFrame) -> DataFrame:
    """files with size of image, rating, label and number of faces, absent values as defaults; newest first.

    The other tables have one row per hash.
    """
    out = files.join(signatures, "hash", "left").join(meta, "hash", "left").join(faces, "hash", "left")
    out = out.withColumns({"rating": F.coalesce("rating", F.lit(0)), "faces": F.coalesce("faces", F.lit(0).cast("long"))})
    return out.orderBy(F.desc_nulls_last("taken_at"), name_of(F.col("path")))


def scope(files: DataFrame, folder: str = "", people: DataFrame | None = None, hashes: DataFrame | None = None) -> DataFrame:
    """files of a folder, of a person's photos (hash) and of a selection (hash)."""
    out = files.where(in_folder(F.col("path"), folder))
    for some in (people, hashes):
        if some is not None:
            out = out.join(some.select("hash").distinct(), "hash", "left_semi")
    return out


def sort_keys(sort: str, order: list[str] | None = None) -> list[Column]:
    """Sort columns of a folder's view: newest, oldest, name, rating, size or custom (listed ones first)."""
    newest = [F.desc_nulls_last("taken_at"), F.col("path")]
    if sort == "custom":
        at = F.array_position(F.array(*map(F.lit, order or [""])), F.col("hash"))
        return [F.when(at > 0, at).otherwise(F.lit(2**62)), *newest]
    return {
        "newest": newest,
        "oldest": [F.asc_nulls_last("taken_at"), F.col("path")],
        "name": [F.lower(name_of(F.col("path"))), F.col("path")],
        "rating": [F.desc("rating"), *newest],
        "size": [F.desc("size"), F.col("path")],
    }.get(sort, newest)


def detail(files: DataFrame, value: str) -> DataFrame:
    """The first row, by path, of one content."""
    return files.where(F.col("hash") == value).orderBy("path").limit(1)


def live_pairs(files: DataFrame) -> DataFrame:
    """(still, motion): paths of a photo and the MOV of the same folder and stem."""
    keyed = files.select("path", "kind", folder_of(F.col("path")).alias("f"), F.lower(stem_of(F.col("path"))).alias("s"))
    still = keyed.where("kind = 'photo'").select("f", "s", F.col("path").alias("still"))
    motion = keyed.where((F.col("kind") == "video") & F.lower("path").endswith(".mov"))
    return still.join(motion.select("f", "s", F.col("path").alias("motion")), ["f", "s"]).select("still", "motion")


def missing(files: DataFrame, done: DataFrame, unreadable: DataFrame | None = None, version: str | None = None) -> DataFrame:
    """files without a row in done, and not known as unreadable by the same version."""
    out = files.join(done.select("hash").distinct(), "hash", "left_anti")
    if unreadable is not None:
        out = out.join(unreadable.where(F.col("version") == version).select("hash").distinct(), "hash", "left_anti")
    return out


def pending(files: DataFrame, **done: DataFrame) -> DataFrame:
    """One row: distinct photos, and for each table how many of them it lacks and whether it was begun."""
    out = files.where("kind = 'photo'").select("hash").distinct()
    for name, table in done.items():
        out = out.join(table.select("hash").distinct().withColumn(name, F.lit(True)), "hash", "left")
    aggs = [F.count("*").alias("photos")]
    for name in done:
        aggs += [F.count_if(F.col(name).isNull()).alias(f"{name}_missing"), F.coalesce(F.bool_or(name), F.lit(False)).alias(f"{name}_started")]
    return out.agg(*aggs)


def reclaimable(members: DataFrame) -> DataFrame:
    """(group_id, files, bytes): what each group would free if only its keeper stayed; members has is_keep and size."""
    return members.groupBy("group_id").agg(
        F.count("*").alias("files"), F.sum(F.when(F.col("is_keep"), 0).otherwise(F.col("size"))).alias("bytes")
    )


def keepers(members: DataFrame) -> DataFrame:
    """members (group_id, path, sharpness, …) with is_keep: the sharpest of the group, of equals the last path."""
    best = F.max(F.struct("sharpness", "path")).over(Window.partitionBy("group_id"))
    return members.withColumn("is_keep", F.col("path") == best["path"])


def review(members: DataFrame) -> DataFrame:
    """members with quality (0-100, relative to the sharpest of the group) and the batch they are reviewed in."""
    most = F.max("sharpness").over(Window.partitionBy("group_id"))
    quality = F.when(most <= 1e-9, 100).otherwise(
        F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.sqrt(F.col("sharpness") / most) * 100).cast("int")))
    )
    return members.withColumn("quality", quality.cast("int")).withColumn("batch", batch(F.col("taken_at"), F.col("place")))


def scenery(photos: DataFrame, faces: DataFrame, done: DataFrame, limit: float = 0.04) -> DataFrame:
    """(hash, ratio, is_scenery) of the analysed photos: the largest face takes less than limit of the width."""
    most = faces.groupBy("hash").agg(F.max("ratio").alias("ratio"))
    seen = photos.join(done.select("hash").distinct(), "hash", "left_semi").join(most, "hash", "left")
    ratio = F.coalesce("ratio", F.lit(0.0))
    return seen.withColumn("ratio", ratio).withColumn("is_scenery", F.col("ratio") < limit)


def months(files: DataFrame) -> DataFrame:
    """(month, files) of the capture times."""
    month = F.date_trunc("month", "taken_at").alias("month")
    return files.where("taken_at IS NOT NULL").groupBy(month).agg(F.count("*").alias("files"))


def album_counts(meta: DataFrame) -> DataFrame:
    """(album, photos)."""
    return meta.select("hash", F.explode("albums").alias("album")).groupBy("album").agg(F.countDistinct("hash").alias("photos"))


def described(meta: DataFrame) -> DataFrame:
    """One row: photos that somebody has rated, labelled or put into an album."""
    said = (F.coalesce("rating", F.lit(0)) > 0) | F.col("label").isNotNull() | (F.coalesce(F.size("albums"), F.lit(0)) > 0)
    return meta.where(said).agg(F.countDistinct("hash").alias("photos"))


def stored(files: DataFrame) -> DataFrame:
    """(folder, files, bytes) of the top folders of a cache's files (path, size); '' is what lies beside them."""
    top = F.when(F.col("path").contains("/"), F.split("path", "/")[0]).otherwise("").alias("folder")
    return files.groupBy(top).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def every(df: DataFrame, step: int, *order) -> DataFrame:
    """Every step-th row of the whole table, from the first on, in the given order."""
    return numbered(df, "__n", *order).where(F.col("__n") % step == 0).drop("__n")
