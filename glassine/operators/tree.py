"""Folders: roll-ups and inherited metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, depth_of, in_folder


def rollup(files: DataFrame, directories: DataFrame | None = None, trash: str = "Trash") -> DataFrame:
    """(folder, own, total, depth, has_children) for every folder and the root ''.

    files has folder; total counts everything below.  What lies in trash counts for its own folders but not for the
    root.  Directories without files are listed with zeros.
    """
    counts = files.groupBy("folder").agg(F.count("*").alias("n"))
    up = counts.select("folder", "n", F.explode(ancestors(F.col("folder"))).alias("top"))
    in_trash = (F.col("folder") == trash) | in_folder(F.col("folder"), trash)
    up = up.where(~(in_trash & (F.col("top") == "")))
    if directories is not None:
        empty = directories.select("folder", F.lit(0).cast("long").alias("n"))
        up = up.union(empty.select("folder", "n", F.explode(ancestors(F.col("folder"))).alias("top")))
    own = F.when(F.col("folder") == F.col("top"), F.col("n")).otherwise(0)
    below = F.max(F.col("folder") != F.col("top"))
    out = up.groupBy(F.col("top").alias("folder")).agg(
        F.sum(own).alias("own"), F.sum("n").alias("total"), below.alias("has_children")
    )
    return out.withColumn("depth", depth_of(F.col("folder")))


def cascade(files: DataFrame, meta: DataFrame, value_cols: list[str]) -> DataFrame:
    """files (hash, folder, …) with value_cols of the nearest folder, its own or one above, that has the hash.

    The nearest record counts whole: nothing is merged from farther ones.
    """
    up = files.select("hash", "folder").distinct().withColumn("top", F.explode(ancestors(F.col("folder"))))
    held = meta.select(F.col("folder").alias("top"), "hash", F.struct(*value_cols).alias("record"))
    best = up.join(held, ["top", "hash"]).groupBy("hash", "folder").agg(
        F.max_by("record", depth_of(F.col("top"))).alias("record")
    )
    return files.join(best, ["hash", "folder"], "left").select(*files.columns, *(F.col(f"record.{c}").alias(c) for c in value_cols))


def by_folder(files: DataFrame) -> DataFrame:
    """(folder, files)."""
    return files.groupBy("folder").agg(F.count("*").alias("files"))


def totals(files: DataFrame, analysed: DataFrame, trash: str = "Trash") -> DataFrame:
    """(photos, videos, analysed) of a library: what lies in the trash counts for nothing; analysed has hash.

    files has path, hash and kind; copies are counted one by one.  An empty library has one row of zeros.
    """
    done = analysed.select("hash").where("hash IS NOT NULL").distinct().withColumn("done", F.lit(True))
    rows = files.where(~in_folder(F.col("path"), trash)).join(done, "hash", "left")
    return rows.agg(
        F.count_if(F.col("kind") == "photo").alias("photos"),
        F.count_if(F.col("kind") == "video").alias("videos"),
        F.count_if("done").alias("analysed"),
    )


def time_sources(files: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(taken_src, files, missing): how many files' times come from where, and how many of them are gone from disk."""
    there = on_disk.select("path").distinct().withColumn("there", F.lit(True))
    rows = files.join(there, "path", "left")
    return rows.groupBy("taken_src").agg(F.count("*").alias("files"), F.count_if(F.col("there").isNull()).alias("missing"))


def survey(files: DataFrame, cap: int = 200_000) -> DataFrame:
    """One row: media here, below (null if there are more than cap files), subfolders, and excluded names.

    files has path (relative), kind and skipped, the name of the skipped folder above it or null.
    """
    more = files.limit(cap + 1).count() > cap
    media = F.col("kind").isNotNull() & F.col("skipped").isNull()
    here = ~F.contains("path", F.lit("/"))
    below = F.count_if(media & ~here)
    top = F.when(~here, F.substring_index("path", "/", 1))
    return files.agg(
        F.count_if(media & here).alias("here"),
        (F.lit(None).cast("long") if more else below).alias("below"),
        F.count_distinct(F.when(F.col("skipped").isNull(), top)).alias("subfolders"),
        F.array_sort(F.collect_set("skipped")).alias("excluded"),
    )
