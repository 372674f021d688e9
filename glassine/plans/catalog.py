"""The catalogue: keyed merges, reconciliation with a scan, and versioned tables."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.listing import missing
from ..scratch import written


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old and the rows of new whose keys it doesn't have."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def repath(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files at their new paths; moves has from and to."""
    to = moves.select(F.col("from").alias("path"), F.col("to").alias("new_path"))
    out = files.join(to, "path", "left").withColumn("path", F.coalesce("new_path", "path"))
    return out.select(*files.columns)


def remove(files: DataFrame, paths: DataFrame) -> DataFrame:
    return files.join(paths.select("path"), "path", "left_anti")


def reconcile(catalogue: DataFrame, disk: DataFrame) -> DataFrame:
    """(path, hash, old_path, status) of every path on disk and every catalogued one that is gone.

    status: unchanged (same size and time, so the hash isn't looked at), hashed (changed in place), moved (new path,
    and a catalogued path that vanished had the content), added, or removed.  Of several vanished copies each moved
    file takes one, in path order.
    """
    was = catalogue.select("path", F.col("hash").alias("old_hash"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"))
    both = disk.select("path", "hash", "size", "mtime").join(was, "path", "full")
    rank = lambda key: F.row_number().over(Window.partitionBy(key).orderBy("path"))
    gone = both.where("hash IS NULL").select(F.col("old_hash").alias("hash"), F.col("path").alias("old_path"), rank("old_hash").alias("n"))
    fresh = both.where("old_hash IS NULL").select("path", "hash", rank("hash").alias("n"))
    arrived = fresh.join(gone, ["hash", "n"], "left").select(
        "path", "hash", "old_path", F.when(F.col("old_path").isNotNull(), "moved").otherwise("added").alias("status")
    )
    removed = gone.join(fresh, ["hash", "n"], "left_anti").select(
        F.col("old_path").alias("path"), "hash", F.lit(None).cast("string").alias("old_path"), F.lit("removed").alias("status")
    )
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    stayed = both.where("hash IS NOT NULL AND old_hash IS NOT NULL").select(
        "path",
        F.when(same, F.col("old_hash")).otherwise(F.col("hash")).alias("hash"),
        F.lit(None).cast("string").alias("old_path"),
        F.when(same, "unchanged").otherwise("hashed").alias("status"),
    )
    return stayed.unionByName(arrived).unionByName(removed)


def stats(changes: DataFrame) -> DataFrame:
    """(status, files)."""
    return changes.groupBy("status").agg(F.count("*").alias("files"))


def apply_scan(catalogue: DataFrame, disk: DataFrame) -> DataFrame:
    """The catalogue after a scan; derived tables are keyed by hash and so follow moved files by themselves."""
    changes = reconcile(catalogue, disk)
    live = changes.where("status <> 'removed'").select("path", F.col("hash").alias("now"))
    return disk.join(live, "path").withColumn("hash", F.col("now")).drop("now")


class Versions:
    """A table as numbered Parquet versions under a folder; a reader keeps the version it opened.

    A version counts once its pointer file is renamed into place, so a writer that dies leaves the last one valid.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int | None:
        if not self._fs.exists(self._path(self.root)):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=None)

    def read(self, version: int | None = None) -> DataFrame | None:
        version = self.current() if version is None else version
        return None if version is None else self.spark.read.parquet(f"{self.root}/v{version}")

    def write(self, df: DataFrame) -> int:
        version = (self.current() or 0) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/v{version}")
        pointer = self._path(f"{self.root}/v{version}.json.part")
        out = self._fs.create(pointer, True)
        out.write(bytearray(json.dumps({"version": version, "written": time.time()}), "utf-8"))
        out.close()
        if not self._fs.rename(pointer, self._path(f"{self.root}/v{version}.json")):
            raise RuntimeError(f"version {version} of {self.root} was written by somebody else")
        return version

    def discard(self, version: int) -> None:
        """Takes a version back; the one before it is current again.  Its pointer goes first."""
        self._fs.delete(self._path(f"{self.root}/v{version}.json"), False)
        self._fs.delete(self._path(f"{self.root}/v{version}"), True)


def identities(folders: DataFrame) -> DataFrame:
    """(folder, id, why) of library folders (folder, marker, home, writable): which cache each one uses.

    marker is the id that a folder carries, home the folder where that id was last seen.  own: the marker is the folder's,
    or its home is no longer among the folders (it was moved).  copy: its home is still there and carries the same id, so
    this one needs a new id.  new: no marker.  Ids that have to be made are derived from the path: path where the folder
    can't be written to, and the marker therefore not kept.
    """
    there = folders.select(F.col("folder").alias("home"), F.col("marker").alias("home_marker"))
    out = folders.join(there, "home", "left")
    made = F.substring(F.sha2("folder", 256), 1, 32)
    copied = (F.col("home") != F.col("folder")) & (F.col("home_marker") == F.col("marker"))
    own = F.col("marker").isNotNull() & ~F.coalesce(copied, F.lit(False))
    why = F.when(own, "own").when(~F.col("writable"), "path").when(F.col("marker").isNotNull(), "copy").otherwise("new")
    return out.select("folder", F.when(own, F.col("marker")).otherwise(made).alias("id"), why.alias("why"))


def forgotten(caches: DataFrame, folders: DataFrame) -> DataFrame:
    """The caches (id, folder, …) whose folder is gone, to be removed."""
    return caches.join(folders.select("folder"), "folder", "left_anti")


def extract(files: DataFrame, work: Callable[[DataFrame], DataFrame], done: str, failed: str, version: str, parts: int = 16, stop: Callable[[], bool] = lambda: False) -> int:
    """Works on the files (hash, …) that have no result yet, part by part, and keeps what each part gave; parts finished.

    work maps files to rows (hash, ok boolean, …).  Those that are ok are appended to the table at done, the others'
    hashes to the one at failed with the version that failed on them: this version won't try them again.  A run that is
    stopped, or dies, goes on where it was; a part whose results were partly kept is worked on without them.
    """
    spark = files.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path

    def kept(root: str, schema: str) -> DataFrame:
        there = path(root).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(root))
        return spark.read.schema(schema).parquet(root) if there else spark.createDataFrame([], schema)

    kind = files.schema["hash"].dataType.simpleString()
    finished = 0
    for part in range(parts):
        if stop():
            break
        todo = files.where(F.pmod(F.xxhash64("hash"), F.lit(parts)) == part)
        todo = missing(todo, kept(done, f"hash {kind}"), kept(failed, f"hash {kind}, version string"), version)
        found = written(work(todo.dropDuplicates(["hash"])))
        found.where("ok").drop("ok").write.mode("append").parquet(done)
        found.where("NOT ok").select("hash", F.lit(version).alias("version")).write.mode("append").parquet(failed)
        finished += 1
    return finished
