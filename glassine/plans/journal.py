"""The journal of applied plans, and applying them to the catalogue."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import numbered
from .build import relocate, undo, violations
from .catalog import Versions, repath


def entry_id(label: str, at: datetime.datetime) -> str:
    """'20260819120000-move-to-Trip'."""
    text = re.sub(r"[^A-Za-z0-9_-]", "-", label).strip("-") or "op"
    return f"{at:%Y%m%d%H%M%S}-{text}"


def record(ops: DataFrame, label: str, at: datetime.datetime) -> DataFrame:
    """ops as rows of the journal."""
    return numbered(ops, "seq", "from").select(
        F.lit(entry_id(label, at)).alias("id"), F.lit(label).alias("label"), F.lit(at).cast("timestamp").alias("applied_at"),
        F.col("seq").cast("int").alias("seq"), "kind", "hash", "from", "to",
    )


def history(journal: DataFrame) -> DataFrame:
    """(id, label, applied_at, ops), newest first."""
    return journal.groupBy("id", "label", "applied_at").agg(F.count("*").alias("ops")).orderBy(F.desc("id"))


_ENTRY = "id string, label string, applied_at timestamp, seq int, kind string, hash string, `from` string, `to` string"


class Journal:
    """Entries as JSON files, a folder each, below root; an entry counts once its writer has finished."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, ops: DataFrame, label: str, at: datetime.datetime) -> str:
        """Records ops, and returns the entry's id; an id that is there already gets a number."""
        id = base = entry_id(label, at)
        n = 2
        while self._fs.exists(self._path(f"{self.root}/{id}")):
            id, n = f"{base}-{n}", n + 1
        record(ops, label, at).withColumn("id", F.lit(id)).write.json(f"{self.root}/{id}")
        return id

    def list(self) -> list[str]:
        """The ids of finished entries, in order."""
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def load(self, id: str | None = None) -> DataFrame:
        """An entry's ops, or those of all."""
        ids = self.list() if id is None else [id]
        if not ids:
            return self.spark.createDataFrame([], _ENTRY)
        return self.spark.read.schema(_ENTRY).json([f"{self.root}/{i}" for i in ids])

    def discard(self, id: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{id}"), True)


def commit(files: Versions, meta: Versions, journal: Journal, ops: DataFrame, label: str, directories: DataFrame, at: datetime.datetime) -> str:
    """Applies a plan to the versioned catalogue and user metadata and records it; the entry's id.

    First the catalogue, then the journal, then the metadata: whatever fails, what was done before is taken back, so that
    no change stands that can't be undone.  Files themselves are not moved.
    """
    moved, followed = apply(files.read(), meta.read(), ops, directories)
    done = [(files.discard, files.write(moved))]
    try:
        id = journal.write(ops, label, at)
        done.append((journal.discard, id))
        meta.write(followed)
    except Exception:
        for take_back, what in reversed(done):
            take_back(what)
        raise
    return id


def apply(files: DataFrame, meta: DataFrame, ops: DataFrame, directories: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The catalogue and user metadata after a plan; an error, and no change, if a rule is broken."""
    broken = violations(ops, files, directories).first()
    if broken:
        raise ValueError(f"{broken[0]}: {broken[1]}")
    return repath(files, ops), relocate(meta, ops)


def undo_entry(files: DataFrame, journal: DataFrame, id: str | None = None) -> DataFrame:
    """The inverse ops of an entry (by default the newest); an error if a file is no longer where it was put."""
    if id is None:
        newest = journal.agg(F.max("id")).first()
        id = newest[0] if newest else None
    entry = journal.where(F.col("id") == id)
    gone = entry.join(files.select(F.col("path").alias("to")), "to", "left_anti").select("to").first()
    if gone:
        raise ValueError(f"{gone[0]} is gone")
    return undo(entry)
