"""Filesystem events: filtered, gathered into bursts, and merged into the catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A burst ends after so much quiet.
QUIET = "700 milliseconds"
MARKER, CACHE = ".library", ".cache"


def interesting(kind: Column, path: Column, marker: str = MARKER, caches: tuple[str, ...] = (CACHE,)) -> Column:
    """Whether an event is worth a rescan: not an access, not the marker, not below a cache folder."""
    parts = F.split(path, "/")
    cached = F.arrays_overlap(parts, F.array(*map(F.lit, caches)))
    return (F.lower(kind) != "access") & (path != marker) & ~cached


def watch(spark: SparkSession, root: str, per_batch: int = 10_000) -> DataFrame:
    """A stream (kind, path, event_time) of the files that appear below root; none is opened."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
    found = read.option("maxFilesPerTrigger", per_batch).load(root)
    return found.select(F.lit("create").alias("kind"), F.col("path"), F.col("modificationTime").alias("event_time"))


def bursts(events: DataFrame, quiet: str = QUIET, keys: list[str] = (), watermark: str | None = None) -> DataFrame:
    """(keys, start, end, events): one row per burst, an end being quiet after the last event.

    On a stream give a watermark; batches need none.  An event exactly quiet after the last one still belongs to it.
    """
    if events.isStreaming:
        events = events.withWatermark("event_time", watermark or quiet)
    found = events.groupBy(*keys, F.session_window("event_time", quiet).alias("w")).agg(F.count("*").alias("events"))
    return found.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windows(events: DataFrame, size: str, slide: str | None = None, keys: list[str] = (), watermark: str | None = None) -> DataFrame:
    """(keys, start, events) by tumbling or sliding windows."""
    if events.isStreaming and watermark:
        events = events.withWatermark("event_time", watermark)
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    found = events.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("events"))
    return found.select(*keys, F.col("w.start").alias("start"), "events")


def on_changes(stream: DataFrame, rescan: Callable[[DataFrame], int], checkpoint: str, emit: Callable[[int], None]):
    """A query that rescans once per batch of changed paths and emits the number of changes if there are any."""

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.where(interesting(F.col("kind"), F.col("path"))).select("path").distinct()
        if not paths.isEmpty() and (n := rescan(paths)):
            emit(n)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(total: int, report: Callable[[int, int], None], steps: int = 100) -> Callable[[int], None]:
    """A counter that reports at most about steps times, never backwards, and always the end."""
    state = {"done": 0, "said": -1}

    def tick(n: int = 1) -> None:
        state["done"] = min(total, state["done"] + n)
        at = state["done"] * steps // max(1, total)
        if at > state["said"] or state["done"] == total > state.get("last", -1):
            state["said"], state["last"] = at, state["done"]
            report(state["done"], total)

    return tick
