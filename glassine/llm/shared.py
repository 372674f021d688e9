"""What the corpus operators share: scratch tables, guarded broadcasts, connected components."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of at most this many rows and bytes may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20
#: Rows of an Arrow batch, and thin rows (a few numbers) that one task can write.
BATCH_ROWS, TASK_ROWS = 1000, 250_000


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, from spark.checkpoint.dir.

    Where that is unset: a temporary folder in local mode, else the warehouse.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = "file://" + tempfile.mkdtemp(prefix="glassine-")
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def thin(df: DataFrame, rows: int) -> DataFrame:
    """df of at most so many thin rows, in as many partitions as these need: small tables are written as few files."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def guarded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; beyond that the join shuffles.

    df should be a durable table, as it is counted and the bytes of its strings and arrays are summed.
    """
    wide = [f for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType))]
    text = [F.sum(F.octet_length(F.col(f"`{f.name}`").cast("string")).cast("long")) for f in wide]
    n, *bytes_ = df.agg(F.count("*"), *text).first()
    total = 8 * n * len(df.columns) + sum(x or 0 for x in bytes_)
    return F.broadcast(df) if n <= rows and total <= size else df


def small_batches(df: DataFrame) -> DataFrame:
    """df, from whose session on Arrow batches have at most BATCH_ROWS rows: a worker holds few texts at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def give_back() -> None:
    """Returns this process's freed memory to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], encodes: bool = False) -> Callable:
    """run for a worker that other stages have used: what token encoding keeps goes first, unless run encodes, and freed
    memory goes back to the machine, as Spark keeps workers."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sys.modules.get("glassine.llm.tokenizer")
        if tokens and not encodes and tokens.encoder.cache_info().currsize:
            tokens.encoder.cache_clear()
            give_back()
        yield from run(batches)
        give_back()

    return tidy


def ascii_lower(text: Column) -> Column:
    """text with A-Z lower-cased and every other character left alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), root being its component's smallest node.

    Alternates large-star and small-star steps, each written as a table, until nothing changes.
    Only minima are gathered by node, so a hub costs its task one row per neighbour; both sides of
    every join are plain tables, which lets adaptive execution split the hub's partition.
    """
    edges = durable(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(),
        "edges",
    )

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    seen = mark(edges)
    while seen[0]:
        # No step has more rows than both directions of all edges.
        n = 2 * seen[0]
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        lowest = durable(thin(lowest, n), "star")
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = durable(thin(large, n), "edges")
        lowest = durable(thin(large.groupBy("a").agg(F.min("b").alias("m")), n), "star")
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = durable(thin(small.union(lowest).distinct(), n), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
