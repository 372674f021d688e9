"""Token ids in ORC files.

One row per document, in ascending doc_id order through all files: doc_id, the file's number (part), the ids
before the document within that file (local_start), n_tokens and the ids.  ORC run-length encodes the integer
columns, keeps a row index and statistics every STRIDE rows, and a Bloom filter on doc_id, so a reader takes
single stripes in parallel and skips those whose metadata exclude a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BATCH_ROWS, scratch_path, small_batches, tidied

#: The vocabulary file and the id that ends a document.
VOCABULARY, END = "byte_bpe_50k.json", 0
STRIDE, STRIPE_BYTES = 1000, 16 << 20
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """Rows of SCHEMA for docs (doc_id, text), in ascending order of doc_id through the partitions.

    Null doc_ids come first; equal ids are ordered by the text's hash.  A null text has the end id alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .tokenizer import encoder

        encode, part, before = encoder(vocabulary).encode, TaskContext.get().partitionId(), 0
        for batch in batches:
            for first in range(0, batch.num_rows, BATCH_ROWS):
                piece = batch.slice(first, BATCH_ROWS)
                ids, at = encode(piece.column(1))
                values = np.insert(ids, at[1:], end)
                ends = at + np.arange(len(at))
                n = np.diff(ends)
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                parts = pa.array(np.full(len(n), part, np.int32))
                columns = [piece.column(0), parts, pa.array(before + ends[:-1]), pa.array(n), rows]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return small_batches(ordered).mapInArrow(tidied(run, encodes=True), SCHEMA)


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """docs' token ids as ORC files at path."""
    out = encoded(docs, vocabulary, end).write.option("compression", "zstd")
    out = out.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    out = out.option("orc.create.index", "true").option("orc.row.index.stride", STRIDE)
    out.option("orc.stripe.size", STRIPE_BYTES).orc(path)


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids, from the files at path.

    A file's first id is counted from the files before it: one sum per file, a table as long as the list of files.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    totals = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    bases, base = [], 0
    for part, n in totals:
        bases.append((part, base))
        base += n
    table = F.broadcast(spark.createDataFrame(bases, "part int, base long"))
    start = (F.col("base") + F.col("local_start")).alias("start")
    return rows.join(table, "part").select("doc_id", start, "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of rows from read_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            at = ids.offsets.to_pylist()
            crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at, at[1:])]
            columns = [*batch.columns[:3], pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return small_batches(tokens).mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame) -> DataFrame:
    """docs encoded, written to the shared folder, and what the files hold per document.

    Rows with a null doc_id, repeated ids and empty texts are all written; an empty table gives no rows.
    Columns other than doc_id and text are not read.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return digests(read_tokens(docs.sparkSession, path))


def query(spark, sf_dir: str) -> DataFrame:
    """op9: every document's place, length and checksum in the token files."""
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
