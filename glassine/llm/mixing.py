"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents, in a fixed shuffled order, are cut into blocks of BLOCK characters.  Block k of a source with
weight w is released at slot floor(k / w) and due at slot ceil((k + 1) / w); in every slot the released block that is
due first is taken.  At any slot each source has then had its weight's share of the slots to less than one block.

For the order, weights are rounded to fractions of PERIOD, so the schedule repeats after PERIOD slots.  One period is
laid out on the driver: its size depends on the parameter and the list of sources, never on the documents.  How much of
each source is in the mixture follows the weights themselves, unrounded.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, guarded_broadcast

#: Characters of a block; slots of a period; the largest share of one source by default.
BLOCK, PERIOD, MOST = 16_384, 10_000, 0.25
#: Rows of a chunk, the unit of running sums, and how many chunks there are at most.
CHUNK_ROWS, CHUNKS = 256, 10_000
#: Stands for a null source.
NO_SOURCE = "\x00"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """weights as whole slots of a period: by largest remainder, at least one each."""
    weights = {s: w for s, w in sorted(weights.items()) if w > 0}
    total = math.fsum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + int(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    return out


def schedule(slots: dict[str, int], period: int) -> list[tuple[str, int, int]]:
    """(source, block, slot) of one period: of the released blocks, the one due first goes first."""
    waiting = [(0, -(-period // n), s, 0) for s, n in slots.items()]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, due, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, k))
        if not ready:
            continue
        _, s, k = heapq.heappop(ready)
        out.append((s, k, t))
        n = slots[s]
        if k + 1 < n:
            heapq.heappush(waiting, ((k + 1) * period // n, -(-(k + 2) * period // n), s, k + 1))
    return out


def capped(sizes: dict[str, int], most: float = MOST) -> dict[str, float]:
    """Weights in proportion to sizes with no source above most (or an equal share, if that is more)."""
    most = max(most, 1 / max(1, len(sizes)))
    out, over = {}, set()
    while True:
        rest = sum(n for s, n in sizes.items() if s not in over)
        room = 1 - most * len(over)
        out = {s: most if s in over else n / rest * room for s, n in sizes.items()} if rest else {s: most for s in sizes}
        more = {s for s, w in out.items() if s not in over and w > most + 1e-12}
        if not more:
            return out
        over |= more


def mix(
    docs: DataFrame, size: Column, weights: dict[str, float] | None = None, block: int = BLOCK, period: int | None = None
) -> DataFrame:
    """(doc, block, release, deadline, slot, selected) for each row of docs (doc_id, source), doc being the row.

    size is a document's characters.  weights maps sources to target weights; by default they are the sources' sizes,
    capped.  selected holds for the blocks that each source gives, by its weight, until the first source runs out.
    Weights count exactly; only slots, releases and deadlines follow them as rounded to PERIOD, so a source too small for
    its slot is used up early and the others go on.  With a period, the rounded weights are what selected follows, too.
    Sources without a positive weight get no slot and aren't selected.

    A null source is a source of its own; a null or empty text counts one character, as every document does on top of
    its own; documents longer than a block take up the slots they cover.  Repeated rows are rows of their own.  An empty table
    gives an empty result; columns of any name and type are carried in doc.
    """
    spark = docs.sparkSession
    chunks = max(1, min(CHUNKS, math.ceil(docs.count() / CHUNK_ROWS)))
    keyed = docs.select(
        F.struct("*").alias("doc"),
        F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"),
        (F.coalesce(size, F.lit(0)).cast("long") + 1).alias("size"),
        F.xxhash64("doc_id", size, "source").alias("lot"),
        F.col("doc_id").alias("id"),
    ).withColumn("chunk", F.pmod(F.xxhash64("lot"), F.lit(chunks)).cast("int"))
    order = Window.partitionBy("source", "chunk").orderBy("lot", "id")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = durable(keyed.withColumn("before", before), "placed")
    totals = durable(placed.groupBy("source", "chunk").agg(F.sum("size").alias("n")), "totals")
    by_source = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "chunk", F.coalesce(F.sum("n").over(by_source), F.lit(0)).alias("base"))
    sizes = {r[0]: r[1] for r in totals.groupBy("source").agg(F.sum("n")).collect()}
    if weights is None:
        weights = capped(sizes)
    weights = {s: weights.get(s, 0) for s in sizes}
    rounded, period = period is not None, max(period or PERIOD, 4 * len(sizes))
    slots = shares(weights, period) if any(w > 0 for w in weights.values()) else {}
    whole = sum(Fraction(weights[s]) for s in slots)
    exact = {s: Fraction(n, period) if rounded else Fraction(weights[s]) / whole for s, n in slots.items()}
    horizon = min((-(-sizes[s] // block) / w for s, w in exact.items()), default=0)
    horizon = math.ceil(horizon) if rounded else horizon
    # A source gives at most the blocks it has.
    given = {s: min(-(-sizes[s] // block), math.ceil(horizon * w)) for s, w in exact.items()}
    # Both tables are as long as the period and the list of sources.
    laid = spark.createDataFrame(schedule(slots, period), "source string, i long, t long")
    counts = spark.createDataFrame([(s, n, given[s]) for s, n in slots.items()], "source string, n long, given long")
    numbered = placed.join(guarded_broadcast(durable(bases, "bases")), ["source", "chunk"])
    numbered = numbered.withColumn("block", F.expr(f"(base + before) div {block}"))
    numbered = numbered.join(F.broadcast(counts), "source", "left").withColumn("i", F.expr("block % n"))
    release = F.expr(f"(block * {period}L) div n")
    return numbered.join(F.broadcast(laid), ["source", "i"], "left").select(
        "doc",
        "block",
        release.alias("release"),
        F.expr(f"((block + 1) * {period}L + n - 1) div n").alias("deadline"),
        F.expr(f"(block div n) * {period}L + t").alias("slot"),
        F.coalesce(F.col("block") < F.col("given"), F.lit(False)).alias("selected"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's block, window and slot in the mixture."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", F.length("text").alias("n"))
    return mix(docs, F.col("n")).select("doc.doc_id", "doc.source", "block", "release", "deadline", "slot", "selected")
