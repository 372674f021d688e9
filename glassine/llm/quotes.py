"""Quotation linking: replies find the messages they quote, and conversations are ordered by reply, without quotes.

Lines that begin with `>` marks are quoted, one level per mark.  Every quoted passage, a run of lines of one level, is
normalised to its letters and digits and hashed, whole, by paragraph and by line; so are messages' own words.
Equal hashes within a conversation link a quotation to the first message that said it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, small_batches

#: Paragraphs and lines of fewer letters and digits link nothing, unless they are the whole passage or message.
LEAST = 12
_MARKS = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)(.*)", re.S)
#: How mail programs introduce a quotation.
_SAID = re.compile(r".{1,300}\b(wrote|writes|said|schrieb|escribió|a écrit)\s*:\s*", re.I | re.S)
_JUNK = re.compile(r"[\W_]+")


def split_quotes(text: str | None) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, without quotes and the lines that introduce them, and its quoted passages by level."""
    own: list[str] = []
    runs: list[tuple[int, list[str]]] = []
    quoting = False
    for line in (text or "").split("\n"):
        m = _MARKS.fullmatch(line)
        if m:
            level = m[1].count(">")
            if not quoting and own and _SAID.fullmatch(own[-1]):
                own.pop()
            if quoting and runs[-1][0] == level:
                runs[-1][1].append(m[2])
            else:
                runs.append((level, [m[2]]))
        else:
            own.append(line)
        quoting = bool(m)
    return "\n".join(own).strip(), [(level, "\n".join(lines)) for level, lines in runs]


def passages(text: str) -> dict[int, int]:
    """Hashes of a text's normalised whole, paragraphs and lines, with their lengths."""
    out = {}
    for i, part in enumerate((text, *re.split(r"\n\s*\n", text), *text.split("\n"))):
        plain = _JUNK.sub("", part).lower()
        if len(plain) >= (LEAST if i else 1):
            out[xxhash.xxh64_intdigest(plain.encode("utf-8", "surrogatepass")) - (1 << 63)] = len(plain)
    return out


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) as rows of their own number, with their own text and their hashes."""
    hashes = "array<struct<h: long, n: int>>"
    schema = f"row long, conv string, conv_id long, turn long, role string, text string, own {hashes}, quoted array<struct<level: int, h: long, n: int>>"
    pair = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))
    triple = pa.list_(pa.struct([("level", pa.int32()), ("h", pa.int64()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, owns, quotes = [], [], []
            for text in batch.column(5).to_pylist():
                own, quoted = split_quotes(text)
                texts.append(own)
                owns.append([{"h": h, "n": n} for h, n in passages(own).items()])
                found = {(level, h): n for level, passage in quoted for h, n in passages(passage).items()}
                quotes.append([{"level": level, "h": h, "n": n} for (level, h), n in found.items()])
            columns = [*batch.columns[:5], pa.array(texts, pa.string()), pa.array(owns, pair), pa.array(quotes, triple)]
            yield pa.RecordBatch.from_arrays(columns, ["row", "conv", "conv_id", "turn", "role", "text", "own", "quoted"])

    slim = messages.select(
        F.monotonically_increasing_id().alias("row"),
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"),
        F.col("conv_id").try_cast("long").alias("conv_id"),
        F.col("turn").try_cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    return small_batches(slim).mapInArrow(run, schema)


def quotations(found: DataFrame) -> DataFrame:
    """(row, level, of, of_turn, n): the message that each level of a row's quotes comes from.

    The origin of a passage is the first message of the conversation that has it as its own words, before the quoting
    turn.  Of several origins of one level that with most quoted characters counts, then the latest.
    """
    own = found.select("conv", "turn", "row", F.explode("own").alias("e")).where("turn IS NOT NULL")
    first = own.groupBy("conv", F.col("e.h").alias("h")).agg(F.min(F.struct("turn", "row")).alias("o"))
    first = durable(first.select("conv", "h", F.col("o.turn").alias("of_turn"), F.col("o.row").alias("of")), "origins")
    quoted = found.select("conv", "turn", "row", F.explode("quoted").alias("e")).select("conv", "turn", "row", "e.*")
    met = quoted.join(first, ["conv", "h"]).where("of_turn < turn")
    per = met.groupBy("row", "level", "of", "of_turn").agg(F.sum("n").alias("n"))
    best = F.max(F.struct("n", "of_turn", "of")).alias("b")
    return per.groupBy("row", "level").agg(best).select("row", "level", "b.of", "b.of_turn", "b.n")


def roots(parents: DataFrame) -> DataFrame:
    """(row, root, depth) for parents (row, parent), by pointer doubling: each round halves what is left of a chain."""
    up = durable(parents.select("row", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "up")
    while True:
        above = up.select(F.col("row").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        joined = up.join(above, "root", "left").select(
            "row",
            F.coalesce("next", "root").alias("root"),
            (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            F.col("next").isNotNull().alias("moved"),
        )
        joined = durable(joined, "up")
        up = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return up


def conversations(messages: DataFrame) -> DataFrame:
    """One row per message: conv_id, position, turn, role, text without quotes, reply_to, depth, thread and quotes.

    reply_to is the turn of the message that the lowest level of quotes comes from (null: none); thread is the turn of
    the message its chain of replies starts from, depth the length of that chain.  Messages are ordered by thread,
    then turn, so a reply stands after what it replies to; position counts them from 0 in each conversation.  quotes
    lists the origin of each level as (level, turn).

    Null conv_ids are one conversation.  A message without a turn quotes nothing, is never an origin and comes first.
    An id or turn that is no number is null in the result; conversations are told apart by the id as text.  Repeated rows
    stay; a null text is empty; texts are read whole, however long; an empty table gives an empty result.  Other columns
    are not read.
    """
    found = durable(parsed(messages), "messages")
    origins = durable(quotations(found), "quotations")
    parents = origins.groupBy("row").agg(
        F.min_by(F.struct(F.col("of").alias("parent"), F.col("of_turn").alias("reply_to")), "level").alias("p"),
        F.array_sort(F.collect_list(F.struct("level", F.col("of_turn").alias("turn")))).alias("quotes"),
    )
    parents = durable(parents.select("row", "p.*", "quotes"), "parents")
    chains = roots(parents)
    starts = found.select(F.col("row").alias("root"), F.col("turn").alias("thread"))
    chains = durable(chains.join(starts, "root").select("row", "thread", "depth"), "chains")
    linked = (
        found.drop("own", "quoted")
        .join(parents.drop("parent"), "row", "left")
        .join(chains, "row", "left")
        .withColumn("thread", F.coalesce("thread", "turn"))
        .withColumn("depth", F.coalesce("depth", F.lit(0)))
    )
    # A global order in partitions: each row's number is its partition's first one plus its place.
    order = ["conv", "thread", "turn", "row"]
    sorted_ = linked.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = durable(sorted_.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33).alias("part")
    counts = sorted(placed.groupBy(part).count().collect())
    bases, base = [], 0
    for p, n in counts:
        bases.append((p, base))
        base += n
    table = F.broadcast(messages.sparkSession.createDataFrame(bases, "part long, base long"))
    numbered = placed.withColumn("part", part).join(table, "part")
    numbered = numbered.withColumn("at", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    firsts = durable(numbered.groupBy("conv").agg(F.min("at").alias("start")), "starts")
    empty = F.array().cast("array<struct<level: int, turn: long>>")
    return numbered.join(firsts, "conv").select(
        "conv_id",
        (F.col("at") - F.col("start")).alias("position"),
        "turn",
        "role",
        "text",
        "reply_to",
        F.col("depth").cast("long").alias("depth"),
        "thread",
        F.coalesce("quotes", empty).alias("quotes"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every message in reply order, without quotes."""
    return conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
