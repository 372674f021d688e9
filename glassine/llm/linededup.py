"""Line dedup through deletion neighbourhoods, in DataFrame operations only.

A line is dropped if an earlier line of the corpus (by document, then line) equals it or is within one edit: one
character inserted, deleted or replaced.  Two lines are within one edit exactly if deleting the character at one and
the same place makes them equal (a replacement), or if deleting one character of the longer gives the shorter.  So
each line emits every variant with one character deleted, as hashed keys, and equal variants meet.

A line has as many variants as characters, and most lines have no neighbour at all.  A single edit leaves the first or
the last half of a line as it was, so lines first meet on their halves' hashes; only lines that share a half with a
different line emit variants, and only of the half that may differ.

Nothing is grouped without a bound: equal lines are collapsed before any variant is made, and the lines that agree but
for the character at one place are no more than there are characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, guarded_broadcast

#: Shorter lines must be equal to be dropped: one edit makes another word of a word.
LEAST_CHARS = 20


def split_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, text, h): every line of docs (doc_id, text) without outer spaces, written as a table."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"),
    )
    lines = rows.select("row", "doc_id", F.posexplode("lines").alias("line", "raw"))
    return durable(lines.select("row", "doc_id", "line", F.trim("raw").alias("text")).withColumn("h", F.xxhash64("text")), "lines")


def _order() -> Column:
    """Sorts lines: by doc_id, nulls last, then the row, then the line."""
    return F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row", "line")


def _halves() -> Column:
    """The keys on which a line meets lines that share its first or last half: (key, side, half)."""
    n = F.length("text")
    keys = []
    for half in (F.floor(n / 2), F.floor((n - 1) / 2)):
        half = half.cast("int")
        keys.append(F.struct(F.xxhash64(F.lit(1), half, F.substring("text", F.lit(1), half)).alias("key"), F.lit(1).alias("side"), half.alias("half")))
        keys.append(F.struct(F.xxhash64(F.lit(2), half, F.substring("text", n - half + 1, half)).alias("key"), F.lit(2).alias("side"), half.alias("half")))
    return F.array_distinct(F.array(*keys))


def near_lines(lines: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(h, by): hash of each line with an earlier line within one edit, and that line's hash."""
    spark = lines.sparkSession
    long_enough = lines.where(F.length("text") >= least_chars)
    keyed = long_enough.select("h", F.explode(_halves()).alias("k")).select("h", "k.key", "k.side", "k.half")
    shared = keyed.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("key")
    shared = durable(shared, "halves")
    meeting = durable(keyed.join(guarded_broadcast(shared), "key").distinct(), "meeting")
    wanted = durable(meeting.select("h").distinct(), "wanted")
    found = long_enough.join(guarded_broadcast(wanted), "h").groupBy("h").agg(F.first("text").alias("text"), F.min(_order()).alias("o"))
    # Numbers that grow with the order of the lines.
    found = found.repartitionByRange("o", "h").sortWithinPartitions("o", "h")
    found = durable(found.select("h", "text").withColumn("id", F.monotonically_increasing_id()), "candidates")

    rest = F.when(F.col("side") == 1, F.expr("substring(text, half + 1)")).otherwise(F.expr("substring(text, 1, length(text) - half)"))
    halves = meeting.join(guarded_broadcast(found.select("h", "id", "text")), "h").select("id", "key", rest.alias("rest"))
    halves = durable(halves, "rests")
    whole = durable(halves.select(F.xxhash64("key", "rest").alias("v"), F.col("id").alias("whole")), "wholes")
    places = F.explode(F.sequence(F.lit(1), F.length("rest"))).alias("i")
    cut = F.expr("concat(substring(rest, 1, i - 1), substring(rest, i + 1))")
    variants = halves.where("rest <> ''").select("id", "key", "rest", places).select("id", "i", F.xxhash64("key", cut).alias("v"))

    # One character less.
    shorter = variants.join(guarded_broadcast(whole), "v").select(
        F.greatest("id", "whole").alias("id"), F.least("id", "whole").alias("by")
    )
    # Another character at one place.
    groups = variants.groupBy("v", "i").agg(F.min("id").alias("by"), F.max("id").alias("last"), F.count("*").alias("n"))
    groups = durable(groups.where("by <> last"), "groups")
    replaced = groups.select(F.col("last").alias("id"), "by")
    larger = groups.where("n > 2")
    if not larger.isEmpty():
        more = variants.join(guarded_broadcast(larger.select("v", "i", "by")), ["v", "i"]).select("id", "by")
        replaced = replaced.union(more)
    pairs = durable(shorter.union(replaced).where("id <> by").distinct(), "pairs")
    one = found.select("id", "h", "text")
    two = found.select(F.col("id").alias("by"), F.col("h").alias("by_h"), F.col("text").alias("by_text"))
    texts = pairs.join(one, "id").join(two, "by")
    within = F.levenshtein("text", "by_text", 1).between(0, 1)
    return texts.where(within).groupBy("h").agg(F.min_by("by_h", "by").alias("by"))


def line_decisions(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(row, doc_id, line, h, drop): for every line whether it is dropped as a `copy`, as `near`, or kept (null).

    Empty lines, and so null and empty texts, are kept.  Rows are documents of their own even where ids repeat; rows
    without an id come after the others.  Texts are read whole, however long, and lines compared whole.  An empty table
    gives an empty result.  Columns other than doc_id and text are not read.
    """
    lines = split_lines(docs)
    full = lines.where("text <> ''")
    copies = full.groupBy("h").agg(F.min(_order()).alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = durable(copies.select("h", "first"), "copies")
    near = durable(near_lines(full, least_chars).withColumn("near", F.lit(True)).select("h", "near"), "near")
    labelled = lines.drop("text").join(guarded_broadcast(copies), "h", "left").join(guarded_broadcast(near), "h", "left")
    drop = F.when(F.col("near"), "near").when(_order() > F.col("first"), "copy")
    return labelled.select("row", "doc_id", "line", "h", drop.alias("drop"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """docs' rows as doc_id, text without the dropped lines; a text of which nothing is left, or a null one, is empty.

    Repeated rows stay, the later ones without the lines that the first has; an empty table gives an empty result; other
    columns are not read.
    """
    lines = split_lines(docs)
    kept = line_decisions(docs, least_chars).where("drop IS NULL").select("row", "line")
    per = lines.join(kept, ["row", "line"], "left_semi").groupBy("row", "doc_id")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n")
    back = lines.select("row", "doc_id").distinct().join(per.agg(joined.alias("text")).drop("doc_id"), "row", "left")
    return back.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    """op4: how many lines of each document are copies or nearly, and which they are."""
    found = line_decisions(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.when(F.col("drop").isNotNull(), F.col("line"))
    return (
        found.groupBy("row", "doc_id")
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(F.col("drop") == "copy").alias("n_copies"),
            F.count_if(F.col("drop") == "near").alias("n_near"),
            F.array_join(F.array_sort(F.collect_list(gone)).cast("array<string>"), ",").alias("dropped"),
        )
        .drop("row")
    )


SQL = r"""
WITH l AS (
  SELECT doc_id, line, trim(raw, ' ') AS t FROM (
    SELECT doc_id, unnest(range(len(p))) AS line, unnest(p) AS raw
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents))
), u AS (SELECT t, min((doc_id, line)) AS o, row_number() OVER (ORDER BY min((doc_id, line))) AS id FROM l WHERE t <> '' GROUP BY t),
c AS (SELECT id, t, unnest(range(1, length(t) + 1)) AS i FROM u WHERE length(t) >= 20),
v AS (SELECT id, i, md5(left(t, i - 1) || substr(t, i + 1)) AS m FROM c),
near AS (
  SELECT id FROM (SELECT id, min(id) OVER (PARTITION BY m, i) AS a FROM v) WHERE a < id
  UNION
  SELECT greatest(v.id, w.id) FROM v JOIN (SELECT id, md5(t) AS m FROM u WHERE length(t) >= 20) w USING (m)
), d AS (
  SELECT l.doc_id, l.line, CASE WHEN near.id IS NOT NULL THEN 'near' WHEN (l.doc_id, l.line) > u.o THEN 'copy' END AS drop
  FROM l LEFT JOIN u ON l.t = u.t LEFT JOIN near ON near.id = u.id
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (drop = 'copy') AS n_copies, count(*) FILTER (drop = 'near') AS n_near,
       coalesce(string_agg(line::VARCHAR, ',' ORDER BY line) FILTER (drop IS NOT NULL), '') AS dropped
FROM d GROUP BY doc_id
"""
