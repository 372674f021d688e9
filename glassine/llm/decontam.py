"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

``build_index`` stores postings (row, pos, term_id) of the corpus for every term of the benchmark, written once to
the shared folder, document-partitioned: no posting is shuffled to be stored.  ``phrase_matches`` takes each window
of the benchmark, fetches the postings of its rarest terms, subtracts each term's offset so that lists of one
occurrence agree on where the item would begin, and intersects them from the rarest up.  What is left is verified
against all of the window's postings.  ``proximity_matches`` does the same and lets each term stray by some words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import ascii_lower, durable, guarded_broadcast

#: Words of a window, and how many of its rarest terms are intersected before it is verified.
WINDOW, RAREST = 10, 3
#: What lies between words: fixed by the definition of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text: runs of 0-9, a-z and all non-ASCII characters, after A-Z is lower-cased; none for null."""
    cut = F.split(ascii_lower(text.cast("string")), SEPARATORS)
    return F.coalesce(F.array_remove(cut, ""), F.array().cast("array<string>"))


@dataclass
class Index:
    """docs (row, doc_id, n_words), postings (row, pos, term_id), terms (term_id, term, df)."""

    docs: DataFrame
    postings: DataFrame
    terms: DataFrame


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, p, n, term): the words of each benchmark row; item numbers the rows."""
    numbered = durable(
        items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    return numbered.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("p", "term"))


def build_index(docs: DataFrame, vocabulary: DataFrame) -> Index:
    """The index of docs (doc_id, text) over vocabulary (term).

    Terms outside the vocabulary can't be asked for and are left out.  Every row of docs is a document of its own,
    repeated ids and all; a null text has no words.
    """
    terms = durable(vocabulary.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    # A word that can't occur ends each document and carries its length.
    end = durable(terms.sparkSession.createDataFrame([("\x00", -1)], "term string, term_id long"), "end")
    ended = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id"),
        F.concat(words_of(F.col("text")), F.array(F.lit("\x00"))).alias("words"),
    )
    tokens = ended.select("row", "doc_id", F.posexplode("words").alias("pos", "term"))
    kept = tokens.join(guarded_broadcast(durable(terms.union(end), "terms")), "term").select("row", "doc_id", "pos", "term_id")
    stored = durable(kept, "postings")
    counted = durable(stored.where("term_id >= 0").groupBy("term_id").agg(F.count("*").alias("df")), "df")
    return Index(
        stored.where("term_id < 0").select("row", "doc_id", F.col("pos").alias("n_words")),
        stored.where("term_id >= 0").select("row", "pos", "term_id"),
        terms.join(counted, "term_id"),
    )


def _windows(words: DataFrame, index: Index, window: int) -> DataFrame:
    """(item, w, p, n, term_id, df): the words of every window; windows with a term the corpus lacks are gone."""
    known = words.join(guarded_broadcast(durable(index.terms, "terms")), "term").select("item", "p", "n", "term_id", "df")
    first = F.greatest(F.lit(0), F.col("p") - window + 1)
    last = F.greatest(F.lit(0), F.least(F.col("p"), F.col("n") - window))
    spread = known.withColumn("w", F.explode(F.sequence(first, last)))
    full = spread.withColumn("held", F.count("*").over(Window.partitionBy("item", "w")))
    return full.where(F.col("held") == F.least(F.col("n"), F.lit(window))).drop("held")


def _candidates(index: Index, words: DataFrame, window: int, rarest: int, slop: int) -> DataFrame:
    """(row, item, w, origin): where an item would begin for its window w to occur, by its rarest terms."""
    order = Window.partitionBy("item", "w").orderBy("df", "term_id", "p")
    ranked = _windows(words, index, window).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= rarest)
    anchors = durable(ranked.select("item", "w", "p", "term_id", "rank", "n"), "anchors")
    wanted = durable(anchors.select("term_id").distinct(), "wanted")
    lists = durable(index.postings.join(guarded_broadcast(wanted), "term_id"), "lists")
    first = guarded_broadcast(durable(anchors.where("rank = 1"), "rarest"))
    found = lists.join(first, "term_id").select("row", "item", "w", (F.col("pos") - F.col("p")).alias("origin"))
    for rank in range(2, rarest + 1):
        # What the rarer terms have left says where the next one must be: work follows the rarest list.
        side = guarded_broadcast(durable(anchors.where(F.col("rank") == rank).select("item", "w", "p", "term_id"), "next"))
        found = durable(found, "candidates")
        at = F.col("origin") + F.col("p")
        places = F.explode(F.sequence(at - slop, at + slop)) if slop else at
        probes = found.join(side, ["item", "w"]).select("row", "item", "w", "origin", "term_id", places.alias("pos"))
        hit = probes.join(lists, ["row", "pos", "term_id"], "left_semi").select("row", "item", "w", "origin")
        # Windows of fewer words than this rank have nothing more to intersect.
        few = anchors.where(F.least(F.col("n"), F.lit(window)) < rank).select("item", "w").distinct()
        if not few.isEmpty():
            hit = hit.unionByName(found.join(few, ["item", "w"], "left_semi"))
        found = hit
    return durable(found.distinct(), "candidates")


def _postings_of(index: Index, rows: DataFrame) -> DataFrame:
    """The index's postings of some rows."""
    return index.postings.join(guarded_broadcast(durable(rows.distinct(), "rows")), "row", "left_semi")


def phrase_matches(index: Index, words: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """(row, item, start, length): maximal runs of at least one whole window of an item found in a row."""
    candidates = _candidates(index, words, window, rarest, 0)
    ids = words.join(index.terms, "term").select("item", "p", "n", "term_id")
    offsets = F.explode(F.sequence(F.col("w"), F.col("w") + window - 1))
    expected = candidates.select("row", "item", "origin", offsets.alias("p")).distinct()
    expected = expected.join(guarded_broadcast(durable(ids, "ids")), ["item", "p"])
    expected = expected.select("row", "item", "origin", "p", "n", "term_id", (F.col("origin") + F.col("p")).alias("pos"))
    rows = candidates.select("row")
    hit = expected.join(_postings_of(index, rows), ["row", "pos", "term_id"], "left_semi")
    run = F.col("p") - F.row_number().over(Window.partitionBy("row", "item", "origin").orderBy("p"))
    runs = hit.withColumn("run", run).groupBy("row", "item", "origin", "run").agg(
        F.min("pos").alias("start"), F.count("*").alias("length"), F.first("n").alias("n")
    )
    long_enough = F.col("length") >= F.least(F.col("n"), F.lit(window))
    return runs.where(long_enough).select("row", "item", "start", "length")


def proximity_matches(
    index: Index, words: DataFrame, slop: int, window: int = WINDOW, rarest: int = RAREST
) -> DataFrame:
    """(row, item, w, start): windows all of whose words occur within slop words of their place."""
    candidates = _candidates(index, words, window, rarest, slop)
    terms = durable(_windows(words, index, window).select("item", "w", "p", "n", "term_id"), "windows")
    near = F.explode(F.sequence(F.col("origin") + F.col("p") - slop, F.col("origin") + F.col("p") + slop))
    expected = candidates.join(terms, ["item", "w"]).withColumn("pos", near)
    rows = candidates.select("row")
    hit = expected.join(_postings_of(index, rows), ["row", "pos", "term_id"], "left_semi")
    per = hit.groupBy("row", "item", "w", "origin", "n").agg(F.countDistinct("p").alias("held"))
    whole = per.where(F.col("held") == F.least(F.col("n"), F.lit(window)))
    return whole.select("row", "item", "w", (F.col("origin") + F.col("w")).alias("start"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window; an item of fewer words than a window is one window.
    Items with a null text hold no window; those with a null item_id hit words but aren't counted or named.  Texts are
    read whole, however long.  An empty table of documents gives an empty result, one of items no hits; extra columns of
    either are not read.
    """
    words = durable(item_words(items), "words")
    index = build_index(docs, words.select("term"))
    runs = durable(phrase_matches(index, words, window), "runs")
    places = runs.select("row", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("pos"))
    hits = places.distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    names = durable(words.select("item", F.col("item_id").cast("string").alias("name")).distinct(), "names")
    named = runs.select("row", "item").distinct().join(guarded_broadcast(names), "item")
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("found"))
    per = durable(hits.join(named, "row"), "hits")
    found = F.coalesce("found", F.array().cast("array<string>"))
    return index.docs.join(guarded_broadcast(per), "row", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op7: what each document shares with the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM documents
), b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[0-9a-z\x{80}-\x{10FFFF}]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)
), m AS (SELECT r, occ.n, i, item_id FROM occ JOIN win USING (phrase) WHERE occ.n = win.n),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
       FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN it USING (r)
"""
