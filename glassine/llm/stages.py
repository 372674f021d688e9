"""The stages of the corpus pipeline: language ID, near-dedup, decontamination, mixing, token files.

Each takes (spark, docs, sf_dir).  All but the last return docs' columns, whatever they are, for the rows that stay.  An
empty table leaves every stage empty; texts are read whole, however long; columns other than doc_id, text, lang and source
are carried along and never looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, mixing, simhash, tokenfile
from .shared import durable, guarded_broadcast

#: Documents whose best language has less than this share of their n-grams are no language's.
LEAST_SCORE = 0.1
#: Carries a row's hash of doc_id and text along.
LOT = "__lot"


def _without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids; rows without one stay."""
    return docs.join(guarded_broadcast(durable(ids.select(key).distinct(), "dropped")), key, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; texts that are null, without letters or in none go."""
    model = langid.train(docs.where(~langid.held_out()))
    kept = langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike in 0.8 of their five-word shingles, the document with the smallest id.

    Rows that repeat both id and text are one document and leave one row.  Rows that repeat an id with unlike texts are
    documents of their own; with alike texts the one with the smaller hash stays.  Rows without an id stay.  Texts
    without a word are alike.
    """
    docs_lot = docs.withColumn(LOT, F.xxhash64("doc_id", "text"))
    labels = durable(simhash.near_duplicates(docs.select("doc_id", "text")).where("doc_id IS NOT NULL"), "labels")
    first = labels.where("doc_id = component_id").groupBy("root").agg(F.min("lot").alias("lot"))
    dropped = labels.join(guarded_broadcast(durable(first.select("lot"), "first")), "lot", "left_anti")
    kept = _without(docs_lot, dropped.select(F.col("lot").alias(LOT)), LOT)
    repeated = durable(labels.groupBy(F.col("lot").alias(LOT)).count().where("count > 1").select(LOT), "repeated")
    if not repeated.isEmpty():
        once = kept.join(guarded_broadcast(repeated), LOT, "left_semi").dropDuplicates([LOT])
        kept = kept.join(guarded_broadcast(repeated), LOT, "left_anti").unionByName(once)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; rows without an id or without a text stay."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.decontaminate(docs.select("doc_id", "text"), items)
    return _without(docs, found.where("contaminated")).select(*(F.col(f"`{c}`") for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents of the mixture by target weights of sources; by default in proportion to size, none above a quarter.

    A null source is one of its own; a null text counts one character.
    """
    return mixing.mix(docs, F.length("text"), weights).where("selected").select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files; a null text has the end id alone."""
    return tokenfile.token_files(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
