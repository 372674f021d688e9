"""Language identification with bit-sliced Bloom filters of character n-grams.

Every language has a Bloom filter of its n-grams; the filters share their hash functions and are stored sliced:
slot i holds one bit per language, in as many 64-bit words as the languages need.  The bitwise AND of an n-gram's slots is the mask of all languages whose
filter contains it.  A text's masks are popcounted by language, each count is corrected for the filter's
false-positive rate, and the largest share of the text's n-grams decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import durable, guarded_broadcast, small_batches, tidied

#: n-gram length, slots of the table and probes per n-gram.
N, SLOT_BITS, PROBES = 4, 20, 3
#: About this many documents of each language are learned from; a larger table is sampled by hash.
LEARN_PER_LANG = 2000
#: Languages in a word of a slot.
WORD = 64
#: An n-gram belongs to a language where it is at least this share as frequent as where it is most frequent.
SHARE, LEAST_COUNT = 0.2, 2
#: Characters and documents handled at once.
CHUNK, DOCS = 250_000, 256


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case letter, or a space where it is no letter."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts' folded characters, and which text each comes from."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = _fold()[codes]
    if len(codes) == 0:
        return np.zeros(0, np.uint64), of
    # Of several spaces within a text one is kept, whatever the text before ends with.
    keep = np.r_[True, (codes[1:] != 32) | (codes[:-1] != 32) | (of[1:] != of[:-1])]
    codes, of = codes[keep].astype(np.uint64), of[keep]
    if len(codes) < N:
        return np.zeros(0, np.uint64), of[:0]
    h = np.zeros(len(codes) - N + 1, np.uint64)
    for i in range(N):
        h = h * np.uint64(0x100000001B3) + codes[i : i + len(h)]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    same = of[: len(h)] == of[N - 1 :]
    return h[same], of[: len(h)][same]


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts in groups of bounded size; a long text comes in pieces that overlap by N - 1 characters."""
    at, group, size = [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for start in range(0, max(1, len(text) - N + 1), CHUNK):
            piece = text[start : start + CHUNK + N - 1]
            if group and (size + len(piece) > CHUNK or len(group) >= DOCS):
                yield at, group
                at, group, size = [], [], 0
            at.append(i)
            group.append(piece)
            size += len(piece)
    if group:
        yield at, group


@dataclass
class Model:
    langs: list[str]
    common: int
    table: np.ndarray

    def rates(self) -> np.ndarray:
        """Each language's false-positive rate: the filled share of its filter to the power of the probes."""
        bits = [float(((self.table[:, i // WORD] >> np.uint64(i % WORD)) & np.uint64(1)).mean()) for i in range(len(self.langs))]
        return np.array(bits) ** PROBES


def train(docs: DataFrame, per_lang: int = LEARN_PER_LANG) -> Model:
    """A model of docs (text, lang[, doc_id]), from about per_lang documents of each language.

    Rows without text or lang are left out.  Which rows are taken follows a hash of text, lang and doc_id, so that copies
    of a text are taken or left one by one; other columns are not looked at.  The sample, and so all that reaches the
    driver, is bounded: for every 64 languages one mask for each of 2**SLOT_BITS slots at most.  An n-gram's frequency
    in a language is its share of the n-grams taken from that language, however few they are.  An empty table gives a
    model without languages.
    """
    spark = docs.sparkSession
    lot = F.pmod(F.xxhash64(*(["doc_id"] if "doc_id" in docs.columns else []), "text", "lang"), F.lit(1_000_000)) / 1_000_000
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", F.col("lang").cast("string"), lot.alias("lot"))
    found = docs.groupBy("lang").count().collect()
    found.sort(key=lambda r: r["lang"])
    table = np.zeros((1 << SLOT_BITS, max(1, -(-len(found) // WORD))), np.uint64)
    if not found:
        return Model([], 0, table)
    rates = spark.createDataFrame(
        [(i, r["lang"], min(1.0, per_lang / r["count"])) for i, r in enumerate(found)], "i int, lang string, rate double"
    )
    sample = docs.join(F.broadcast(rates), "lang").where("lot < rate").select("i", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist())
            for at, texts in _pieces(batch.column(1).to_pylist()):
                h, of = _grams(texts)
                lang = langs[at][of]
                for i in np.unique(lang):
                    grams, n = np.unique(h[lang == i].view(np.int64), return_counts=True)
                    columns = [pa.array(np.full(len(n), i, np.int32)), pa.array(grams), pa.array(n.astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["i", "gram", "n"])

    counts = small_batches(sample).mapInArrow(tidied(count), "i int, gram long, n long").groupBy("i", "gram").agg(F.sum("n").alias("n"))
    counts = durable(counts, "grams")
    taken = durable(counts.groupBy("i").agg(F.sum("n").alias("taken")), "taken")
    per_gram = Window.partitionBy("gram")
    member = (
        counts.join(guarded_broadcast(taken), "i")
        .withColumn("scaled", F.col("n") / F.col("taken"))
        .withColumn("most", F.max("scaled").over(per_gram))
        .where((F.col("n") >= LEAST_COUNT) & (F.col("scaled") >= SHARE * F.col("most")))
    )
    probes = F.array(*(F.shiftrightunsigned("gram", SLOT_BITS * k).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for k in range(PROBES)))
    slots = member.select("i", F.explode(probes).alias("slot"))
    bits = F.expr(f"bit_or(shiftleft(1L, i % {WORD}))").alias("bits")
    packed = slots.groupBy("slot", F.expr(f"i div {WORD}").alias("word")).agg(bits).toArrow()
    table[packed.column(0).to_numpy(), packed.column(1).to_numpy()] = packed.column(2).to_numpy().view(np.uint64)
    common = max(range(len(found)), key=lambda i: (found[i]["count"], -i))
    return Model([r["lang"] for r in found], common, table)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc, lang_pred, score) for each row of docs, doc being the row as a struct; only its text is looked at.

    lang_pred is `und` if text is null or has no letter, or if the model knows no language; a text none of whose
    n-grams is known gets the most frequent language with score 0.  score is the share of the text's n-grams
    that the language has, corrected for false positives.  Ties go to the language first in order.
    """
    langs, common, rates = model.langs, model.common, model.rates()
    width = next(w for w in (8, 16, 32, 64) if len(langs) <= w or w == WORD)
    table = model.table.astype(f"u{width // 8}")
    packed = docs.select(F.struct("*").alias("doc"), F.col("text").cast("string").alias("text"))
    probe = np.uint64((1 << SLOT_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            hits, total = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
            for rows, group in _pieces(texts):
                h, of = _grams(group)
                of = np.array(rows)[of]
                mask = table[h & probe]
                for k in range(1, PROBES):
                    mask &= table[(h >> np.uint64(SLOT_BITS * k)) & probe]
                total += np.bincount(of, minlength=len(texts))
                for i in range(len(langs)):
                    one = (mask[:, i // WORD] >> table.dtype.type(i % WORD)) & table.dtype.type(1)
                    hits[:, i] += np.bincount(of, weights=one, minlength=len(texts))
            share = np.clip((hits / np.maximum(total, 1)[:, None] - rates) / (1 - rates), 0, 1)
            share[total == 0] = 0
            best = share.argmax(1) if langs else np.zeros(len(texts), int)
            pred, score = [], []
            for i, text in enumerate(texts):
                if not langs or not text or not any(map(str.isalpha, text)):
                    pred.append("und")
                    score.append(0.0)
                else:
                    top = float(share[i, best[i]])
                    pred.append(langs[best[i] if top > 0 else common])
                    score.append(top)
            columns = [batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "lang_pred", "score"])

    schema = T.StructType([packed.schema["doc"]]).add("lang_pred", "string").add("score", "double")
    return small_batches(packed).mapInArrow(tidied(run), schema)


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5, or it has no id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    """op3: the predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return predict(ids, model).select("doc.doc_id", "doc.held_out", "lang_pred", "score")
