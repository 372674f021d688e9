"""SpotSigs: documents as sets of signatures that start at common words.

Every occurrence of an anchor, a word so common that it is in running text but seldom in menus and lists, starts a
signature: the anchor and the next CHAIN content words after it.  A text is the multiset of its signatures' hashes;
two texts are as alike as those multisets' Jaccard similarity.

Jaccard can't exceed the ratio of the smaller set's length to the larger's.  ``near_pairs`` therefore deals the sets to
partitions by length such that alike sets lie in the same or in neighbouring partitions, joins them on a prefix of
their rarest signatures only, and verifies what meets.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import durable, guarded_broadcast, small_batches

#: Content words of a signature.
CHAIN = 2
#: Likeness below this counts as none; signatures compared at once.
LEAST, STEP = 0.05, 1024
#: Common words of English, French, German and Spanish.
ANCHORS = frozenset(
    (
        "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
        "au aux ce dans de des du elle en est et il la le les ne ou par pas pour que qui se sur un une "
        "auf das dem den der des die ein eine für im in ist mit nicht sich sie und von zu "
        "al como con de del el en es la las lo los no para por que se su un una y"
    ).split()
)
_WORD = re.compile(r"\w+").findall


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The sorted signature hashes (32 bits, repeats kept) of a text.

    In a text without anchors every word is one; a text without words has a single signature, its own hash; a null or
    empty text has none.
    """
    if not text:
        return np.zeros(0, np.uint32)
    words = _WORD(text.lower())
    if not words:
        return np.array([zlib.crc32(text.encode("utf-8", "surrogatepass"))], np.uint32)
    common = [w in ANCHORS for w in words]
    if any(common):
        content = [w for w, c in zip(words, common) if not c]
        after = accumulate(common, lambda n, c: n + (not c), initial=0)  # content words before each word
        spots = [(w, k) for w, c, k in zip(words, common, after) if c]
    else:
        content, spots = words, [(w, k + 1) for k, w in enumerate(words)]
    crc = zlib.crc32
    out = [crc(" ".join((w, *content[k : k + chain])).encode("utf-8", "surrogatepass")) for w, k in spots]
    return np.sort(np.array(out, np.uint32))


def packed(found: np.ndarray) -> bytes:
    """A signature multiset as bytes: the sorted hashes, four bytes each."""
    return found.astype("<u4").tobytes()


def as_text(column: str) -> Column:
    """A packed multiset as a fingerprint: its length, then the hashes in base64."""
    n = F.expr(f"cast(octet_length({column}) div 4 AS string)")
    return F.concat(n, F.lit(":"), F.base64(column)).alias(column)


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Multiset Jaccard of two sorted signature arrays where it is at least least, else 0; 1 for two empty ones.

    Sets whose lengths rule out least are never compared, and comparison stops where what is left of both can't reach
    it any more.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    both = i = j = 0
    whole = len(a) + len(b)
    need = least * whole / (1 + least)
    while i < len(a) and j < len(b) and both + min(len(a) - i, len(b) - j) >= need:
        # The next STEP of a, the same range of hashes of b, and repeats of the last one.
        k = int(np.searchsorted(a, a[min(i + STEP, len(a)) - 1], "right"))
        m = int(np.searchsorted(b, a[k - 1], "right"))
        x, n = np.unique(a[i:k], return_counts=True)
        y, o = np.unique(b[j:m], return_counts=True)
        _, at, to = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        both += int(np.minimum(n[at], o[to]).sum())
        i, j = k, m
    value = both / (whole - both)
    return value if value >= least else 0.0


def edited(text: str, following: str) -> str:
    """text with its last half replaced by the first as many code points (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double"
)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row of COLUMNS per document of docs (doc_id, text), compared with its edited text and the next document.

    The next document is that of the next doc_id, after the last the first; null ids come first, and equal ids follow
    the order of their texts' hashes.  A null text is empty.  Documents are sorted once over the cluster, compressed on
    the way; only the first document of each partition is fetched anew for the last one of the partition before.

    Likeness is exact from LEAST on and 0 below.  Texts are compared whole, however long; repeated rows are documents of
    their own; an empty table gives an empty result; a single document's next one is itself; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))
    order = ["doc_id", "h"]

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shrink = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                small = [shrink(t) for t in texts.slice(at, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(small, pa.binary())], ["doc_id", "h", "z"])

    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def row(doc_id, text: str, own: np.ndarray, following: str, its: np.ndarray) -> tuple:
        changed = edited(text, following)
        new = signatures(changed)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc_id, len(text), sha, packed(own), packed(new), likeness(own, new, LEAST), likeness(own, its, LEAST))

    types = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    # What a partition can't finish alone: its last document, and its first for the partition before.
    schema = COLUMNS + ", part int, edge string, edge_id long, edge_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        grow = zstandard.ZstdDecompressor().decompress
        held = None

        def made(rows: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in names]
            columns = [c + [None] * len(edges) for c in columns]
            more = [[None] * len(rows) + [e[i] for e in edges] for i in range(4)]
            kinds = [*types, pa.int32(), pa.string(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip([*columns, *more], kinds)], [*names, "part", "edge", "edge_id", "edge_text"]
            )

        for batch in batches:
            rows, edges = [], []
            for doc_id, small in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                text = grow(small).decode("utf-8", "surrogatepass")
                own = signatures(text)
                if held is None:
                    edges.append((part, "first", doc_id, text))
                else:
                    rows.append(row(*held, text, own))
                held = (doc_id, text, own)
                if len(rows) >= 500:
                    yield made(rows, edges)
                    rows, edges = [], []
            yield made(rows, edges)
        if held is not None:
            yield made([], [(part, "last", held[0], held[1])])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                row(i, text, signatures(text), following, signatures(following))
                for i, text, following in zip(*(c.to_pylist() for c in batch.columns))
            ]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    dealt = small_batches(slim).mapInArrow(squeeze, "doc_id long, h long, z binary").repartitionByRange(*order)
    found = durable(dealt.sortWithinPartitions(*order).mapInArrow(run, schema), "compared")
    firsts = found.where("edge = 'first'").select("part", F.col("edge_text").alias("next_text"))
    lasts = found.where("edge = 'last'").select("part", "edge_id", "edge_text")
    # As many numbers as there are partitions.
    parts = sorted(r[0] for r in firsts.select("part").collect())
    spark = docs.sparkSession
    pairs = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    joined = (
        lasts.join(F.broadcast(pairs), "part")
        .join(firsts.withColumnRenamed("part", "next_part"), "next_part")
        .select("edge_id", "edge_text", "next_text")
    )
    whole = found.where("edge IS NULL").select(*names).union(joined.mapInArrow(ends, COLUMNS))
    return whole.select(*(as_text(n) if n.endswith("fingerprint") else F.col(n) for n in names))


def _length_part(n: F.Column, similarity: float) -> F.Column:
    """Partition of a set of n signatures: sets with Jaccard of at least similarity differ by one at most."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / float(-np.log(similarity))).cast("int")


def near_pairs(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id) of docs (doc_id, text), and links between classes: returns two DataFrames.

    A class is the documents of equal signature multisets, named by its smallest doc_id; links (a, b, likeness) are
    all pairs of classes with Jaccard >= similarity.  A null or empty text's class has no signature and no links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for text in batch.column(1).to_pylist():
                # The k-th repeat of a hash is an element of its own, which makes the multiset a set.
                seen: Counter = Counter()
                items = []
                for h in signatures(text).tolist():
                    items.append(h | seen[h] << 32)
                    seen[h] += 1
                sets.append(items)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "sigs"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = small_batches(slim).mapInArrow(run, "doc_id long, sigs array<long>").withColumn("class", F.md5(F.array_join("sigs", ",")))
    found = durable(found, "signatures")
    classes = found.groupBy("class").agg(F.min("doc_id").alias("id"), F.first("sigs").alias("sigs"))
    classes = durable(classes.where(F.size("sigs") > 0).withColumn("n", F.size("sigs")), "classes")
    freq = durable(classes.select(F.explode("sigs").alias("sig")).groupBy("sig").count(), "frequencies")
    # Two sets with Jaccard >= s share one of the n - ceil(s * n) + 1 rarest elements of each.
    exploded = classes.select("class", "n", F.explode("sigs").alias("sig")).join(freq, "sig")
    ranked = exploded.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("count", "sig"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    prefix = ranked.select("class", "n", F.explode(F.slice("order", F.lit(1), keep.cast("int"))).alias("e"))
    prefix = prefix.select("class", "n", F.col("e.sig").alias("sig"), _length_part(F.col("n"), similarity).alias("lp"))
    prefix = durable(prefix, "prefix")
    left = prefix.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", F.explode(F.array("lp", F.col("lp") + 1)).alias("lp"), F.col("lp").alias("la"))
    right = prefix.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", "lp")
    fits = (F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")) & (
        (F.col("la") < F.col("lp")) | (F.col("a") < F.col("b"))
    )
    met = left.join(right, ["sig", "lp"]).where(fits).select("a", "b").distinct()
    one = classes.select(F.col("class").alias("a"), F.col("id").alias("ia"), F.col("sigs").alias("x"))
    two = classes.select(F.col("class").alias("b"), F.col("id").alias("ib"), F.col("sigs").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    value = both / (F.size("x") + F.size("y") - both)
    links = met.join(one, "a").join(two, "b").withColumn("likeness", value).where(F.col("likeness") >= similarity)
    named = found.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    members = found.join(guarded_broadcast(durable(named, "named")), "class").select("doc_id", "class_id")
    return members, links.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "likeness")


def query(spark, sf_dir: str) -> DataFrame:
    """op6: every document's fingerprint, and how like its edited text and the next document it is."""
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
