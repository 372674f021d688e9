"""SimHash near-duplicates over pigeonhole blocks.

A 64-bit fingerprint is cut into blocks.  Two fingerprints that differ in at most k bits differ in at
most k blocks, so of b blocks they share b - k; every choice of b - k blocks is a join key.  Fingerprints
are joined on those keys, Hamming distances are verified within each key, and the verified links are
closed into components.

* Equal fingerprints are collapsed before any join, so copies cost one row however many there are.
* Keys with many fingerprints are cut again over their free bits (the same pigeonhole one level down).
  With the exact blocks that fixes at least 48 bits, so no task ever gets more than 2^16 fingerprints of one key.
* Within a key a breadth-first walk emits a spanning forest, never all pairs.

``near_duplicates`` links by Jaccard similarity.  Texts alike in 0.8 of their shingles differ in some 10 of 64 bits, too
many for blocks; there the components of the pigeonhole join are one kind of group and bands of minimal hashes another,
and whole shingle sets decide within each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import connected_components, durable, guarded_broadcast, small_batches, thin, tidied

ONES = (1 << 64) - 1
#: Keys with more fingerprints than this are cut again.
CROWDED = 2048
#: Bands of minimal hashes and hashes of a band: a pair at 0.8 shares a band with probability 0.998.
BANDS, ROWS = 20, 6
#: How often every group's members meet one of them before the members left are compared with each other.
ROUNDS = 3
#: Members of a tile; two tiles are compared at once.
TILE = 256


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _blocks(bits: list[int], n: int) -> list[int]:
    """bits dealt to n masks of neighbouring bits, as evenly as can be."""
    cuts = [round(i * len(bits) / n) for i in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in itertools.pairwise(cuts)]


def exact_masks(max_bits: int = 3, blocks: int | None = None) -> list[int]:
    """Masks of which any two fingerprints within max_bits share at least one."""
    blocks = blocks or 2 * max_bits
    return [sum(c) for c in itertools.combinations(_blocks(list(range(64)), blocks), blocks - max_bits)]


def _finer(mask: int, max_bits: int) -> list[int]:
    """Masks that hold mask and, of its free bits, every half of 2 * max_bits blocks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = _blocks(free, 2 * max_bits)
    return [mask | sum(c) for c in itertools.combinations(cut, max_bits)]


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text's words, repeats included; of fewer words, of the whole sequence."""
    if not words:
        return np.zeros(0, "<u8")
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(g, 42) for g in grams], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text).

    Words are runs of bytes other than ASCII white space, after A-Z is lower-cased.  A null or empty
    text has no words and the fingerprint zero.  Whole texts are read, one batch at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            fps = [_signed(majority(shingle_hashes((t or b"").lower().split(), shingle))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(slim).mapInArrow(tidied(run), "doc_id long, fp long")


def walk(members: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links within max_bits that keep members connected."""
    links, rest = [], np.arange(1, len(members))
    front = np.zeros(1, np.int64)
    while True:
        found = []
        for block in np.array_split(front, max(1, len(front) * max(1, len(rest)) // 1_000_000)):
            if not len(rest) or not len(block):
                break
            near = np.bitwise_count(members[block][:, None] ^ members[rest][None, :]) <= max_bits
            hit = near.any(0)
            links += zip(members[rest[hit]].tolist(), members[block[near[:, hit].argmax(0)]].tolist())
            found.append(rest[hit])
            rest = rest[~hit]
        front = np.concatenate(found) if found else np.zeros(0, np.int64)
        if not len(front):
            if not len(rest):
                break
            front, rest = rest[:1], rest[1:]
    return links


def _verified(keyed: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between the fingerprints of one key; keyed: (key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sizes = np.diff(np.r_[starts, len(keys)])
            two = starts[sizes == 2]
            two = two[np.bitwise_count(fps[two] ^ fps[two + 1]) <= max_bits]
            found = list(zip(fps[two].tolist(), fps[two + 1].tolist()))
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                found += walk(fps[s : s + n], max_bits)
            a, b = np.array(found, np.uint64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            fps = np.r_[fps, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)]
            if len(keys) and (cut := int(np.searchsorted(keys, keys[-1]))):  # the last key may go on
                yield links(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield links(keys, fps)

    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Verified links (a, b) that keep connected what max_bits connect among the distinct fingerprints fps (fp)."""
    masks = exact_masks(max_bits)
    spread = F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks))).alias("i", "mask")
    # A written table has few files; its rows are dealt out before each makes one for every mask.
    keyed = fps.repartition("fp").select("fp", spread).select(
        F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "i").alias("key"), "fp", "i"
    )
    counts = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = keyed.join(counts, "key")
    plain = shared.where(F.col("n") <= CROWDED).select("key", "fp")
    crowded = shared.where(F.col("n") > CROWDED)
    if not counts.where(F.col("n") > CROWDED).isEmpty():
        finer = F.array(*(F.array(*(F.lit(_signed(m)) for m in _finer(mask, max_bits))) for mask in masks))
        again = crowded.select("fp", "i", F.posexplode(F.element_at(finer, F.col("i") + 1)).alias("j", "mask"))
        plain = plain.union(
            again.select(F.xxhash64(F.col("fp").bitwiseAND(F.col("mask")), "i", "j").alias("key"), "fp")
        )
    return _verified(plain, max_bits).distinct()


def components(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (doc_id, fp, ...) with root and component_id: over edges (a, b) of fingerprints, the smallest of these and the
    smallest doc_id that can be reached."""
    roots = connected_components(edges)
    nodes = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = durable(
        nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "rooted",
    )
    least = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    labels = durable(rooted.join(least, "root").select("fp", "root", "component_id"), "labels")
    return found.join(labels, "fp")


def simhash_components(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp (long) and component_id, the smallest doc_id of its component.

    A null doc_id keeps its row and joins its component, but never names it.  Repeated rows stay repeated.
    Extra columns are ignored; an empty table gives an empty result.
    """
    found = durable(fingerprints(docs, shingle), "fingerprints")
    edges = links(durable(found.select("fp").distinct(), "distinct"), max_bits)
    return components(found, edges).drop("root")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """(node, shingles) of docs (node, text): each text's distinct shingle hashes, whole and in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sets = [
                    np.unique(shingle_hashes((t or b"").lower().split(), shingle).view("<i8"))
                    for t in part.column(1).cast(pa.binary()).to_pylist()
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "shingles"])

    return small_batches(docs).mapInArrow(tidied(run), "node long, shingles array<long>")


def alike(members: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) that keep sets of Jaccard >= similarity connected: a walk over pairs that pass, never all pairs.

    A set meets only the sets still without a link, so a pair that fails uses up nothing.
    """
    sizes = np.array([len(m) for m in members])
    flat = np.concatenate(members)
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(flat, kind="stable")
    values, owner = flat[order], owner[order]
    links, left, todo = [], np.ones(len(members), bool), []
    for first in range(len(members)):
        if not left[first]:
            continue
        left[first] = False
        todo.append(first)
        while todo:
            i = todo.pop()
            if not left.any():
                return links
            # The owners of each of i's shingles stand together.
            lo, hi = np.searchsorted(values, members[i], "left"), np.searchsorted(values, members[i], "right")
            n = hi - lo
            at = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
            both = np.bincount(owner[at], minlength=len(members))
            near = left & (both >= similarity * (sizes + sizes[i] - both))
            hit = np.flatnonzero(near).tolist()
            links += [(i, j) for j in hit]
            left[near] = False
            todo += hit
    return links


def _tiled_links(left: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of Jaccard >= similarity within each key of left (key, node, n), n being the key's size.

    The members of a large key are dealt to tiles and every two tiles are compared, so a task holds two at most.
    """
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    dealt = left.withColumn("tiles", tiles).withColumn("i", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, members = None, [], []

        def links() -> pa.RecordBatch:
            found = alike(members, similarity) if len(members) > 1 else []
            a, b = [nodes[i] for i, _ in found], [nodes[j] for _, j in found]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            column = batch.column(2)
            for i, (k, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if k != key:
                    if nodes:
                        yield links()
                    key, nodes, members = k, [], []
                nodes.append(node)
                members.append(column[i].values.to_numpy(zero_copy_only=False).copy())
        if nodes:
            yield links()

    grouped = dealt.select(group, "node").join(sets, "node").select("key", "node", "shingles")
    return small_batches(grouped.repartition("key").sortWithinPartitions("key", "node")).mapInArrow(tidied(run), "a long, b long")


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, lot, node, fp, n, keys) of docs (doc_id, text, lot).

    node is a hash of a text's distinct shingles, n their number, fp the fingerprint and keys has a hash for every band
    of minimal hashes.  A text without words has no keys.
    """
    rng = np.random.default_rng(7)
    odd, plus = (rng.integers(0, 1 << 64, bands * rows, np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    fold = rng.integers(0, 1 << 64, (bands, rows), np.uint64) | np.uint64(1)

    def keys(distinct: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, ONES, np.uint64)
        for i in range(0, len(distinct), 256):
            np.minimum(least, (distinct[i : i + 256, None] * odd + plus).min(0), out=least)
        key = (least.reshape(bands, rows) * fold).sum(1, dtype=np.uint64)
        return (key ^ (key >> np.uint64(29))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, sizes, lists = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                hashes = shingle_hashes((text or b"").lower().split(), shingle)
                distinct = np.unique(hashes)
                nodes.append(_signed(xxhash.xxh64_intdigest(distinct.tobytes(), 42)))
                fps.append(_signed(majority(hashes)))
                sizes.append(len(distinct))
                lists.append(keys(distinct) if len(distinct) else np.zeros(0, np.int64))
            columns = [batch.column(0), batch.column(2), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64())]
            columns += [pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lot", "node", "fp", "n", "keys"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "lot")
    return small_batches(slim).mapInArrow(tidied(run), "doc_id long, lot long, node long, fp long, n long, keys array<long>")


def _jaccard(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, shingles) have Jaccard >= similarity."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    enough = common >= F.lit(similarity) * (F.size("x") + F.size("y") - common)
    return pairs.join(x, "a").join(y, "b").where(enough).select("a", "b")


def _joined(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """Edges (a, b) that keep connected what Jaccard >= similarity connects within the groups of members (key, node, size).

    In every round all members of a group meet one of them, the one that shares most groups with most others, which a
    text that the others were edited from does.  It has then met all and leaves.  A group whose members are all
    connected is done.  What a few rounds leave open is compared member by member in tiles.
    """
    members = members.withColumn("root", F.col("node"))
    rows = members.count()
    edges = roots = None
    for turn in range(ROUNDS + 1):
        ends = F.min("root").alias("first"), F.max("root").alias("last")
        groups = members.groupBy("key").agg(F.count("*").alias("n"), *ends, F.bit_xor(F.xxhash64("node")).alias("all"))
        # Of groups with the same members one is enough.
        groups = groups.where("first <> last").groupBy("n", "first", "last", "all").agg(F.min("key").alias("key"))
        groups = durable(thin(groups.select("key", "n"), rows), "groups")
        if groups.isEmpty():
            break
        live = durable(thin(members.join(guarded_broadcast(groups), "key"), rows), "live")
        if turn == ROUNDS:
            found = durable(_tiled_links(live.select("key", "node", "n"), sets, similarity), "links")
            edges = found if edges is None else edges.union(found)
            break
        score = durable(thin(live.groupBy("node").agg(F.sum("n").alias("score")), rows), "score")
        scored = live.join(guarded_broadcast(score), "node")
        best = F.max(F.struct("score", "node", "root", "size")).alias("best")
        best = scored.groupBy("key").agg(best).select(
            "key", F.col("best.node").alias("b"), F.col("best.root").alias("other"), F.col("best.size").alias("size_b")
        )
        best = durable(thin(best, rows), "best")
        beside = live.join(guarded_broadcast(best), "key").where("node <> b")
        long_enough = F.least("size", "size_b") >= F.lit(similarity) * F.greatest("size", "size_b")
        asked = beside.where((F.col("root") != F.col("other")) & long_enough)
        asked = durable(thin(asked.select(F.col("node").alias("a"), "b").distinct(), rows), "asked")
        found = durable(_jaccard(asked, sets, similarity), "found")
        rest = beside.select("key", "node", "size", "root")
        if not found.isEmpty():
            edges = found if edges is None else edges.union(found)
            # A component so far is a star around its root.
            stars = found if roots is None else found.union(roots.select("node", "now"))
            roots = durable(connected_components(stars).withColumnRenamed("root", "now"), "roots")
            rest = rest.join(guarded_broadcast(roots), "node", "left")
            rest = rest.select("key", "node", "size", F.coalesce("now", "root").alias("root"))
        members = durable(thin(rest, rows), "members")
    return edges


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """One row per document: doc_id, lot, root and component_id, linking texts whose shingles have Jaccard >= similarity.

    lot is a hash of doc_id and text, root one of the component.  Texts with the same set of shingles are one node.  Two kinds of groups bring
    nodes together: the components of fingerprints within three bits, by pigeonhole blocks, and equal bands of minimal
    hashes for the pairs that differ in more bits.  Within a group whole shingle sets are compared, never estimates.

    A null doc_id joins its component, but never names it (a component of null ids has a null component_id).  Null and
    empty texts have no shingles and are alike.  Repeated rows stay repeated; an empty table gives an empty result;
    extra columns are ignored.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("lot"))
    found = durable(signatures(docs, shingle), "signatures")
    least = F.min_by(F.struct("lot", "fp", "n", "keys"), "lot").alias("s")
    nodes = durable(found.groupBy("node").agg(least).select("node", "s.*").repartition("node"), "nodes")
    roots = durable(connected_components(links(durable(nodes.select("fp").distinct(), "distinct"))), "roots")
    blocks = nodes.join(guarded_broadcast(roots.withColumnRenamed("node", "fp")), "fp", "left")
    blocks = blocks.select(F.xxhash64(F.coalesce("root", "fp"), F.lit("fp")).alias("key"), "node", F.col("n").alias("size"))
    keyed = nodes.select(F.explode("keys").alias("key"), "node", F.col("n").alias("size")).union(blocks)
    shared = durable(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "shared")
    members = durable(keyed.join(guarded_broadcast(shared), "key"), "members")
    # Only texts that may have a partner are read again.
    needed = durable(members.select("node").distinct().join(nodes.select("node", "lot"), "node"), "needed")
    texts = docs.join(guarded_broadcast(needed), "lot").select("node", F.col("text").cast("string").alias("text"))
    sets = durable(_sets(texts, shingle), "sets")
    if sets.count() > needed.count():
        # Copies of a row have the same lot.
        sets = durable(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
    edges = _joined(members, sets, similarity)
    found = found.select("doc_id", "lot", F.col("node").alias("fp"))
    if edges is None:
        edges = found.sparkSession.createDataFrame([], "a long, b long")
    return components(found, edges).drop("fp")


def query(spark, sf_dir: str) -> DataFrame:
    """op5: fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return simhash_components(docs).select("doc_id", hexed, "component_id")
