"""Every query of the engine by name, and its SQL.

The driver's tables stand in for a catalogue: documents are files, pages a folder tree, embeddings image and face
vectors, orders captures, events the filesystem's.  The SQL derives the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, places, times, vectors
from .operators import clustering, faces, identity, linkage, listing, similarity, tree
from .operators import places as place_ops
from .plans import build, catalog, grammar, people, rename
from .session import table
from .streaming import events as stream

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function as a query under its own name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


EXTENSIONS = ["jpg", "heic", "cr3", "mov", "txt"]

MEDIA = """m AS (
  SELECT md5(text) AS hash, concat(source, '/', lang) AS folder,
         concat(source, '/', lang, '/', doc_id, '.', ['jpg', 'heic', 'cr3', 'mov', 'txt'][doc_id % 5 + 1]) AS path,
         n_chars AS size, ['photo', 'photo', 'photo', 'video', NULL][doc_id % 5 + 1] AS kind, doc_id,
         TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS mtime,
         CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2023-06-01' + to_hours(doc_id) END AS taken_at,
         (doc_id * 37 % 101)::DOUBLE AS sharpness
  FROM documents)"""


def media(spark: SparkSession, d: str) -> DataFrame:
    """documents as files of a catalogue."""
    docs = table(spark, d, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int"))
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("."), ext))
    seconds = lambda start, step: F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + F.col("doc_id") * step)
    return docs.select(
        F.md5("text").alias("hash"),
        F.concat_ws("/", "source", "lang").alias("folder"),
        path.alias("path"),
        F.col("n_chars").alias("size"),
        paths.kind_of(path).alias("kind"),
        "doc_id",
        seconds("2024-01-01", 60).alias("mtime"),
        F.when(F.col("doc_id") % 7 != 0, seconds("2023-06-01", 3600)).alias("taken_at"),
        (F.col("doc_id") * 37 % 101).cast("double").alias("sharpness"),
    )


def _ntz(*names: str):
    """Timestamps as wall-clock time, as the SQL has them."""
    return {n: F.col(n).cast("timestamp_ntz") for n in names}


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT a.vec_id, a.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b
WHERE b.vec_id = 0 AND a.vec_id <> 0 AND {_DOT} >= 0.18::DOUBLE ORDER BY {_DOT} DESC, a.vec_id LIMIT 20""")
def vector_topk(spark, d):
    """The 20 vectors most like the first one, at 0.18 or more."""
    v = table(spark, d, "embeddings")
    wanted = similarity.first_vector(v, "vec_id", 0)
    found = similarity.top_k(v.where("vec_id <> 0"), wanted, 0.18, 20, "vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""SELECT a.vec_id, a.label, round({_DOT}, 6) AS score FROM embeddings a, embeddings b
WHERE b.vec_id = 7 AND a.vec_id <> 7 AND a.label IN (1, 2, 3) AND {_DOT} >= 0.1::DOUBLE
ORDER BY {_DOT} DESC, a.vec_id LIMIT 10""")
def vector_topk_filtered(spark, d):
    """Top-k within a selection: the filter reaches the scan."""
    v = table(spark, d, "embeddings")
    wanted = similarity.first_vector(v, "vec_id", 7)
    found = similarity.top_k(v.where(F.col("label").isin(1, 2, 3) & (F.col("vec_id") != 7)), wanted, 0.1, 10, "vec_id")
    return found.select("vec_id", "label", F.round("score", 6).alias("score"))


@query(f"""SELECT a.vec_id AS i, b.vec_id AS j, round(1 - {_DOT}, 6) AS distance FROM embeddings a, embeddings b
WHERE a.vec_id < b.vec_id AND 1 - {_DOT} <= 0.65::DOUBLE""")
def vector_pairs(spark, d):
    """All pairs of vectors within a cosine distance of 0.65."""
    found = similarity.vector_pairs(table(spark, d, "embeddings"), 0.65, "vec_id")
    return found.select("i", "j", F.round("distance", 6).alias("distance"))


@query("""WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 5)::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, greatest(sqrt(list_inner_product(v, v)), 1e-9::DOUBLE) AS n FROM s)
SELECT vec_id, round(v[1] / n, 6) + 0.0::DOUBLE AS x0, round(v[64] / n, 6) + 0.0::DOUBLE AS x63, round(sqrt(list_inner_product(v, v)) / n, 6) AS length FROM n""")
def vector_normalise(spark, d):
    """Scaled vectors brought back to length one; a zero vector stays zero."""
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 5).cast("double")).alias("v"))
    u = vectors.unit(F.col("v"))
    return v.select(
        "vec_id", (F.round(u[0], 6) + 0.0).alias("x0"), (F.round(u[63], 6) + 0.0).alias("x63"), F.round(vectors.norm(u), 6).alias("length")
    )


_BITS = "list_sum(list_transform(range(1, 63), lambda i: CASE WHEN embedding[i] > 0 THEN 1::BIGINT << (i - 1) ELSE 0::BIGINT END))::BIGINT"


@query(f"""WITH s AS (SELECT vec_id, {_BITS} AS b FROM embeddings)
SELECT x.vec_id AS i, y.vec_id AS j, bit_count(xor(x.b, y.b))::INTEGER AS bits FROM s x, s y
WHERE x.vec_id < y.vec_id AND bit_count(xor(x.b, y.b)) <= 18""")
def hamming_pairs(spark, d):
    """All pairs whose sign bits differ in at most 18 places."""
    import numpy as np

    def close(a: dict, b: dict):
        bits = np.bitwise_count(a["bits"][:, None] ^ b["bits"][None, :])
        return bits.astype(float), bits <= 18

    v = table(spark, d, "embeddings").select("vec_id", similarity.sign_bits(F.col("embedding")).alias("bits"))
    found = similarity.tiled_pairs(v, "vec_id", {"bits": "bits"}, close)
    return found.select("i", "j", F.col("distance").cast("int").alias("bits"))


def _signatures(spark, d):
    v = table(spark, d, "embeddings")
    return v.select(
        "vec_id", similarity.sign_bits(F.col("embedding")).alias("dhash"), vectors.standardise(F.col("embedding")).alias("norm")
    )


@query(f"""WITH s AS (SELECT vec_id, {_BITS} AS b, embedding::DOUBLE[] AS e FROM embeddings),
c AS (SELECT vec_id, b, list_transform(e, lambda x: x - list_avg(e)) AS e FROM s),
n AS (SELECT vec_id, b, list_transform(e, lambda x: x / greatest(sqrt(list_inner_product(e, e) / 64), 1e-6::DOUBLE)) AS e FROM c)
SELECT * FROM (SELECT x.vec_id AS i, y.vec_id AS j,
  round(sqrt(list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 64), 6) AS distance
  FROM n x, n y WHERE x.vec_id < y.vec_id AND bit_count(xor(x.b, y.b)) <= 24) WHERE distance <= 1.15::DOUBLE""")
def dedupe_pairs(spark, d):
    """Near duplicates: few differing bits, and a small RMSE of the standardised thumbnails."""
    found = similarity.image_pairs(_signatures(spark, d), 24, 1.15, "vec_id")
    return found.select("i", "j", F.round("distance", 6).alias("distance"))


@query()
def dedupe_groups(spark, d):
    """Groups of near duplicates by complete linkage: within a group every pair is one."""
    return linkage.linked_groups(_signatures(spark, d), "vec_id", similarity.IMAGE, similarity.images_close(26, 1.25))


_GROUPS = f"""WITH {MEDIA}, g AS (
  SELECT *, hash AS group_id, count(*) OVER (PARTITION BY hash) AS n, max(sharpness) OVER (PARTITION BY hash) AS top,
         row_number() OVER (PARTITION BY hash ORDER BY sharpness DESC, path DESC) AS r FROM m)"""


def _members(spark, d):
    m = media(spark, d)
    twice = m.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    return listing.keepers(m.join(twice, "hash").withColumn("group_id", F.col("hash")))


@query(_GROUPS + """ SELECT path, group_id, r = 1 AS is_keep,
  CASE WHEN top <= 1e-9 THEN 100 ELSE greatest(0, least(100, round(sqrt(sharpness / top) * 100)))::INTEGER END::INTEGER AS quality,
  CASE WHEN taken_at IS NULL THEN 'undated'
       WHEN doc_id % 2 = 0 THEN concat('trip:', isoyear(taken_at), '-', lpad(weekofyear(taken_at)::VARCHAR, 2, '0'), ':', folder)
       ELSE concat('day:', strftime(taken_at, '%Y-%m-%d')) END AS batch
FROM g WHERE n > 1""")
def dedupe_review(spark, d):
    """Duplicates under review: the keeper, each one's quality and the batch it is reviewed in."""
    rows = listing.review(_members(spark, d).withColumn("place", F.when(F.col("doc_id") % 2 == 0, F.col("folder"))))
    return rows.select("path", "group_id", "is_keep", "quality", F.col("batch.id").alias("batch"))


@query(_GROUPS + """ SELECT group_id, count(*) AS files, coalesce(sum(size) FILTER (r > 1), 0)::BIGINT AS bytes
FROM g WHERE n > 1 GROUP BY group_id""")
def reclaimable(spark, d):
    """Bytes that each group of duplicates would free."""
    return listing.reclaimable(_members(spark, d))


@query(f"WITH {MEDIA} SELECT hash, max(path) AS path, count(*) AS files FROM m GROUP BY hash HAVING count(*) > 1")
def exact_duplicates(spark, d):
    """Contents with several files, and the last path of each."""
    m = media(spark, d)
    n = m.groupBy("hash").agg(F.count("*").alias("files")).where("files > 1")
    return listing.last_paths(m).join(n, "hash")


_ASSIGN = f"""WITH s AS (
  SELECT a.vec_id, a.label, concat('p', b.label) AS name, b.label AS ord, max({_DOT}) AS sim
  FROM embeddings a, embeddings b WHERE a.vec_id >= 100 AND b.vec_id < 100 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, ord) AS rk FROM s),
x AS (SELECT vec_id, any_value(label) AS truth, max(name) FILTER (rk = 1) AS name, max(sim) FILTER (rk = 1) AS similarity,
             max(name) FILTER (rk = 2) AS runner_up, max(sim) FILTER (rk = 2) AS runner_up_sim
      FROM r WHERE rk <= 2 GROUP BY vec_id),
k AS (SELECT *, CASE WHEN similarity < 0.3::DOUBLE THEN 'Unknown' WHEN similarity - runner_up_sim < 0.05::DOUBLE THEN 'Ambiguous' ELSE 'Person' END AS kind FROM x)"""


def _assigned(spark, d, *more: str):
    v = table(spark, d, "embeddings")
    refs = v.where("vec_id < 100").select(F.concat(F.lit("p"), F.col("label").cast("string")).alias("name"), F.col("label").alias("ord"), "embedding")
    faces = v.where("vec_id >= 100").withColumn("truth", F.col("label"))
    return identity.assign(faces, refs, ["vec_id", *more], 0.30, 0.05)


@query(_ASSIGN + """ SELECT vec_id, kind, name, round(similarity, 6) AS similarity, runner_up, round(runner_up_sim, 6) AS runner_up_sim FROM k""")
def face_assign(spark, d):
    """Each face's identity: the nearest person's, unless nobody is near or two are."""
    r = F.round
    return _assigned(spark, d).select("vec_id", "kind", "name", r("similarity", 6).alias("similarity"), "runner_up", r("runner_up_sim", 6).alias("runner_up_sim"))


@query(_ASSIGN + """ SELECT name, count(DISTINCT vec_id % 40) AS photos, min(vec_id % 40) AS cover FROM k WHERE kind = 'Person'
AND NOT (name = 'p3' AND vec_id % 40 < 5) GROUP BY name""")
def people_overview(spark, d):
    """Photos of each person, without the excluded ones."""
    found = _assigned(spark, d).withColumn("hash", F.col("vec_id") % 40)
    excluded = spark.range(5).select(F.lit("p3").alias("name"), F.col("id").alias("hash"))
    return identity.overview(identity.identified(found, excluded))


@query(_ASSIGN + " SELECT truth, kind, name, count(*) AS faces FROM k GROUP BY ALL")
def assign_eval(spark, d):
    """How faces of known people were assigned."""
    return identity.evaluate(_assigned(spark, d, "truth"))


@query()
def cluster_unassigned(spark, d):
    """Unknown faces in groups by complete linkage; what is left over is a group of its own."""
    unknown = _assigned(spark, d).where("kind = 'Unknown'").select("vec_id")
    v = table(spark, d, "embeddings").join(unknown, "vec_id", "left_semi")
    groups = clustering.complete_linkage(similarity.vector_pairs(v, 0.65, "vec_id"))
    alone = v.select(F.col("vec_id").alias("member")).join(groups, "member", "left_anti")
    return groups.unionByName(alone.select(F.col("member").alias("group_id"), "member"))


@query("""WITH e AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY ALL),
n AS (SELECT label, sqrt(sum(x * x)) AS n FROM e GROUP BY label)
SELECT label, round(max(x / n) FILTER (i = 1), 6) AS x0, round(max(x / n) FILTER (i = 64), 6) AS x63 FROM e JOIN n USING (label) GROUP BY label""")
def centroids(spark, d):
    """The mean vector of each label at length one."""
    c = identity.centroids(table(spark, d, "embeddings"), "label")
    return c.select("label", F.round(F.col("centroid")[0], 6).alias("x0"), F.round(F.col("centroid")[63], 6).alias("x63"))


@query("""WITH f AS (SELECT l_orderkey AS hash, max(l_discount) AS ratio FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS hash, round(coalesce(ratio, 0), 6) AS ratio, coalesce(ratio, 0) < 0.04::DOUBLE AS is_scenery
FROM orders LEFT JOIN f ON hash = o_orderkey WHERE o_orderstatus <> 'P'""")
def scenery_split(spark, d):
    """Analysed photos whose largest face is small."""
    photos = table(spark, d, "orders").select(F.col("o_orderkey").alias("hash"), "o_orderstatus")
    faces = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_discount").alias("ratio"))
    found = listing.scenery(photos.select("hash"), faces, photos.where("o_orderstatus <> 'P'"))
    return found.select("hash", F.round("ratio", 6).alias("ratio"), "is_scenery")


@query(_ASSIGN + """, f AS (SELECT DISTINCT vec_id % 60 AS hash FROM embeddings),
w AS (SELECT vec_id % 60 AS hash, list_sort(list(DISTINCT name)) AS p FROM k WHERE kind = 'Person' GROUP BY ALL)
SELECT hash, CASE WHEN p IS NULL THEN 'unclaimed' WHEN len(p) = 1 THEN 'claimed' ELSE 'shared' END AS status,
  CASE WHEN len(p) = 1 AND p[1] <> concat('p', hash % 10) THEN concat(p[1], '/', hash, '.jpg') END AS "to"
FROM f LEFT JOIN w USING (hash)""")
def file_by_person(spark, d):
    """Files with exactly one identified person go to that person's folder."""
    found = identity.identified(_assigned(spark, d)).select((F.col("vec_id") % 60).alias("hash"), "name")
    files = table(spark, d, "embeddings").select((F.col("vec_id") % 60).alias("hash")).distinct()
    files = files.withColumn("path", F.expr("concat('p', hash % 10, '/', hash, '.jpg')"))
    return build.by_person(files, found).select("hash", "status", "to")


_POINTS = """c AS (SELECT c_custkey, 36 + (c_custkey * 37 % 400)::DOUBLE / 100 AS lat, 20 + (c_custkey * 91 % 600)::DOUBLE / 100 AS lon FROM customer),
s AS (SELECT s_suppkey, s_name, 36 + (s_suppkey * 53 % 400)::DOUBLE / 100 AS lat, 20 + (s_suppkey * 71 % 600)::DOUBLE / 100 AS lon FROM supplier)"""
_KM = """2 * 6371.0088::DOUBLE * asin(sqrt(least(1, pow(sin(radians(s.lat - c.lat) / 2), 2)
  + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2))))"""


def _at(key: str, a: int, b: int):
    part = lambda k, n, start: (F.lit(start) + (F.col(key) * k % n).cast("double") / 100)
    return part(a, 400, 36).alias("lat"), part(b, 600, 20).alias("lon")


def _points(spark, d):
    return table(spark, d, "customer").select("c_custkey", *_at("c_custkey", 37, 91))


def _places(spark, d):
    name = F.col("s_name").alias("name")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("place_id"), name, *_at("s_suppkey", 53, 71))


@query(f"""WITH {_POINTS}, x AS (SELECT c_custkey, s_suppkey, s_name, {_KM} AS km FROM c, s),
b AS (SELECT c_custkey, arg_min(s_name, (km, s_suppkey)) AS place, min(km) AS km FROM x WHERE km <= 120 GROUP BY ALL)
SELECT c_custkey, place, round(km, 5) AS km FROM c LEFT JOIN b USING (c_custkey)""")
def nearest_place(spark, d):
    """The nearest place within 120 km of each point."""
    found = place_ops.nearest(_points(spark, d), _places(spark, d), "c_custkey")
    return found.select("c_custkey", F.col("place.name").alias("place"), F.round("km", 5).alias("km"))


@query("""WITH f AS (SELECT p_partkey AS place_id, p_name AS name,
  CASE WHEN lower(p_name) = 'ring' OR lower(p_type) = 'ring' THEN 0 WHEN starts_with(lower(p_name), 'ring') OR starts_with(lower(p_type), 'ring') THEN 1
       WHEN contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring') THEN 2 END AS bucket FROM part),
t AS (SELECT * FROM f WHERE bucket IS NOT NULL ORDER BY place_id LIMIT 81)
SELECT place_id, name, bucket::INTEGER AS bucket FROM t ORDER BY bucket, place_id LIMIT 10""")
def place_search(spark, d):
    """Places by name: exact, then prefix, then anywhere, each by population."""
    found = table(spark, d, "part").select(F.col("p_partkey").alias("place_id"), F.col("p_name").alias("name"), F.col("p_type").alias("ascii"))
    return place_ops.search(found, " Ring ", 10).select("place_id", "name", "bucket")


@query(f"WITH {_POINTS} SELECT count(*) AS checked, count(*) FILTER (lat < 38 AND lat > 36.5) AS found FROM c")
def located(spark, d):
    """How many of the files looked at have coordinates."""
    points = _points(spark, d).withColumn("lat", F.when(F.col("lat") < 38, F.when(F.col("lat") > 36.5, F.col("lat"))).otherwise(F.lit(99.0)))
    return place_ops.located(points)


@query(f"""WITH {_POINTS}, p AS (SELECT lat, lon, (lon + 180) / 360 * 65536 AS x, sin(radians(lat)) AS s FROM c)
SELECT floor(x / 64)::BIGINT AS px, floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 65536 / 64)::BIGINT AS py,
  count(*) AS photos, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM p GROUP BY 1, 2""")
def map_pins(spark, d):
    """Pins of a map at zoom 8."""
    found = place_ops.pins(_points(spark, d), 8)
    return found.select("px", "py", "photos", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_TREE = """t AS (SELECT page_id, regexp_extract(url, '^https?://[^/]*/([^?#]*)', 1) AS path,
  regexp_extract(url, '^https?://([^?#]*)', 1) AS long FROM pages)"""


def _tree(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(url, "^https?://[^/]*/([^?#]*)", 1).alias("path"), F.regexp_extract(url, "^https?://([^?#]*)", 1).alias("long")
    )


@query(f"""WITH {_TREE}, f AS (SELECT regexp_replace(long, '/?[^/]*$', '') AS folder FROM t),
p AS (SELECT folder, string_split(folder, '/') AS s FROM f),
a AS (SELECT folder, unnest(list_concat([''], list_transform(range(1, len(s) + 1), lambda i: array_to_string(s[1:i], '/')))) AS top FROM p WHERE folder <> ''
      UNION ALL SELECT folder, '' FROM p WHERE folder = '')
SELECT top AS folder, count(*) FILTER (folder = top) AS own, count(*) AS total, bool_or(folder <> top) AS has_children,
  CASE WHEN top = '' THEN 0 ELSE len(string_split(top, '/')) END::INTEGER AS depth FROM a GROUP BY top""")
def folder_rollup(spark, d):
    """Files in each folder and in all below it."""
    return tree.rollup(_tree(spark, d).select(paths.folder_of(F.col("long")).alias("folder")))


@query(f"WITH {_TREE} SELECT page_id, path FROM t WHERE starts_with(path, 'en/')")
def folder_filter(spark, d):
    """Files of a folder, by whole segments."""
    return _tree(spark, d).where(paths.in_folder(F.col("path"), "en")).select("page_id", "path")


_META = """u AS (SELECT CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN source ELSE concat(source, '/', lang) END AS folder,
  md5(text) AS hash, max(1 + 4 * quality)::INTEGER AS rating, max(CASE WHEN toxic = 1 THEN 'red' ELSE 'green' END) AS label
  FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2)"""


def _meta(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    third = F.col("doc_id") % 3
    folder = F.when(third == 0, "").when(third == 1, F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))
    return rows.groupBy(folder.alias("folder"), F.md5("text").alias("hash")).agg(
        F.max(1 + 4 * F.col("quality")).cast("int").alias("rating"), F.max(F.when(F.col("toxic") == 1, "red").otherwise("green")).alias("label")
    )


@query(f"""WITH {MEDIA}, {_META}, j AS (
  SELECT m.doc_id, u.rating, u.label, row_number() OVER (PARTITION BY doc_id ORDER BY length(u.folder) DESC) AS r
  FROM m JOIN u ON m.hash = u.hash AND (u.folder = '' OR m.folder = u.folder OR starts_with(m.folder, concat(u.folder, '/'))))
SELECT m.doc_id, coalesce(rating, 0)::INTEGER AS rating, label FROM m LEFT JOIN j ON m.doc_id = j.doc_id AND r = 1""")
def metadata_cascade(spark, d):
    """Each file's metadata: that of the nearest folder that has any."""
    found = tree.cascade(media(spark, d), _meta(spark, d), ["rating", "label"])
    return found.select("doc_id", F.coalesce("rating", F.lit(0)).alias("rating"), "label")


@query(f"WITH {MEDIA} SELECT folder, count(*) AS files FROM m GROUP BY folder")
def status_by_folder(spark, d):
    """Files per folder."""
    return tree.by_folder(media(spark, d))


_ONE_META = "o AS (SELECT hash, max(rating) AS rating, min(label) AS label FROM u GROUP BY hash)"


@query(f"""WITH {MEDIA}, {_META}, {_ONE_META}, f AS (SELECT hash, count(*) AS faces FROM m WHERE doc_id % 3 = 0 GROUP BY hash)
SELECT path, hash, size, kind, taken_at, coalesce(rating, 0)::INTEGER AS rating, label, coalesce(faces, 0) AS faces
FROM m LEFT JOIN o USING (hash) LEFT JOIN f USING (hash)""")
def listing_full(spark, d):
    """The listing: files with their metadata and numbers of faces, newest first."""
    m = media(spark, d)
    meta = _meta(spark, d).groupBy("hash").agg(F.max("rating").alias("rating"), F.min("label").alias("label"))
    faces = m.where("doc_id % 3 = 0").groupBy("hash").agg(F.count("*").alias("faces"))
    signatures = m.select("hash").distinct()
    found = listing.listing(m, signatures, meta, faces)
    return found.select("path", "hash", "size", "kind", "taken_at", "rating", "label", "faces").withColumns(_ntz("taken_at"))


@query(f"WITH {MEDIA} SELECT path, size FROM m ORDER BY size DESC, path LIMIT 50")
def listing_sorted(spark, d):
    """A folder's view by size."""
    return media(spark, d).orderBy(*listing.sort_keys("size")).select("path", "size").limit(50)


@query(f"""WITH {MEDIA}, c AS (SELECT list(hash ORDER BY doc_id) AS o FROM m WHERE doc_id < 5)
SELECT path FROM m, c ORDER BY coalesce(nullif(list_position(o, hash), 0), 9999), taken_at DESC NULLS LAST, path LIMIT 30""")
def listing_custom(spark, d):
    """A view in an order of its own: listed files first, then the newest."""
    m = media(spark, d)
    order = [r[0] for r in m.where("doc_id < 5").orderBy("doc_id").select("hash").collect()]
    return m.orderBy(*listing.sort_keys("custom", order)).select("path").limit(30)


@query(f"WITH {MEDIA} SELECT path, size, kind FROM m WHERE hash = (SELECT md5(text) FROM documents WHERE doc_id = 1) ORDER BY path LIMIT 1")
def photo_detail(spark, d):
    """One content's first file."""
    one = media(spark, d).where("doc_id = 1").select("hash").first()[0]
    return listing.detail(media(spark, d), one).select("path", "size", "kind")


@query("""WITH p AS (SELECT concat('f', doc_id // 10, '/IMG_', doc_id // 5, '.', ['jpg', 'heic', 'cr3', 'mov', 'txt'][doc_id % 5 + 1]) AS path, doc_id FROM documents)
SELECT a.path AS still, b.path AS motion FROM p a JOIN p b ON a.doc_id // 5 = b.doc_id // 5 WHERE a.doc_id % 5 < 3 AND b.doc_id % 5 = 3""")
def live_pairs(spark, d):
    """Stills and the clips that were taken with them."""
    path = F.concat(F.lit("f"), F.expr("doc_id div 10"), F.lit("/IMG_"), F.expr("doc_id div 5"), F.lit("."),
                    F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 5 + 1).cast("int")))
    files = table(spark, d, "documents").select(path.alias("path"))
    return listing.live_pairs(files.withColumn("kind", paths.kind_of(F.col("path"))))


@query(f"""WITH {MEDIA} SELECT path, kind, folder, concat(doc_id, '.', ['jpg', 'heic', 'cr3', 'mov', 'txt'][doc_id % 5 + 1]) AS name,
  doc_id::VARCHAR AS stem, ['jpg', 'heic', 'cr3', 'mov', 'txt'][doc_id % 5 + 1] AS ext, 2::INTEGER AS depth FROM m""")
def kind_classify(spark, d):
    """Kinds of files and the parts of their paths."""
    p = F.col("path")
    return media(spark, d).select(
        "path", paths.kind_of(p).alias("kind"), paths.folder_of(p).alias("folder"), paths.name_of(p).alias("name"),
        paths.stem_of(p).alias("stem"), paths.ext_of(p).alias("ext"), paths.depth_of(paths.folder_of(p)).alias("depth"),
    )


@query(f"""WITH {MEDIA}, p AS (SELECT DISTINCT hash FROM m WHERE kind = 'photo'),
l AS (SELECT DISTINCT md5(text) AS hash FROM documents JOIN labels USING (doc_id)), b AS (SELECT DISTINCT md5(text) AS hash FROM benchmark)
SELECT count(*) AS photos, count(*) FILTER (hash NOT IN (FROM l)) AS faces_missing, bool_or(hash IN (FROM l)) AS faces_started,
  count(*) FILTER (hash NOT IN (FROM b)) AS vectors_missing, bool_or(hash IN (FROM b)) AS vectors_started FROM p""")
def pending_work(spark, d):
    """What is still to be extracted."""
    faces = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.md5("text").alias("hash"))
    done = table(spark, d, "benchmark").select(F.md5("text").alias("hash"))
    return listing.pending(media(spark, d), faces=faces, vectors=done)


@query(f"""WITH {MEDIA} SELECT path FROM m WHERE kind = 'photo'
AND hash NOT IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id)) AND hash NOT IN (SELECT hash FROM m WHERE doc_id % 11 = 0 AND doc_id % 2 = 0)""")
def not_processed(spark, d):
    """Files that lack a result and aren't known as unreadable by this version."""
    m = media(spark, d)
    done = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id"), "doc_id").select(F.md5("text").alias("hash"))
    bad = m.where("doc_id % 11 = 0").select("hash", F.when(F.col("doc_id") % 2 == 0, "now").otherwise("old").alias("version"))
    return listing.missing(m.where("kind = 'photo'"), done, bad, "now").select("path")


_SNAPSHOTS = f"""WITH {MEDIA}, cat AS (SELECT path, hash, size, mtime FROM m WHERE doc_id % 3 <> 0),
disk AS (SELECT CASE WHEN doc_id % 10 = 1 THEN concat('moved/', path) ELSE path END AS path, hash,
                CASE WHEN doc_id % 10 = 2 THEN size + 1 ELSE size END AS size, mtime FROM m WHERE doc_id % 4 <> 0),
gone AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM cat WHERE path NOT IN (SELECT path FROM disk)),
fresh AS (SELECT hash, path, row_number() OVER (PARTITION BY hash ORDER BY path) AS n FROM disk WHERE path NOT IN (SELECT path FROM cat)),
ch AS (
  SELECT d.path, NULL::VARCHAR AS old_path, CASE WHEN d.size = c.size AND d.mtime = c.mtime THEN 'unchanged' ELSE 'hashed' END AS status FROM disk d JOIN cat c USING (path)
  UNION ALL SELECT f.path, g.path, CASE WHEN g.path IS NULL THEN 'added' ELSE 'moved' END FROM fresh f LEFT JOIN gone g USING (hash, n)
  UNION ALL SELECT g.path, NULL, 'removed' FROM gone g LEFT JOIN fresh f USING (hash, n) WHERE f.path IS NULL)"""


def _changes(spark, d):
    m = media(spark, d)
    disk = m.where("doc_id % 4 <> 0").withColumns({
        "path": F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")),
        "size": F.when(F.col("doc_id") % 10 == 2, F.col("size") + 1).otherwise(F.col("size")),
    })
    return catalog.reconcile(m.where("doc_id % 3 <> 0"), disk)


@query(_SNAPSHOTS + " SELECT * FROM ch")
def scan_reconcile(spark, d):
    """What a scan finds against the catalogue: unchanged, changed, moved, added, removed."""
    return _changes(spark, d).select("path", "old_path", "status")


@query(_SNAPSHOTS + " SELECT status, count(*) AS files FROM ch GROUP BY status")
def scan_stats(spark, d):
    """A scan's statistics."""
    return catalog.stats(_changes(spark, d))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS origin FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 0
UNION ALL SELECT doc_id + 1000000, 'new' FROM documents WHERE doc_id % 100 = 0""")
def keyed_merge(spark, d):
    """New rows in place of those with the same key, then rows with new keys."""
    docs = table(spark, d, "documents").select("doc_id")
    old = docs.where("doc_id % 2 = 0").withColumn("origin", F.lit("old"))
    merged = catalog.upsert(old, docs.where("doc_id % 4 = 0").withColumn("origin", F.lit("new")), ["doc_id"])
    more = docs.where("doc_id % 100 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit("new").alias("origin"))
    return catalog.insert_ignore(merged, more.union(docs.where("doc_id % 8 = 0").select("doc_id", F.lit("late"))), ["doc_id"])


@query("""WITH n AS (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS t FROM orders),
f AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(t, 'IMG_%Y%m%d_%H%M%S(0).jpg') WHEN 1 THEN lower(strftime(t, '%I-%M-%S_%p_%d_%b_%Y.jpg'))
  WHEN 2 THEN strftime(t, '%Y02%d-%H%M%S.jpg') ELSE concat('note', o_orderkey) END AS name FROM n),
p AS (SELECT o_orderkey, name, CASE WHEN o_orderkey % 4 = 1 THEN try_strptime(regexp_extract(name, '^(.{23})', 1), '%I-%M-%S_%p_%d_%b_%Y')
  ELSE try_strptime(concat(regexp_extract(name, '(\\d{8})[_-](\\d{6})', 1), regexp_extract(name, '(\\d{8})[_-](\\d{6})', 2)), '%Y%m%d%H%M%S') END AS seen FROM f)
SELECT o_orderkey, name, coalesce(seen, TIMESTAMP '2000-01-01') AS taken_at, CASE WHEN seen IS NULL THEN 'mtime' ELSE 'filename' END AS taken_src FROM p""")
def filename_times(spark, d):
    """Capture times out of file names, and where they come from."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey") % 86400)).alias("t"))
    q = F.col("o_orderkey") % 4
    own = F.concat(times.format_stem(F.col("t"), times.DEFAULT_FORMAT), F.lit(".jpg"))
    name = (
        F.when(q == 0, F.date_format("t", "'IMG_'yyyyMMdd_HHmmss'(0).jpg'"))
        .when(q == 1, own)
        .when(q == 2, F.date_format("t", "yyyy'02'dd-HHmmss'.jpg'"))
        .otherwise(F.concat(F.lit("note"), F.col("o_orderkey").cast("string")))
    )
    rows = o.select("o_orderkey", name.alias("name"))
    at = times.resolve(F.lit(None).cast("timestamp"), F.col("name"), F.lit("2000-01-01").cast("timestamp"))
    rows = rows.withColumn("at", at)
    return rows.select("o_orderkey", "name", F.col("at.taken_at").cast("timestamp_ntz").alias("taken_at"), F.col("at.taken_src").alias("taken_src"))


@query("""WITH f AS (SELECT o_orderkey, concat('Shots/', o_custkey % 7, '/IMG_', o_orderkey, '.jpg') AS path, lower(strftime(o_orderdate, '%I-%M-%S_%p_%d_%b_%Y')) AS base FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY path) AS n FROM f)
SELECT path AS "from", concat(regexp_replace(path, '[^/]*$', ''), base, CASE WHEN n > 1 THEN concat('_', n) ELSE '' END, '.jpg') AS "to" FROM r""")
def rename_plan(spark, d):
    """Files renamed to their capture times, equal ones numbered."""
    o = table(spark, d, "orders")
    path = F.concat(F.lit("Shots/"), F.col("o_custkey") % 7, F.lit("/IMG_"), F.col("o_orderkey"), F.lit(".jpg"))
    files = o.select(F.col("o_orderkey").cast("string").alias("hash"), path.alias("path"), F.col("o_orderdate").cast("timestamp").alias("taken_at"), F.lit(None).cast("timestamp").alias("mtime"))
    return rename.plan(files)[0].select("from", "to")


@query("""SELECT doc_id, CASE WHEN name = '' THEN 'empty' WHEN regexp_matches(name, '["*/:<>?\\\\|]') THEN 'reserved character'
  WHEN regexp_matches(name, '[\\x00-\\x1F]') THEN 'control character' WHEN regexp_matches(name, '[ .]$') THEN 'ends with a space or dot' END AS problem
FROM (SELECT doc_id, concat(left(text, (doc_id % 12)::INTEGER), CASE WHEN doc_id % 9 = 0 THEN ':' WHEN doc_id % 10 = 0 THEN '|' ELSE '' END) AS name FROM documents)""")
def filename_validity(spark, d):
    """Why names can't be used."""
    tail = F.when(F.col("doc_id") % 9 == 0, ":").when(F.col("doc_id") % 10 == 0, "|").otherwise("")
    name = F.concat(F.substring("text", F.lit(1), (F.col("doc_id") % 12).cast("int")), tail)
    return table(spark, d, "documents").select("doc_id", paths.filename_problem(name).alias("problem"))


@query("""WITH a AS (SELECT DISTINCT conv_id AS hash, concat('Trip: ', role, ' ', turn % 3) AS album FROM conversations),
r AS (SELECT *, concat('Trip- ', substr(album, 7)) AS dest, row_number() OVER (PARTITION BY hash ORDER BY album) AS n FROM a)
SELECT hash, concat('Inbox/', hash, '.jpg') AS "from", concat(dest, '/', hash, '.jpg') AS "to" FROM r WHERE n = 1""")
def album_migration(spark, d):
    """Albums as folders; a file goes to the first album that has it."""
    c = table(spark, d, "conversations")
    members = c.select(F.col("conv_id").alias("hash"), F.concat(F.lit("Trip: "), "role", F.lit(" "), (F.col("turn") % 3).cast("string")).alias("album"))
    files = c.select(F.col("conv_id").alias("hash")).distinct().withColumn("path", F.concat(F.lit("Inbox/"), "hash", F.lit(".jpg")))
    return build.albums_to_folders(files, members)[0].select("hash", "from", "to")


_MOVES = f"""WITH {MEDIA}, f AS (SELECT hash, concat('in', doc_id % 3, '/', doc_id % 400, '.jpg') AS path, doc_id FROM m),
s AS (SELECT * FROM f WHERE hash IN (SELECT hash FROM f WHERE doc_id % 2 = 0) AND NOT starts_with(path, 'in1/')),
t AS (SELECT regexp_extract(path, '[^/]*$', 0) AS name FROM f WHERE starts_with(path, 'in1/')),
n AS (SELECT *, regexp_extract(path, '[^/]*$', 0) AS name FROM s)"""


def _moves(spark, d):
    path = F.concat(F.lit("in"), F.col("doc_id") % 3, F.lit("/"), F.col("doc_id") % 400, F.lit(".jpg"))
    files = media(spark, d).withColumn("path", path)
    return files, build.move_into(files, files.where("doc_id % 2 = 0").select("hash"), "/in1/")


@query(_MOVES + """ SELECT path AS "from", concat('in1/', name) AS "to", NULL::VARCHAR AS reason FROM n WHERE name NOT IN (FROM t)
UNION ALL SELECT path, NULL, concat('in1/', name, ' already exists') FROM n WHERE name IN (FROM t)""")
def move_plan(spark, d):
    """A selection moved into a folder; taken names are skipped."""
    ops, skipped = _moves(spark, d)[1]
    none = F.lit(None).cast("string")
    return ops.select("from", "to", none.alias("reason")).union(skipped.select("path", none, "reason"))


@query(_MOVES + """, o AS (SELECT path AS f, concat('in1/', name) AS g FROM n WHERE name NOT IN (FROM t))
SELECT 'duplicate target' AS rule, g AS path FROM o GROUP BY g HAVING count(*) > 1
UNION ALL SELECT 'duplicate source', f FROM o GROUP BY f HAVING count(*) > 1""")
def plan_violations(spark, d):
    """What keeps a plan from being applied."""
    files, (ops, _) = _moves(spark, d)
    folders = files.select(paths.folder_of(F.col("path")).alias("folder")).distinct()
    return build.violations(ops, files, folders)


@query(_MOVES + """ SELECT concat('in1/', name) AS "from", path AS "to" FROM n WHERE name NOT IN (FROM t)""")
def undo_plan(spark, d):
    """The inverse of a plan."""
    return build.undo(_moves(spark, d)[1][0]).select("from", "to")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'undated'
  WHEN o_orderkey % 2 = 0 THEN concat('trip:', isoyear(o_orderdate), '-', lpad(weekofyear(o_orderdate)::VARCHAR, 2, '0'), ':', o_orderpriority)
  ELSE concat('day:', strftime(o_orderdate, '%Y-%m-%d')) END AS id,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Undated' WHEN o_orderkey % 2 = 0 THEN concat('Trip · ', o_orderpriority) ELSE strftime(o_orderdate, '%-d %B') END AS title FROM orders""")
def timeline_batches(spark, d):
    """Captures in trips, days and the undated rest."""
    at = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate").cast("timestamp"))
    place = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", times.batch(at, place).alias("b")).select("o_orderkey", "b.id", "b.title")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS files FROM orders GROUP BY 1")
def month_menu(spark, d):
    """Months with captures."""
    found = listing.months(table(spark, d, "orders").select(F.col("o_orderdate").cast("timestamp").alias("taken_at")))
    return found.withColumns(_ntz("month"))


@query("""WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS events FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    """Bursts of events: an hour of quiet ends one."""
    e = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("event_time"))
    return stream.bursts(e, "1 hour", ["user_id"]).withColumns(_ntz("start", "end"))


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS events FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    """Events by type and six hours."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("event_time"))
    return stream.windows(e, "6 hours", keys=["event_type"]).withColumns(_ntz("start"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '.library' WHEN 1 THEN concat('.cache/', user_id, '.jpg') ELSE concat('u', user_id, '/', event_id, '.jpg') END AS path
FROM events WHERE event_type <> 'view' AND event_id % 4 > 1""")
def event_filter(spark, d):
    """Events worth a rescan."""
    q = F.col("event_id") % 4
    path = F.when(q == 0, ".library").when(q == 1, F.concat(F.lit(".cache/"), "user_id", F.lit(".jpg"))).otherwise(F.concat(F.lit("u"), "user_id", F.lit("/"), "event_id", F.lit(".jpg")))
    kind = F.when(F.col("event_type") == "view", "access").otherwise("modify")
    e = table(spark, d, "events").select("event_id", path.alias("path"), kind.alias("kind"))
    return e.where(stream.interesting(F.col("kind"), F.col("path"))).select("event_id", "path")


@query("SELECT event_type, count(*) AS events, sum((props->>'k')::INTEGER)::BIGINT AS k FROM events GROUP BY 1")
def props_json(spark, d):
    """Tolerant JSON with a schema."""
    e = table(spark, d, "events").select("event_type", F.from_json("props", "k int, missing string").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum("p.k").alias("k"))


@query(f"""WITH {MEDIA}, {_META}, {_ONE_META} SELECT path FROM m LEFT JOIN o USING (hash)
WHERE year(taken_at) = 2023 AND month(taken_at) = 6 AND coalesce(rating, 0) >= 4 AND kind = 'photo' AND contains(lower(path), 'src1')""")
def structured_query(spark, d):
    """A query of the grammar as a filter of the listing."""
    meta = _meta(spark, d).groupBy("hash").agg(F.max("rating").alias("rating"), F.min("label").alias("label"))
    want = grammar.parse_query("june 2023 4stars+ type:photo src1")
    return media(spark, d).join(meta, "hash", "left").where(grammar.predicate(want)).select("path")


@query(f"""WITH {MEDIA} SELECT count(*) FILTER (x AND folder = 'src1/en') AS here, count(*) FILTER (x AND folder <> 'src1/en') AS elsewhere
FROM (SELECT *, kind = 'photo' AND month(taken_at) = 7 AS x FROM m)""")
def matches_elsewhere(spark, d):
    """Matches that the chosen folder hides."""
    want = grammar.parse_query("july type:photo")
    return grammar.elsewhere(media(spark, d), want, paths.in_folder(F.col("path"), "src1/en"))


@query(f"""WITH {_TREE} SELECT count(*) FILTER (NOT contains(path, '/') AND k) AS here, count(*) FILTER (contains(path, '/') AND k AND NOT s) AS below,
  count(DISTINCT CASE WHEN contains(path, '/') AND NOT s THEN split_part(path, '/', 1) END) AS subfolders,
  CASE WHEN bool_or(s) THEN 'fr' ELSE '' END AS excluded
FROM (SELECT path, page_id % 3 > 0 AS k, starts_with(path, 'fr/') AS s FROM t)""")
def survey(spark, d):
    """What a folder holds before it is added."""
    rows = _tree(spark, d).select("path", F.when(F.col("page_id") % 3 > 0, "photo").alias("kind"), F.when(F.col("path").startswith("fr/"), "fr").alias("skipped"))
    return tree.survey(rows).withColumn("excluded", F.array_join("excluded", ","))


@query("""WITH a AS (SELECT conv_id AS hash, unnest([role, concat('t', turn % 4)]) AS album FROM conversations)
SELECT album, count(DISTINCT hash) AS photos FROM a GROUP BY album""")
def album_counts(spark, d):
    """Photos of each album."""
    albums = F.array("role", F.concat(F.lit("t"), (F.col("turn") % 4).cast("string")))
    return listing.album_counts(table(spark, d, "conversations").select(F.col("conv_id").alias("hash"), albums.alias("albums")))


@query("""WITH s AS (SELECT doc_id, concat('a_', doc_id, CASE WHEN doc_id % 2 = 0 THEN concat('_', doc_id % 13) ELSE '' END) AS stem FROM documents)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR doc_id < 1000 THEN regexp_replace(stem, '_[0-9]+$', '') ELSE stem END AS base,
  CASE WHEN doc_id % 2 = 0 THEN doc_id % 13 WHEN doc_id < 1000 THEN doc_id END::INTEGER AS counter FROM s""")
def name_counters(spark, d):
    """Counters at the end of names; four digits are a year."""
    stem = F.concat(F.lit("a_"), "doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("_"), F.col("doc_id") % 13)).otherwise(""))
    return table(spark, d, "documents").select("doc_id", paths.split_counter(stem).alias("s")).select("doc_id", "s.base", "s.counter")


@query("""SELECT doc_id, nullif(regexp_replace(regexp_replace(regexp_replace(translate(left(text, 20), '"*/:<>?\\|', '---------'), '^\\s+|\\s+$', '', 'g'), '^\\.+|\\.+$', '', 'g'), '^\\s+|\\s+$', '', 'g'), '') AS folder,
  CASE WHEN s = '' THEN 'op' ELSE s END AS slug,
  CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B') ELSE printf('%.1f KB', n_chars / 1024.0::DOUBLE) END AS bytes
FROM (SELECT *, regexp_replace(regexp_replace(left(text, 20), '[^A-Za-z0-9_-]', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents)""")
def names_and_labels(spark, d):
    """Folder names, slugs and sizes as text."""
    t = F.substring("text", 1, 20)
    return table(spark, d, "documents").select(
        "doc_id", paths.folder_name(t).alias("folder"), paths.slug(t).alias("slug"), paths.bytes_label(F.col("n_chars")).alias("bytes")
    )


@query("""SELECT n_nationkey, concat_ws(', ', n_name, CASE WHEN n_nationkey % 2 = 0 THEN r_name END, CASE WHEN n_nationkey % 3 > 0 THEN r_name END) AS raw,
  CASE WHEN n_nationkey % 6 = 3 THEN n_name ELSE concat(n_name, ', ', r_name) END AS label FROM nation JOIN region ON n_regionkey = r_regionkey""")
def place_labels(spark, d):
    """Labels of places without empty or repeated parts."""
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    region, country = F.when(k % 2 == 0, F.col("r_name")), F.when(k % 3 > 0, F.col("r_name"))
    return rows.select("n_nationkey", F.concat_ws(", ", "n_name", region, country).alias("raw"), places.place_label(F.col("n_name"), region, country).alias("label"))


@query("""SELECT page_id, CASE WHEN page_id % 5 < 4 THEN concat(regexp_replace(url, '[?#].*$', ''), ':', page_id) ELSE url END AS key,
  CASE WHEN page_id % 5 < 4 THEN regexp_replace(url, '[?#].*$', '') END AS hash, CASE WHEN page_id % 5 < 4 THEN page_id END AS idx FROM pages WHERE NOT regexp_matches(url, ':-?\\d+$')""")
def face_keys(spark, d):
    """Keys of faces put together and split at the last colon."""
    p = table(spark, d, "pages").where(~F.col("url").rlike(r":-?\d+$"))
    bare = F.regexp_replace("url", "[?#].*$", "")
    key = F.when(F.col("page_id") % 5 < 4, paths.face_key(bare, F.col("page_id"))).otherwise(F.col("url"))
    rows = p.select("page_id", key.alias("key"))
    return rows.withColumn("s", paths.split_face_key(F.col("key"))).select("page_id", "key", "s.hash", "s.idx")


@query(f"""WITH {_POINTS}, f AS (SELECT c_custkey, (c_custkey * 7 % 60) AS d, (c_custkey * 11 % 60) AS mi, (c_custkey * 13 % 60) AS s, CASE c_custkey % 4 WHEN 0 THEN 'N' WHEN 1 THEN 'S' WHEN 2 THEN 'E' ELSE 'w' END AS ref FROM c)
SELECT c_custkey, round(CASE WHEN ref IN ('S', 'w') THEN -1 ELSE 1 END * (d + mi / 60.0::DOUBLE + s / 3600.0::DOUBLE), 9) + 0.0::DOUBLE AS degrees FROM f""")
def gps_degrees(spark, d):
    """Degrees, minutes and seconds as decimal degrees."""
    k = F.col("c_custkey")
    ref = F.element_at(F.array(*map(F.lit, "NSEw")), (k % 4 + 1).cast("int"))
    value = places.dms((k * 7 % 60).cast("double"), (k * 11 % 60).cast("double"), (k * 13 % 60).cast("double"), ref)
    return table(spark, d, "customer").select("c_custkey", (F.round(value, 9) + 0.0).alias("degrees"))


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_quantity AS q FROM lineitem WHERE l_orderkey % 50 = 0)
SELECT doc_id, rating::INTEGER AS rating, label FROM (SELECT doc_id, greatest(0, least(5, doc_id % 8)) AS rating,
  CASE WHEN ['red', 'pink', 'blue', 'grey'][doc_id % 4 + 1] <> 'pink' THEN ['red', 'pink', 'blue', 'grey'][doc_id % 4 + 1] END AS label FROM documents)
WHERE rating > 0 OR label IS NOT NULL""")
def metadata_rules(spark, d):
    """Ratings capped, unknown labels dropped, empty records pruned."""
    label = F.element_at(F.array(*map(F.lit, ["red", "pink", "blue", "grey"])), (F.col("doc_id") % 4 + 1).cast("int"))
    meta = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 8).cast("int").alias("rating"), label.alias("label"), F.lit(None).cast("array<string>").alias("albums"))
    return people.clean_meta(meta).select("doc_id", "rating", "label")


@query("""SELECT vec_id AS ref, min(vec_id) AS face FROM embeddings WHERE vec_id % 3 = 0 GROUP BY vec_id
UNION ALL SELECT vec_id, NULL FROM embeddings WHERE vec_id % 3 <> 0""")
def people_pointers(spark, d):
    """References as pointers to the faces that have the very same vector."""
    v = table(spark, d, "embeddings")
    refs = v.select(F.lit("p").alias("name"), F.col("vec_id").alias("ref_idx"), "embedding")
    faces = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("hash"), F.lit(0).alias("idx"), "embedding")
    return people.to_pointers(refs, faces).select(F.col("ref_idx").alias("ref"), F.col("hash").alias("face"))


@query()
def suppressed_boxes(spark, d):
    """Boxes left by non-maximum suppression."""
    boxes = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hash"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_partkey") % 40).cast("double").alias("x"),
        (F.col("l_suppkey") % 40).cast("double").alias("y"), F.lit(30.0).alias("w"), F.lit(30.0).alias("h"), F.col("l_quantity").alias("score"),
    )
    return clustering.suppress(boxes)


@query(f"WITH {MEDIA} SELECT path FROM m WHERE NOT starts_with(path, 'src1/') AND kind = 'photo' AND doc_id % 10 > 0")
def scan_filters(spark, d):
    """Files that a scan takes: known kinds, no sidecars, no skipped folders."""
    m = media(spark, d).withColumn("raw", F.when(F.col("path").startswith("src1/"), F.concat(F.lit("a/LIBRARY/"), "path")).otherwise(
        F.when(F.col("doc_id") % 10 == 0, F.regexp_replace("path", "([^/]*)$", "._$1")).otherwise(F.col("path"))))
    raw = F.col("raw")
    return m.where(~paths.is_skipped(raw) & ~paths.is_sidecar(raw) & (paths.kind_of(raw) == "photo")).select("path")


_PLAN = f"""WITH {MEDIA}, o AS (
  SELECT path AS f, path AS t FROM m WHERE doc_id % 11 = 0
  UNION ALL SELECT path, 'dup/x.jpg' FROM m WHERE doc_id % 11 = 1
  UNION ALL SELECT concat('gone/', doc_id, '.jpg'), concat(folder, '/new-', doc_id, '.jpg') FROM m WHERE doc_id % 11 = 2
  UNION ALL SELECT path, concat(folder, '/a:', doc_id, '.jpg') FROM m WHERE doc_id % 11 = 3
  UNION ALL SELECT a.path, b.path FROM m a JOIN m b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 11 = 4
  UNION ALL SELECT path, concat(folder, '/one-', doc_id, '.jpg') FROM m WHERE doc_id % 11 = 6
  UNION ALL SELECT path, concat(folder, '/two-', doc_id, '.jpg') FROM m WHERE doc_id % 11 = 6
  UNION ALL SELECT path, concat('nowhere/', doc_id, '.jpg') FROM m WHERE doc_id % 11 = 7)"""


@query(_PLAN + """ SELECT 'no-op' AS rule, f AS path FROM o WHERE f = t
UNION ALL SELECT 'duplicate target', t FROM o GROUP BY t HAVING count(*) > 1
UNION ALL SELECT 'duplicate source', f FROM o GROUP BY f HAVING count(*) > 1
UNION ALL SELECT 'bad name', t FROM o WHERE contains(t, ':')
UNION ALL SELECT 'missing source', f FROM o WHERE f NOT IN (SELECT path FROM m)
UNION ALL SELECT 'target exists', t FROM o WHERE t IN (SELECT path FROM m) AND t NOT IN (SELECT f FROM o)
UNION ALL SELECT 'missing parent', t FROM o WHERE regexp_replace(t, '/[^/]*$', '') NOT IN (SELECT folder FROM m)""")
def plan_rules(spark, d):
    """Every rule that keeps a plan from being applied, each broken by some operations."""
    m = media(spark, d)
    kind = F.col("doc_id") % 11
    id_ = F.col("doc_id").cast("string")
    at = lambda n, to, path=F.col("path"): m.where(kind == n).select(path.alias("from"), to.alias("to"))
    beside = lambda prefix: F.concat("folder", F.lit(f"/{prefix}"), id_, F.lit(".jpg"))
    following = m.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("to"))
    parts = [
        at(0, F.col("path")),
        at(1, F.lit("dup/x.jpg")),
        at(2, beside("new-"), F.concat(F.lit("gone/"), id_, F.lit(".jpg"))),
        at(3, beside("a:")),
        m.where(kind == 4).select("doc_id", F.col("path").alias("from")).join(following, "doc_id").select("from", "to"),
        at(6, beside("one-")),
        at(6, beside("two-")),
        at(7, F.concat(F.lit("nowhere/"), id_, F.lit(".jpg"))),
    ]
    ops = parts[0]
    for p in parts[1:]:
        ops = ops.union(p)
    return build.violations(ops, m, m.select("folder").distinct())


@query(f"""WITH {MEDIA} SELECT count(*) FILTER (kind = 'photo') AS photos, count(*) FILTER (kind = 'video') AS videos,
count(*) FILTER (hash IN (SELECT md5(text) FROM documents JOIN labels USING (doc_id))) AS analysed
FROM m WHERE NOT starts_with(path, 'src1/')""")
def library_totals(spark, d):
    """Photos, videos and analysed files of a library, without its trash."""
    m = media(spark, d)
    labelled = m.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return tree.totals(m, labelled, "src1")


@query(f"""WITH {MEDIA} SELECT CASE WHEN taken_at IS NULL THEN 'mtime' ELSE 'exif' END AS taken_src, count(*) AS files,
count(*) FILTER (doc_id % 13 = 0) AS missing FROM m GROUP BY ALL""")
def time_sources(spark, d):
    """Where the files' times come from, and how many of them are gone from disk."""
    m = media(spark, d).withColumn("taken_src", F.when(F.col("taken_at").isNull(), "mtime").otherwise("exif"))
    return tree.time_sources(m, m.where("doc_id % 13 <> 0"))


@query(f"""WITH {MEDIA}, c AS (SELECT DISTINCT hash FROM m WHERE doc_id % 3 = 0)
SELECT 'trash' AS plan, path AS "from", concat('src2/', path) AS "to" FROM m WHERE hash IN (FROM c) AND NOT starts_with(path, 'src2/')
UNION ALL SELECT 'restore', path, substr(path, 6) FROM m WHERE hash IN (FROM c) AND starts_with(path, 'src2/')""")
def trash_and_restore(spark, d):
    """A selection brought to the trash, and what of it lies there brought back."""
    m = media(spark, d)
    chosen = m.where("doc_id % 3 = 0").select("hash")
    plans = {"trash": build.to_trash(m, chosen, "src2"), "restore": build.restore(m, chosen, "src2")}
    trash, back = (ops.select(F.lit(name).alias("plan"), "from", "to") for name, ops in plans.items())
    return trash.union(back)


@query("""WITH b AS (SELECT l_orderkey, l_linenumber AS n, l_quantity AS x, l_tax * 100 AS y, l_extendedprice / 1000 AS w, l_discount * 100 + 1 AS h FROM lineitem),
p AS (SELECT a.l_orderkey, a.n, a.w * a.h AS sa, c.w * c.h AS sc,
  greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS shared
  FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND c.n = a.n + 1)
SELECT l_orderkey, n, round(CASE WHEN sa + sc - shared > 0 THEN shared / (sa + sc - shared) ELSE 0 END, 6) AS overlap FROM p""")
def box_overlap(spark, d):
    """How much each box overlaps the next one of its image."""
    box = F.struct(
        F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"), (F.col("l_extendedprice") / 1000).alias("w"), (F.col("l_discount") * 100 + 1).alias("h")
    )
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), box.alias("a"))
    after = b.select("l_orderkey", (F.col("n") - 1).alias("n"), F.col("a").alias("c"))
    return b.join(after, ["l_orderkey", "n"]).select("l_orderkey", "n", F.round(vectors.iou(F.col("a"), F.col("c")), 6).alias("overlap"))


@query("""WITH h AS (SELECT doc_id, n_chars AS size, CASE doc_id % 5 WHEN 0 THEN concat('bytes=', doc_id % 700, '-', doc_id % 900)
  WHEN 1 THEN concat('bytes=', doc_id % 1500, '-') WHEN 2 THEN concat('bytes=-', doc_id % 3000) WHEN 3 THEN 'bytes=-' ELSE 'items=0-5' END AS header FROM documents),
p AS (SELECT *, regexp_extract(header, '^bytes=(\\d*)-', 1) AS a, regexp_extract(header, '^bytes=\\d*-(\\d*)$', 1) AS b FROM h),
n AS (SELECT *, try_cast(a AS BIGINT) AS x, try_cast(b AS BIGINT) AS y FROM p)
SELECT doc_id, CASE WHEN x IS NOT NULL THEN x ELSE greatest(size - y, 0) END AS first,
CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN least(y, size - 1) ELSE size - 1 END AS last FROM n
WHERE starts_with(header, 'bytes=') AND CASE WHEN x IS NOT NULL THEN x < size AND (y IS NULL OR x <= least(y, size - 1)) ELSE y > 0 AND size > 0 END""")
def byte_ranges(spark, d):
    """Which bytes of a file a request asks for."""
    id_, text = F.col("doc_id"), lambda c: c.cast("string")
    kinds = [
        F.concat(F.lit("bytes="), text(id_ % 700), F.lit("-"), text(id_ % 900)),
        F.concat(F.lit("bytes="), text(id_ % 1500), F.lit("-")),
        F.concat(F.lit("bytes=-"), text(id_ % 3000)),
        F.lit("bytes=-"),
        F.lit("items=0-5"),
    ]
    header = F.element_at(F.array(*kinds), (id_ % 5 + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", paths.byte_range(header, F.col("n_chars")).alias("r"))
    return docs.where("r IS NOT NULL").select("doc_id", F.col("r.start").alias("first"), F.col("r.end").alias("last"))


@query("SELECT l_orderkey AS hash, count(*) AS faces, array_to_string(list_sort(list_distinct(list(l_returnflag))), ',') AS people FROM lineitem GROUP BY 1")
def photo_people(spark, d):
    """How many faces a photo has, and whose."""
    found = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_returnflag").alias("name"))
    return faces.people_of(found).withColumn("people", F.array_join("people", ","))


@query("""WITH n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS n FROM documents)
SELECT doc_id, n_chars FROM n WHERE n % 7 = 0""")
def every_seventh(spark, d):
    """Every seventh file of the whole library, largest first."""
    return listing.every(table(spark, d, "documents").select("doc_id", "n_chars"), 7, F.desc("n_chars"), F.col("doc_id"))


@query("SELECT source AS folder, count(*) AS files, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1")
def stored_bytes(spark, d):
    """What each top folder of a cache takes."""
    return listing.stored(media(spark, d).select("path", "size"))


@query(f"""WITH {MEDIA}, c AS (SELECT hash, path, concat(lang, (doc_id % 50), '.', ext) AS name, concat(lang, (doc_id % 50)) AS stem, ext, doc_id
  FROM (SELECT m.hash, d.lang, m.doc_id, ['jpg', 'heic', 'cr3', 'mov', 'txt'][m.doc_id % 5 + 1] AS ext,
    concat(m.folder, '/', m.doc_id, '/', d.lang, (m.doc_id % 50), '.', ['jpg', 'heic', 'cr3', 'mov', 'txt'][m.doc_id % 5 + 1]) AS path
    FROM m JOIN documents d USING (doc_id))),
k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path) AS k FROM c)
SELECT path AS "from", concat('Originals/', CASE WHEN k = 1 THEN name ELSE concat(stem, '_', k, '.', ext) END) AS "to" FROM k""")
def kept_aside(spark, d):
    """Originals kept aside before their files are rewritten, numbered where names meet."""
    m = media(spark, d).withColumn("lang", F.element_at(F.split("folder", "/"), -1))
    name = F.concat("lang", (F.col("doc_id") % 50).cast("string"), F.lit("."), paths.ext_of(F.col("path")))
    m = m.withColumn("path", F.concat_ws("/", "folder", F.col("doc_id").cast("string"), name))
    return build.keep_aside(m, m.select("path")).select("from", "to")
