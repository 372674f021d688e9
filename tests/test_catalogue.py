"""Cases of single operators that the tables don't hold."""

import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from glassine.functions import paths, places, times, vectors
from glassine.operators import clustering, identity, listing, similarity, tree
from glassine.operators import places as place_ops
from glassine.plans import build, catalog, grammar, journal, people, rename
from glassine.streaming import events


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()[0]


def test_kinds_and_folders(spark):
    df = spark.createDataFrame([("Trip/a.JPG",), ("b.mov",), ("c.txt",), ("x/y/d.CR3",)], ["p"])
    assert [r[0] for r in df.select(paths.kind_of(F.col("p"))).collect()] == ["photo", "video", None, "photo"]
    assert [r[0] for r in df.select(paths.folder_of(F.col("p"))).collect()] == ["Trip", "", "", "x/y"]
    assert one(spark, paths.ancestors(F.lit("a/b/c"))) == ["a/b/c", "a/b", "a", ""]
    assert one(spark, paths.ancestors(F.lit(""))) == [""]
    assert one(spark, paths.in_folder(F.lit("Trip2/x"), "Trip")) is False
    assert one(spark, paths.in_folder(F.lit("Trip"), "Trip")) is False
    assert one(spark, paths.folder_within(F.lit("Trip"), "Trip")) is True
    assert one(spark, paths.is_skipped(F.lit("a/LIBRARY/x.jpg"))) is True
    assert one(spark, paths.is_skipped(F.lit("a/Library.jpg"))) is False


def test_counters_and_labels(spark):
    stems = ["10_2026", "10_2026_2", "x_12", "x_1234", "plain"]
    got = [tuple(one(spark, paths.split_counter(F.lit(s)))) for s in stems]
    assert got == [("10_2026", None), ("10_2026", 2), ("x", 12), ("x_1234", None), ("plain", None)]
    assert one(spark, paths.bytes_label(F.lit(1536))) == "1.5 KB"
    assert one(spark, paths.folder_name(F.lit("Trip: Greece"))) == "Trip- Greece"
    assert one(spark, paths.folder_name(F.lit(" ... "))) is None
    assert one(spark, paths.slug(F.lit("--!"))) == "op"
    assert one(spark, places.place_label(F.lit("Singapore"), F.lit("Singapore"), F.lit("Singapore"))) == "Singapore"
    assert tuple(one(spark, paths.split_face_key(F.lit("a:b:3")))) == ("a:b", 3)


@pytest.mark.parametrize(
    "name,want",
    [
        ("IMG_20260816_151256.jpg", datetime.datetime(2026, 8, 16, 15, 12, 56)),
        ("20260230_120000.jpg", None),
        ("12-28-28_am_18_aug_2026.jpg", datetime.datetime(2026, 8, 18, 0, 28, 28)),
        ("12-01-32_PM_18_AUG_2026.jpg", datetime.datetime(2026, 8, 18, 12, 1, 32)),
        ("13-01-32_pm_18_aug_2026.jpg", None),
        ("holiday.jpg", None),
    ],
)
def test_names_as_times(spark, name, want):
    got = one(spark, times.from_filename(F.lit(name)).cast("timestamp_ntz"))
    assert got == want


def test_patterns(spark):
    at = F.lit(datetime.datetime(2026, 8, 16, 15, 12, 56)).cast("timestamp")
    assert times.java_pattern("%Q") is None
    with pytest.raises(ValueError):
        times.format_stem(at, "%Q")
    assert one(spark, times.format_stem(F.to_timestamp(F.lit("2026-08-16 15:12:56")), times.DEFAULT_FORMAT)) == "03-12-56_pm_16_aug_2026"
    assert one(spark, times.batch(F.to_timestamp(F.lit("2026-08-19")), F.lit("Athens"))["id"]) == "trip:2026-34:Athens"


def test_vectors(spark):
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.unit(zero)) == [0.0, 0.0]
    assert one(spark, vectors.hamming(F.lit(0b1011), F.lit(0b1000))) == 2


def test_places(spark):
    km = one(spark, places.haversine(F.lit(37.98), F.lit(23.72), F.lit(37.99), F.lit(23.72)))
    assert 1.05 < km < 1.15
    rng = random.Random(3)
    table = spark.createDataFrame(
        [(i, f"p{i}", rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(800)]
        + [(900, "fiji", -18.1, 179.9), (901, "pole", 89.9, 10.0)],
        "place_id int, name string, lat double, lon double",
    )
    points = spark.createDataFrame(
        [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(200)] + [(300, -18.1, -179.9), (301, 89.7, -170.0), (302, 0.0, 0.0)],
        "id int, lat double, lon double",
    )
    got = {r["id"]: r["place"]["name"] if r["place"] else None for r in place_ops.nearest(points, table, "id").collect()}
    import math

    def dist(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6371.0088 * math.asin(math.sqrt(min(1, h)))

    ts = table.collect()
    for p in points.collect():
        best = min((dist(p["lat"], p["lon"], t["lat"], t["lon"]), t["place_id"], t["name"]) for t in ts)
        want = best[2] if best[0] <= 120 and p["id"] != 302 else None
        assert got[p["id"]] == want, p
    assert got[300] == "fiji" and got[301]


def test_nearest_place_in_a_crowd_and_on_the_date_line(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(km):
        seen.add(1)
        return km

    rng = random.Random(8)
    spots = [(rng.uniform(36, 37), rng.uniform(20, 21)) for _ in range(400)]
    table = spark.createDataFrame([(i, *spots[i % 400]) for i in range(2000)] + [(5000, -18.1, 180.0), (5001, 60.0, 20.0)], "place_id int, lat double, lon double")
    at = [spots[i % 150] for i in range(1000)] + [(rng.uniform(36, 37), rng.uniform(20, 21)) for _ in range(200)]
    points = spark.createDataFrame(
        [(i, *p) for i, p in enumerate(at)] + [(7000, -18.1, -179.9), (7001, 60.9, 20.0), (7002, None, 20.0), (7003, 10.0, 10.0)],
        "id int, lat double, lon double",
    )
    plain = places.haversine
    monkeypatch.setattr(place_ops, "haversine", lambda *a: counted(plain(*a)))
    got = {r["id"]: r["place"]["place_id"] if r["place"] else None for r in place_ops.nearest(points, table, "id").collect()}
    assert len(got) == 1204 and {i: got[i] for i in range(7000, 7004)} == {7000: 5000, 7001: 5001, 7002: None, 7003: None}
    near = {(r["lat"], r["lon"]): r["p"] for r in points.where("id < 1200").select("lat", "lon").distinct().crossJoin(
        table.where("place_id < 400").toDF("p", "plat", "plon")
    ).groupBy("lat", "lon").agg(F.min_by("p", plain(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon"))).alias("p")).collect()}
    assert all(got[i] == near[p] for i, p in enumerate(at))
    # 1,200 points beside 2,000 places are 2.4 million pairs.
    assert seen.value < 100_000


def test_tree(spark):
    files = spark.createDataFrame([("",), ("Trash",), ("Trash",), ("Day1",), ("Day1/x",)], ["folder"])
    dirs = spark.createDataFrame([("Empty",)], ["folder"])
    got = {r["folder"]: (r["own"], r["total"]) for r in tree.rollup(files, dirs).collect()}
    assert got == {"": (1, 3), "Trash": (2, 2), "Day1": (1, 2), "Day1/x": (1, 1), "Empty": (0, 0)}
    rows = spark.createDataFrame([("h", "Trip/Day3"), ("h", "Trip/Day1"), ("h", "Other")], ["hash", "folder"])
    meta = spark.createDataFrame([("", "h", 1), ("Trip", "h", 3), ("Trip/Day3", "h", 5)], ["folder", "hash", "rating"])
    got = {r["folder"]: r["rating"] for r in tree.cascade(rows, meta, ["rating"]).collect()}
    assert got == {"Trip/Day3": 5, "Trip/Day1": 3, "Other": 1}
    survey = spark.createDataFrame(
        [("root.jpg", "photo", None), ("Trip/in.jpg", "photo", None), ("Trip/n.txt", None, None), ("Library/c.jpg", "photo", "Library")],
        "path string, kind string, skipped string",
    )
    r = tree.survey(survey).first()
    assert (r["here"], r["below"], r["subfolders"], r["excluded"]) == (1, 1, 1, ["Library"])
    assert tree.survey(survey, cap=2).first()["below"] is None


def test_linkage():
    greedy = clustering.greedy_complete_linkage
    assert [len(g) for g in greedy([(0.1, "a", "b"), (0.2, "b", "c")])] == [2]
    assert greedy([(0.1, 1, 2), (0.1, 2, 3), (0.3, 1, 3)]) == [[1, 2, 3]]
    rng = random.Random(1)
    for _ in range(200):
        edges = [(rng.random(), i, j) for i, j in itertools.combinations(range(8), 2) if rng.random() < 0.5]
        known = {(i, j) for _, i, j in edges}
        for g in greedy(edges):
            assert all(p in known for p in itertools.combinations(g, 2))


def test_linkage_by_component(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60), rng.random()) for _ in range(90)]
    edges = [(min(i, j), max(i, j), d) for i, j, d in {(i, j): (i, j, d) for i, j, d in edges if i != j}.values()]
    edges = list({(i, j): (i, j, d) for i, j, d in edges}.values())
    df = spark.createDataFrame(edges, "i long, j long, distance double")
    got = {}
    for r in clustering.complete_linkage(df).collect():
        got.setdefault(r["group_id"], []).append(r["member"])
    want = clustering.greedy_complete_linkage([(d, i, j) for i, j, d in edges])
    assert sorted(map(sorted, got.values())) == sorted(want)


def test_linkage_from_tiles_lists_few_edges(spark, sf, monkeypatch):
    from glassine.operators import linkage

    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 300")
    s = v.select("vec_id", similarity.sign_bits(F.col("embedding")).alias("dhash"), vectors.standardise(F.col("embedding")).alias("norm"))
    # Copies, and a row without features.
    s = s.union(s.where("vec_id < 20").withColumn("vec_id", F.col("vec_id") + 1000)).union(s.where("vec_id = 0").selectExpr("2000L", "null", "null"))
    edges = [(r["distance"], r["i"], r["j"]) for r in similarity.image_pairs(s.dropna(), 28, 1.3, "vec_id").collect()]
    want = clustering.greedy_complete_linkage(edges)
    taken = []
    plain = linkage._ordered
    monkeypatch.setattr(linkage, "_ordered", lambda df: taken.append(df.count()) or plain(df))
    for tile, serial, most in ((5000, 10**6, 0), (100, 300, 0), (90, 0, 0), (120, 0, 10**6)):
        got = {}
        for r in linkage.linked_groups(s, "vec_id", similarity.IMAGE, similarity.images_close(28, 1.3), tile, serial, most).collect():
            got.setdefault(r["group_id"], []).append(r["member"])
        assert sorted(map(sorted, got.values())) == sorted(want) and all(k == min(g) for k, g in got.items())
    assert len(edges) > 2000 and taken[0] == len(edges) and taken[1] <= 300
    assert linkage.linked_groups(s.limit(0), "vec_id", similarity.IMAGE, similarity.images_close(28, 1.3)).count() == 0


def test_near_duplicates_are_grouped_without_a_table_of_edges(spark, sf, monkeypatch):
    from glassine import registry

    monkeypatch.setattr(clustering, "complete_linkage", None)
    monkeypatch.setattr(similarity, "image_pairs", None)
    assert registry.queries()["dedupe_groups"](spark, sf).count() > 0


def test_tiles_equal_brute_force(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 120")
    s = v.select("vec_id", similarity.sign_bits(F.col("embedding")).alias("dhash"), vectors.standardise(F.col("embedding")).alias("norm"))
    key = lambda df: sorted((r[0], r[1], round(r[2], 9)) for r in df.collect())
    want = key(similarity.image_pairs_brute(s, 28, 1.3, "vec_id"))
    assert want
    for tile in (1000, 50, 17):
        assert key(similarity.image_pairs(s, 28, 1.3, "vec_id", tile=tile)) == want


def test_keeper_of_equals_is_the_last_path(spark):
    rows = spark.createDataFrame([("g", "a.jpg", 1.0), ("g", "b.jpg", 1.0)], ["group_id", "path", "sharpness"])
    assert [r["path"] for r in listing.keepers(rows).where("is_keep").collect()] == ["b.jpg"]


def test_assignment(spark):
    refs = spark.createDataFrame(
        [("ann", 0, [1.0, 0.0, 0.0]), ("ann", 0, [0.0, 1.0, 0.0]), ("bob", 1, [0.0, 0.0, 1.0])], ["name", "ord", "embedding"]
    )
    faces = spark.createDataFrame([(1, [0.0, 1.0, 0.0]), (2, [0.7, 0.0, 0.7]), (3, [-1.0, 0.0, 0.0])], ["id", "embedding"])
    kinds = {r["id"]: (r["kind"], r["name"]) for r in identity.assign(faces, refs, ["id"]).collect()}
    assert kinds[1] == ("Person", "ann") and kinds[2][0] == "Ambiguous" and kinds[3][0] == "Unknown"
    alone = identity.assign(faces, refs.where("name = 'ann'"), ["id"]).where("id = 2").first()
    assert alone["kind"] == "Person"
    none = identity.assign(faces, refs.limit(0), ["id"]).first()
    assert (none["kind"], none["similarity"]) == ("Unknown", 0.0)
    found = identity.assign(faces, refs, ["id"]).withColumn("hash", F.col("id"))
    excluded = spark.createDataFrame([("ann", 1)], ["name", "hash"])
    assert identity.identified(found, excluded).count() == 0


def test_suppression(spark):
    boxes = [("h", 0, 0.0, 0.0, 10.0, 10.0, 0.9), ("h", 1, 1.0, 1.0, 10.0, 10.0, 0.8), ("h", 2, 20.0, 20.0, 5.0, 5.0, 0.7)]
    df = spark.createDataFrame(boxes, "hash string, idx int, x double, y double, w double, h double, score double")
    assert sorted(r["idx"] for r in clustering.suppress(df).collect()) == [0, 2]


def test_suppression_takes_many_images_at_once(spark):
    rng = random.Random(6)
    rows = [(f"h{h}", i, rng.uniform(0, 50), rng.uniform(0, 50), 20.0, 20.0, rng.choice([0.5, rng.random()])) for h in range(60) for i in range(h % 9)]
    rows += [("long", i, rng.uniform(0, 2000), rng.uniform(0, 90), 20.0, 20.0, rng.random()) for i in range(700)]
    rows += [(None, 0, 0.0, 0.0, 9.0, 9.0, 0.1), (None, 1, 1.0, 1.0, 9.0, 9.0, None), ("same", 0, 5.0, 0.0, 9.0, 9.0, 1.0), ("same", 0, 4.0, 0.0, 9.0, 9.0, 1.0)]
    want = set()
    for h in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == h), key=lambda r: (-(r[6] or 0), *r[1:6])):
            def over(k):
                w, t = (max(0.0, min(r[a] + r[a + 2], k[a] + k[a + 2]) - max(r[a], k[a])) for a in (2, 3))
                return w * t / (r[4] * r[5] + k[4] * k[5] - w * t) > 0.3
            if not any(map(over, kept)):
                kept.append(r)
        want |= set(kept)
    df = spark.createDataFrame(rows, "hash string, idx int, x double, y double, w double, h double, score double")
    key, n = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in ("10000", "7"):
            spark.conf.set(key, size)
            found = clustering.suppress(df)
            assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    finally:
        spark.conf.set(key, n)
    # One call of Python for each image is what took the time.
    assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_top_k_of_nothing(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet")
    assert similarity.top_k(v, [], 0.1, 5, "vec_id").count() == 0


FILES = "hash string, path string"


def test_rename_is_idempotent(spark):
    at = datetime.datetime(2026, 8, 16, 15, 12, 56)
    names = ["A/20260816_151256.jpg", "B/20260816_151256.jpg", "C/20260816_151256.jpg", "D/x.PNG"]
    files = spark.createDataFrame([(f"h{i}", n, at, at) for i, n in enumerate(names)], FILES + ", taken_at timestamp, mtime timestamp")
    ops, skipped = rename.plan(files)
    got = {r["from"]: r["to"] for r in ops.collect()}
    assert len(set(v.rsplit("/", 1)[1] for v in got.values())) == 4 and skipped.count() == 0
    assert got["A/20260816_151256.jpg"].endswith("_aug_2026.jpg") and got["B/20260816_151256.jpg"].endswith("_2026_2.jpg")
    again = catalog.repath(files, ops)
    assert rename.plan(again)[0].count() == 0
    numbered = {r["from"]: r["to"] for r in rename.plan(files, "trip_%%n")[0].collect()}
    assert numbered["A/20260816_151256.jpg"] == "A/trip_1.jpg" and numbered["D/x.PNG"] == "D/trip_4.png"


def test_move_validate_undo(spark):
    files = spark.createDataFrame([("a", "x/a.jpg"), ("b", "y/b.jpg"), ("c", "Trip/c.jpg"), ("d", "z/c.jpg")], FILES)
    hashes = spark.createDataFrame([("b",), ("c",), ("d",)], ["hash"])
    ops, skipped = build.move_into(files, hashes, " Trip/ ")
    assert [tuple(r) for r in ops.select("from", "to").collect()] == [("y/b.jpg", "Trip/b.jpg")]
    assert [r["path"] for r in skipped.collect()] == ["z/c.jpg"]
    with pytest.raises(ValueError):
        build.move_into(files, hashes, " / ")
    with pytest.raises(ValueError):
        build.move_into(files, hashes, "a:b")
    dirs = spark.createDataFrame([("Trip",), ("x",), ("y",), ("z",)], ["folder"])
    meta = spark.createDataFrame([("y", "b", 4)], ["folder", "hash", "rating"])
    now, moved = journal.apply(files, meta, ops, dirs)
    assert moved.first()["folder"] == "Trip"
    log = journal.record(ops, "move 1 to Trip", datetime.datetime(2026, 8, 19, 12))
    assert log.first()["id"] == "20260819120000-move-1-to-Trip"
    back = journal.undo_entry(now, log)
    assert catalog.repath(now, back).exceptAll(files).count() == 0
    with pytest.raises(ValueError):
        journal.undo_entry(files, log)
    bad = spark.createDataFrame(
        [("move", "a", "x/a.jpg", "x/a.jpg"), ("move", "b", "y/b.jpg", "Trip/c.jpg"), ("move", "q", "no/q.jpg", "far/q.jpg"), ("move", "d", "z/c.jpg", "z/d.")],
        "kind string, hash string, `from` string, `to` string",
    )
    rules = {r["rule"] for r in build.violations(bad, files, dirs).collect()}
    assert rules == {"no-op", "target exists", "missing source", "missing parent", "bad name"}
    with pytest.raises(ValueError):
        journal.apply(files, meta, bad, dirs)


def test_scan_moves(spark):
    at = datetime.datetime(2026, 1, 1)
    row = FILES + ", size long, mtime timestamp"
    was = spark.createDataFrame([("1", "P/a.jpg", 1, at), ("2", "P/b.jpg", 1, at), ("3", "gone.jpg", 1, at)], row)
    now = spark.createDataFrame([("1", "Alex/a.jpg", 1, at), ("2", "Alex/b.jpg", 1, at), ("4", "new.jpg", 1, at)], row)
    got = {r["status"]: r["files"] for r in catalog.stats(catalog.reconcile(was, now)).collect()}
    assert got == {"moved": 2, "removed": 1, "added": 1}
    same = {r["status"] for r in catalog.stats(catalog.reconcile(now, now)).collect()}
    assert same == {"unchanged"}


def test_versions(spark, tmp_path):
    v = catalog.Versions(spark, str(tmp_path / "files"))
    assert v.current() is None and v.read() is None
    v.write(spark.range(3))
    held = v.read()
    v.write(spark.range(5))
    assert (held.count(), v.read().count(), v.current()) == (3, 5, 2)


def test_people(spark):
    refs = spark.createDataFrame([("Ann", 0, [1.0]), ("Bob", 0, [2.0]), ("Bob", 1, [2.0])], ["name", "ref_idx", "embedding"])
    none = spark.createDataFrame([("Bob", "h")], ["name", "hash"])
    merged, excluded = people.merge(refs, none, "Bob", "Ann")
    assert merged.where("name = 'Ann'").count() == 3 and excluded.first()["name"] == "Ann"
    with pytest.raises(ValueError):
        people.merge(refs, none, "ann", "Ann")
    faces = spark.createDataFrame([("h", 0, [2.0]), ("h", 1, [3.0])], ["hash", "idx", "embedding"])
    got = people.to_pointers(refs, faces)
    assert got.where("hash IS NOT NULL").count() == 1
    back = people.from_pointers(got.withColumn("embedding", F.when(F.col("hash").isNull(), F.col("embedding"))), faces)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, refs.collect()))
    meta = spark.createDataFrame([("", "h", 9, "pink", ["x"])], "folder string, hash string, rating int, label string, albums array<string>")
    r = people.clean_meta(meta).first()
    assert (r["rating"], r["label"]) == (5, None)
    hashes = spark.createDataFrame([("h",)], ["hash"])
    assert people.set_album(meta, hashes, "y", True).first()["albums"] == ["x", "y"]
    assert people.set_album(meta, hashes, "x", False).first()["albums"] == []


def test_stream_of_bursts(spark, tmp_path):
    at = datetime.datetime(2026, 1, 1)
    ms = lambda n: at + datetime.timedelta(milliseconds=n)
    rows = [("a.jpg", "create", ms(0)), ("b.jpg", "create", ms(600)), ("c.jpg", "create", ms(1301)), (".library", "create", ms(1400)), ("d.jpg", "access", ms(1500))]
    df = spark.createDataFrame(rows, "path string, kind string, event_time timestamp")
    good = df.where(events.interesting(F.col("kind"), F.col("path")))
    assert sorted(r["events"] for r in events.bursts(good).collect()) == [1, 2]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    seen, said = [], []
    q = events.on_changes(stream, lambda p: seen.append(sorted(r[0] for r in p.collect())) or 3, str(tmp_path / "cp"), said.append)
    q.awaitTermination(60)
    assert seen == [["a.jpg", "b.jpg", "c.jpg"]] and said == [3]


def test_progress():
    said = []
    tick = events.progress(1000, lambda a, b: said.append(a))
    for _ in range(1000):
        tick()
    assert said[-1] == 1000 and len(said) <= 102 and said == sorted(said)


def test_grammar():
    g = grammar
    assert [g.verb_of(w) for w in ("move", "Move", "chuck", "bin", "photos")] == ["move", "move", "delete", "delete", None]
    assert [g.nearest_verb(w) for w in ("mov", "delet", "mvoe", "dlete", "movie")] == ["move", "delete", "move", "delete", "move"]
    assert [g.nearest_verb(w) for w in ("photos", "august", "mountains")] == [None] * 3
    c = g.parse_clause("move my august photos to Trip")
    assert (c.verb, c.rest, c.target) == ("move", "august photos", "Trip")
    assert g.parse_clause("move august to Trip/Greece Day3").target == "Trip/Greece Day3"
    c = g.parse_clause("move photos in august to Trip")
    assert (c.target, c.rest) == ("Trip", "photos in august")
    assert g.parse_clause("photos of a dog") is None and not g.is_command("movie night photos")
    c = g.parse_clause("rate them 5 stars")
    assert (c.value, c.referent, c.rest) == (5, "them", "")
    c = g.parse_clause("rate the august photos 4 stars")
    assert (c.value, c.rest) == (4, "august photos")
    c = g.parse_clause("label the greece photos blue")
    assert (c.value, c.rest) == ("blue", "greece photos")
    assert g.parse_clause("label them red").referent == "them"
    c = g.parse_clause("move them to Trip")
    assert (c.referent, c.target, c.empty) == ("them", "Trip", False)
    assert g.split_clauses("move a to X and move b to Y") == ["move a to X", "move b to Y"]
    assert g.split_clauses("show august then rate them 5 stars") == ["show august", "rate them 5 stars"]
    c = g.parse_clause("move to Trip")
    assert (c.rest, c.empty, c.referent) == ("", True, None)
    with pytest.raises(g.NeedsSlot):
        g.check(c)
    q = g.parse_query("august 2026 4stars+")
    assert (q.month, q.year, q.min_rating, q.text) == (8, 2026, 4, "")
    assert g.parse_query("red").label == "red" and g.parse_query("red car").text == "red car"
    assert g.parse_query("ann lee beach", ["Ann", "Ann Lee"]).people == ["Ann Lee"]
    assert [g.strip_filler(t) for t in ("all my august photos", "the beach", "all of them")] == ["august photos", "beach", "them"]
    c = g.parse_clause("delete all of them")
    assert (c.referent, c.rest) == ("them", "")


def test_every_image_has_its_boxes_suppressed(spark, sf):
    from glassine import registry

    got = {r[0] for r in registry.queries()["suppressed_boxes"](spark, sf).select("hash").distinct().collect()}
    assert got == {r[0] for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey").distinct().collect()}


def test_names_dealt_natively_equal_those_dealt_one_by_one(spark):
    import random

    from glassine.plans import rename

    rng = random.Random(5)
    todo, taken = [], []
    for f in range(40):
        base, ext = f"b{f}", rng.choice(["jpg", "mov"])
        todo += [(base, ext, f"h{f}-{i}", f"d{rng.randrange(9)}/p{f}-{i}.jpg", f"p{f}-{i}.jpg") for i in range(rng.randrange(1, 12))]
        numbers = rng.sample(range(1, 16), rng.randrange(0, 9))
        taken += [(base, ext, n, f"{base}.{ext}" if n == 1 else f"{base}_{n}.{ext}") for n in numbers]
    todo = spark.createDataFrame(todo, "base string, ext string, hash string, path string, name string")
    taken = spark.createDataFrame(taken, "base string, ext string, number long, held string")
    one, two = (sorted(map(tuple, f(todo, taken).collect())) for f in (rename._numbered_names, rename._names_one_by_one))
    assert one == two


def test_numbers_over_a_whole_scope(spark):
    from glassine.scratch import numbered

    df = spark.range(0, 1000, numPartitions=7).selectExpr("id", "hash(id) AS h")
    got = [r["n"] for r in numbered(df, "n", "h", "id").orderBy("h", "id").collect()]
    assert got == list(range(1000))
    assert numbered(df.limit(0), "n", "h").count() == 0


def test_thumbnails_of_a_thousand_pixels(spark):
    import numpy as np

    from glassine.functions import vectors

    thumbs = np.random.default_rng(1).integers(0, 256, (40, 1024)).astype(float)
    thumbs[3] = 9.0
    df = spark.createDataFrame([(i, t.tolist()) for i, t in enumerate(thumbs)], "i long, thumb array<float>")
    for r in df.select("i", vectors.standardise(F.col("thumb")).alias("n")).collect():
        t = thumbs[r["i"]]
        assert np.allclose(r["n"], (t - t.mean()) / max(t.std(), 1e-6))


def test_best_two_people_with_and_without_a_join(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    vectors = [(f"h{i}", i % 3, rng.normal(size=8).tolist()) for i in range(60)] + [("null", 0, None)]
    faces = spark.createDataFrame(vectors, "hash string, idx long, embedding array<double>")
    refs = spark.createDataFrame([(f"p{i % 5}", i % 5, rng.normal(size=8).tolist()) for i in range(17)], "name string, ord long, embedding array<double>")
    few = {(r["hash"], r["idx"]): r for r in identity.two_best(faces, refs.collect(), ["hash", "idx"]).collect()}
    for r in identity._joined(faces.where("embedding IS NOT NULL"), refs, ["hash", "idx"]).collect():
        other = few[r["hash"], r["idx"]]
        assert (r["name"], r["runner_up"]) == (other["name"], other["runner_up"])
        assert abs(r["similarity"] - other["similarity"]) < 1e-9 and abs(r["runner_up_sim"] - other["runner_up_sim"]) < 1e-9
    assert few["null", 0]["name"] is None and len(few) == 61
    assert {r["kind"] for r in identity.assign(faces, refs.limit(0), ["hash", "idx"]).collect()} == {"Unknown"}
