"""Writers, edits, faces, journals, caches and streams of files, against plain versions or fixed values."""

import datetime
import hashlib
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_sources import jpeg, tiff

from glassine.functions.paths import byte_range
from glassine.operators import faces, listing
from glassine.plans import build, catalog, journal
from glassine.sources import exif, files, pixels
from glassine.streaming import events

AT = datetime.datetime(2024, 2, 29, 23, 59, 58)


@pytest.mark.parametrize("order", "<>")
def test_time_and_place_written(order):
    before = jpeg(tiff(order))
    after = exif.rewritten(before, AT, (-33.9999999, 151.5))
    got, was = exif.describe(after), exif.describe(before)
    assert got["taken_at"] == AT and got["lat"] == pytest.approx(-33.9999999, abs=1e-7) and got["lon"] == 151.5
    assert {k: got[k] for k in ("camera", "iso", "make")} == {k: was[k] for k in ("camera", "iso", "make")}
    assert after.endswith(before[-20:])
    one = exif.describe(exif.rewritten(before, AT))
    assert one["taken_at"] == AT and one["lat"] == was["lat"]
    bare = exif.describe(exif.rewritten(jpeg(), place=(0.5, -0.25)))
    assert (bare["lat"], bare["lon"]) == (0.5, -0.25) and bare["taken_at"] is None


@pytest.mark.parametrize("data, place", [(b"\x89PNG", (1, 1)), (jpeg(), (95.0, 1.0)), (jpeg(b"II*\0junk"), (1.0, 1.0)), (jpeg(tiff() + bytes(65100)), (1.0, 1.0))])
def test_what_cannot_be_written_is_refused(data, place):
    with pytest.raises(ValueError):
        exif.rewritten(data, AT, place)


def test_written_files(spark):
    rows = [("a", jpeg(tiff()), AT, None, None), ("b", b"GIF", AT, 1.0, 2.0), ("c", jpeg(), None, None, None), ("d", None, AT, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "path string, content binary, new_taken_at timestamp, new_lat double, new_lon double")
    got = {r["path"]: r for r in exif.write(df).collect()}
    assert exif.describe(bytes(got["a"]["content"]))["taken_at"] == AT and got["a"]["problem"] is None
    assert bytes(got["b"]["content"]) == b"GIF" and "JPEG" in got["b"]["problem"]
    assert bytes(got["c"]["content"]) == jpeg() and got["d"]["content"] is None


def test_metadata_for_people():
    got = exif.shown(jpeg(tiff()))
    assert got == {"camera": "Canon EOS", "iso": "400", "gps": "37 deg 58 min 30 sec N, 23 deg 43 min 12 sec E"}
    assert exif.shown(b"") == {}


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body) + 8) + kind + body


def test_previews_in_boxes():
    large, small = jpeg(size=(6000, 4000), pad=2000), jpeg(size=(1620, 1080), pad=100)
    ftyp = box(b"ftyp", b"crx ")

    def whole(at: int) -> bytes:
        stbl = box(b"stsz", struct.pack(">4I", 0, 0, 1, len(large))) + box(b"co64", struct.pack(">IIQ", 0, 1, at))
        trak = box(b"trak", box(b"mdia", box(b"minf", box(b"stbl", stbl))))
        named = box(b"uuid", bytes(16) + box(b"CMT1", tiff()) + box(b"PRVW", bytes(16) + small))
        return ftyp + box(b"moov", named + trak) + box(b"mdat", large)

    raw = whole(0)
    raw = whole(len(raw) - len(large))
    assert exif.preview(raw) == large
    assert exif.describe(raw)["iso"] == 400
    assert exif.preview(raw[:-1500]) == small + b""
    assert exif.preview(ftyp + struct.pack(">I", 99) + b"moov") is None
    inner = jpeg(tiff(), size=(1920, 1280))
    raf = b"FUJIFILMCCD-RAW" + bytes(69) + struct.pack(">II", 92, len(inner)) + inner
    assert exif.preview(raf) == inner and exif.describe(raf)["iso"] == 400


def test_preview_of_a_jpeg_and_its_size():
    small = jpeg(size=(640, 480))
    assert exif.embedded(jpeg(tiff() + small, size=(4000, 3000)), 600) == small
    assert exif.embedded(jpeg(tiff() + small, size=(4000, 3000)), 700) is None
    assert exif.embedded(jpeg(tiff() + small, size=(4000, 2000)), 600) is None
    assert exif.embedded(jpeg(tiff()), 1) is None and exif.embedded(b"", 1) is None
    turned = exif.rewritten_block(None)
    main = struct.pack("<H", 1) + struct.pack("<HHII", 0x0112, 3, 1, 6) + bytes(4)
    assert turned[:4] == b"II*\0" and exif.dimensions(jpeg(b"II*\0" + struct.pack("<I", 8) + main, size=(40, 30))) == (30, 40)
    assert exif.dimensions(pixels.png(np.zeros((3, 5, 3), np.uint8))) == (5, 3) and exif.dimensions(b"x") is None


def test_edits():
    rgb = np.arange(4 * 6 * 3, dtype=np.uint8).reshape(4, 6, 3)
    assert (pixels.edited(rgb, pixels.Edit(turns=1))[0, -1] == rgb[0, 0]).all()
    assert (pixels.edited(rgb, pixels.Edit(flip_h=True, flip_v=True)) == rgb[::-1, ::-1]).all()
    cut = pixels.edited(rgb, pixels.Edit(turns=1, crop=(0.5, 0.0, 1.0, 0.5)))
    assert (cut == np.rot90(rgb, -1)[:3, 2:]).all()
    gray = pixels.toned(rgb, *pixels.preset(" mono "))
    assert (gray[..., 0] == gray[..., 1]).all() and pixels.preset("none") is None
    # One pixel by hand: (100 - 128) * 1.1 ** 2 + 128 + 10.
    assert pixels.toned(np.full((1, 1, 3), 100, np.uint8), 0.1, 0.1, 0.0)[0, 0].tolist() == [104] * 3
    flat = np.full((60, 90, 3), 77, np.uint8)
    level = pixels.straightened(flat, 10)
    assert (level == 77).all() and abs(level.shape[1] / level.shape[0] - 1.5) < 0.05
    assert pixels.zoom(90, 60, 0) == 1 and pixels.zoom(90, 60, 10) == pytest.approx(90 / level.shape[1], rel=0.03)
    assert pixels.straightened(rgb, 0.0).tolist() == rgb.tolist()
    with pytest.raises(ValueError):
        pixels.edited(rgb, pixels.Edit(straighten=0.001, turns=4))


def test_sizes():
    flat = np.full((30, 50, 3), 9, np.uint8)
    for kernel in (pixels.triangle, pixels.catmull_rom):
        assert (pixels.scaled(flat, 7, 13, kernel) == 9).all()
    assert pixels.within(flat, 25).shape == (15, 25, 3) and pixels.within(flat, 100) is flat
    ramp = np.repeat(np.arange(0, 200, 10, dtype=np.uint8)[None, :, None], 3, 2)
    assert (np.diff(pixels.scaled(ramp, 1, 10).astype(int)[0, :, 0]) > 0).all()


def images(spark, tmp_path, *pictures):
    for name, rgb in pictures:
        (tmp_path / f"{name}.png").write_bytes(pixels.png(rgb))
    df = spark.read.format("image").load(f"file://{tmp_path}/*.png").select("image.*")
    return df.withColumn("hash", F.regexp_extract("origin", r"([^/]*)\.png$", 1))


def test_files_of_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for h, w in ((40, 60), (20, 20)))
    shown = images(spark, tmp_path, ("aa", a), ("bb", b))
    made = pixels.renditions(shown.union(shown), 30)
    got = {r["hash"]: r for r in made.collect()}
    assert bytes(got["bb"]["png"]) == pixels.png(b) and bytes(got["aa"]["png"]) == pixels.png(pixels.within(a, 30))
    assert (got["aa"]["width"], got["aa"]["height"]) == (30, 20)
    out = tmp_path / "thumbs x"
    assert {r["hash"] for r in pixels.store(made, out.as_uri()).collect()} == {"aa", "bb"}
    assert (out / "bb" / "bb.png").read_bytes() == pixels.png(b) and len([p for p in out.rglob("*") if p.is_file()]) == 2
    edit = pixels.Edit(turns=2)
    done = {r["hash"]: r for r in pixels.apply(shown, edit).collect()}
    assert bytes(done["aa"]["png"]) == pixels.png(a[::-1, ::-1])
    assert done["bb"]["new_hash"] == hashlib.sha256(pixels.png(b[::-1, ::-1])).hexdigest()
    with pytest.raises(ValueError):
        pixels.apply(shown, pixels.Edit())
    boxes = spark.createDataFrame([("aa", 0, 10.0, 10.0, 8.0, 8.0), ("aa", 1, 55.0, 35.0, 9.0, 9.0)], "hash string, idx int, x double, y double, w double, h double")
    crops = pixels.face_crops(shown, boxes, 16).collect()
    assert sorted(r["idx"] for r in crops) == [0, 1] and all(exif.dimensions(bytes(r["png"])) == (16, 16) for r in crops)


def test_similarity_and_alignment():
    turn = np.array([[0.0, -2.0], [2.0, 0.0]])
    source = faces.TEMPLATE @ turn.T + [5, 7]
    matrix = faces.similarity(source, faces.TEMPLATE)
    assert np.allclose(source @ matrix[:, :2].T + matrix[:, 2], faces.TEMPLATE)
    # The least squares of the four unknowns, solved in general.
    noisy = source + np.random.default_rng(2).normal(size=(5, 2))
    rows = [r for x, y in noisy for r in ([x, -y, 1, 0], [y, x, 0, 1])]
    a, b, tx, ty = np.linalg.lstsq(np.array(rows), faces.TEMPLATE.ravel(), rcond=None)[0]
    assert np.allclose(faces.similarity(noisy, faces.TEMPLATE), [[a, -b, tx], [b, a, ty]])
    assert faces.similarity(np.ones((5, 2)), faces.TEMPLATE).tolist() == [[1, 0, 0], [0, 1, 0]]
    rgb = np.random.default_rng(3).integers(0, 256, (130, 140, 3), dtype=np.uint8)
    assert (faces.align(rgb, faces.TEMPLATE + [10, 4]) == rgb[4:116, 10:122]).all()


def outputs(h, w, hits):
    """A detector's outputs with faces (stride, row, column, score, side)."""
    out = {}
    for s in faces.STRIDES:
        n = (h // s) * (w // s)
        out |= {f"cls_{s}": np.zeros(n), f"obj_{s}": np.ones(n), f"bbox_{s}": np.zeros((n, 4)), f"kps_{s}": np.zeros((n, 10))}
    for s, r, c, score, side in hits:
        i = r * (w // s) + c
        out[f"cls_{s}"][i] = score**2
        out[f"bbox_{s}"][i] = [0.5, 0.5, np.log(side / s), np.log(side / s)]
        out[f"kps_{s}"][i] = np.tile([1.0, 2.0], 5)
    return out


def test_detector_outputs():
    found = faces.decode(outputs(96, 64, [(8, 2, 3, 0.9, 30), (8, 2, 4, 0.8, 30), (32, 2, 1, 0.95, 20), (16, 0, 0, 0.5, 9)]), 96, 64)
    assert [round(f["score"], 6) for f in found] == [0.95, 0.9]
    assert (found[1]["x"], found[1]["y"], found[1]["w"]) == pytest.approx((28 - 15, 20 - 15, 30))
    assert found[0]["landmarks"][0].tolist() == [64, 128]
    planes = faces.detector_input(np.arange(3, dtype=np.uint8).reshape(1, 1, 3))
    assert planes.shape == (1, 3, 32, 32) and planes[0, :, 0, 0].tolist() == [2, 1, 0] and planes.sum() == 3
    middle = faces.clip_input(np.full((300, 700, 3), 51, np.uint8))
    assert middle.shape == (1, 3, 256, 256) and np.allclose(middle, 0.2)
    assert faces.clip_tokens([5] * 90).shape == (1, 77) and faces.clip_tokens([5]).sum() == 5


def test_faces_extracted(spark, tmp_path):
    shown = images(spark, tmp_path, ("a", np.zeros((100, 200, 3), np.uint8)))

    # The picture, 200 x 100, goes in as 224 x 128.
    made = outputs(128, 224, [(8, 5, 8, 0.9, 60), (8, 0, 20, 0.8, 60), (8, 9, 15, 0.8, 20)])

    def load():
        return lambda planes: made, lambda face: np.array([3.0, 4.0])

    got = sorted(faces.extract(shown, load).collect(), key=lambda r: r["idx"])
    # The second one begins above the picture; the third is too narrow for a vector.
    assert [(r["w"], r["ratio"]) for r in got] == [pytest.approx((60, 0.3)), pytest.approx((20, 0.1))]
    assert got[0]["embedding"] == pytest.approx([0.6, 0.8]) and got[1]["embedding"] is None
    found = spark.createDataFrame([("a", 0, [1.0]), ("a", 1, [1.0]), ("b", 0, [1.0]), ("b", 1, None)], "hash string, idx int, embedding array<float>")
    assigned = spark.createDataFrame([("a", 0, "Person"), ("a", 1, "Unknown")], "hash string, idx int, kind string")
    dismissed = spark.createDataFrame([("b", 0)], "hash string, idx int")
    assert [(r["hash"], r["idx"]) for r in faces.unassigned(found, assigned, dismissed).collect()] == [("a", 1)]


@pytest.mark.parametrize(
    "header, want",
    [("bytes=0-9", (0, 9)), ("bytes=90-200", (90, 99)), ("bytes=5-", (5, 99)), ("bytes=-30", (70, 99)), ("bytes=-500", (0, 99)), (" bytes= 1 - 2 ", (1, 2)),
     ("bytes=100-", None), ("bytes=9-3", None), ("bytes=-0", None), ("bytes=-", None), ("items=0-1", None), ("bytes=a-b", None), ("", None), (None, None)],
)
def test_byte_ranges(spark, header, want):
    df = spark.createDataFrame([(header, 100)], "h string, n long")
    r = df.select(byte_range(F.col("h"), F.col("n")).alias("r")).first()["r"]
    assert (r and tuple(r)) == want


def test_journal_and_commit(spark, tmp_path):
    tables = catalog.Versions(spark, f"file://{tmp_path}/files"), catalog.Versions(spark, f"file://{tmp_path}/meta")
    tables[0].write(spark.createDataFrame([("h", "a/x.jpg")], "hash string, path string"))
    tables[1].write(spark.createDataFrame([("a", "h", 5)], "folder string, hash string, rating int"))
    ops = spark.createDataFrame([("move", "h", "a/x.jpg", "b/x.jpg")], "kind string, hash string, from string, to string")
    folders = spark.createDataFrame([("b",)], "folder string")
    log = journal.Journal(spark, f"file://{tmp_path}/journal")
    assert log.list() == [] and log.load().count() == 0
    id = journal.commit(*tables, log, ops, "move to b/c", folders, AT)
    assert log.list() == [id] == ["20240229235958-move-to-b-c"]
    assert tables[0].read().first()["path"] == "b/x.jpg" and tables[1].read().first()["folder"] == "b"
    assert journal.undo_entry(tables[0].read(), log.load()).first()["to"] == "a/x.jpg"

    class Broken(catalog.Versions):
        def write(self, df):
            raise OSError("disk full")

    back = spark.createDataFrame([("move", "h", "b/x.jpg", "a/x.jpg")], ops.schema)
    with pytest.raises(OSError):
        journal.commit(tables[0], Broken(spark, tables[1].root), log, back, "back", folders.union(spark.createDataFrame([("a",)], "folder string")), AT)
    assert log.list() == [id] and tables[0].read().first()["path"] == "b/x.jpg" and tables[0].current() == 2
    assert log.write(ops, "move to b/c", AT) == id + "-2"
    log.discard(id + "-2")
    assert log.list() == [id]


def test_side_files_written_back(spark, tmp_path):
    for folder in ("Trip é", "Empty", ".hidden", "Old"):
        (tmp_path / folder).mkdir()
    say = lambda folder, name, doc: (tmp_path / folder / name).write_text(json.dumps(doc))
    say("Trip é", files.META_FILE, {"photos": {"h": {"rating": 1}}, "view": {"sort": "name"}})
    say("Empty", files.META_FILE, {"photos": {"h": {"rating": 1}}})
    say(".hidden", files.META_FILE, {"photos": {"h": {"rating": 1}}})
    say("Old", "old.json", {"photos": {"o": {"rating": 2}}})
    root = tmp_path.as_uri()
    meta = files.read_meta(spark, f"file://{tmp_path}", legacy="old.json")
    assert {(r["folder"], r["hash"]) for r in meta.collect()} == {("Trip é", "h"), ("Empty", "h"), ("Old", "o")}
    now = spark.createDataFrame([("Trip é", "h", 4, None, []), ("Old", "o", 2, None, []), ("Gone", "x", 1, None, [])], meta.schema)
    dirty = spark.createDataFrame([("Trip é",), ("Empty",), ("Old",), ("Gone",)], "folder string")
    done = {r["folder"]: r["done"] for r in files.write_meta(now, dirty, root, legacy="old.json").collect()}
    assert done == {"Trip é": "written", "Empty": "removed", "Old": "written", "Gone": "gone"}
    assert json.loads((tmp_path / "Trip é" / files.META_FILE).read_text()) == {"photos": {"h": {"rating": 4}}, "view": {"sort": "name"}}
    assert not (tmp_path / "Empty" / files.META_FILE).exists() and not (tmp_path / "Old" / "old.json").exists()
    assert not (tmp_path / "Gone").exists() and not list(tmp_path.rglob("*.part"))


def test_originals_kept_aside(spark):
    paths = ["Originals/a.jpg", "Originals/a_3.jpg", "x/a.jpg", "y/a.jpg", "z/a_2.jpg", "x/b", "y/b", "x/c.png"]
    df = spark.createDataFrame([(str(i), p) for i, p in enumerate(paths)], "hash string, path string")
    chosen = df.where("path LIKE '_/%'").select("path")
    got = {r["from"]: r["to"].removeprefix("Originals/") for r in build.keep_aside(df, chosen).collect()}
    # a.jpg and a_3.jpg lie there, and a_2.jpg is another chosen file's own name.
    assert got == {"x/a.jpg": "a_4.jpg", "y/a.jpg": "a_5.jpg", "z/a_2.jpg": "a_2.jpg", "x/b": "b", "y/b": "b_2.jpg", "x/c.png": "c.png"}


def test_files_stripped(spark):
    df = spark.createDataFrame([("a.jpg", "h", jpeg(tiff())), ("b.heic", "g", b"raw")], "path string, hash string, content binary")
    out, aside = build.strip_files(df)
    got = {r["path"]: r for r in out.collect()}
    assert got["a.jpg"]["new_hash"] == hashlib.sha256(exif.stripped(jpeg(tiff()))).hexdigest() and got["a.jpg"]["problem"] is None
    assert bytes(got["b.heic"]["content"]) == b"raw" and got["b.heic"]["new_hash"] == "g" and got["b.heic"]["problem"]
    assert [r["to"] for r in aside.collect()] == ["Originals/a.jpg"] and build.strip_files(df, keep=False)[1] is None


def test_cache_identities(spark):
    rows = [("/a", "1", "/a", True), ("/b", "1", "/a", True), ("/c", "2", "/was", True), ("/d", None, None, True), ("/e", None, None, False)]
    df = spark.createDataFrame(rows, "folder string, marker string, home string, writable boolean")
    got = {r["folder"]: (r["id"], r["why"]) for r in catalog.identities(df).collect()}
    assert {k: v[1] for k, v in got.items()} == {"/a": "own", "/b": "copy", "/c": "own", "/d": "new", "/e": "path"}
    assert got["/a"][0] == "1" and got["/c"][0] == "2" and len({v[0] for v in got.values()}) == 5
    caches = spark.createDataFrame([("1", "/a"), ("9", "/gone")], "id string, folder string")
    assert [r["id"] for r in catalog.forgotten(caches, df).collect()] == ["9"]


def test_extraction_goes_on_where_it_was(spark, tmp_path):
    todo = spark.createDataFrame([(f"h{i}",) for i in range(40)] + [("h1",)], "hash string")
    done, failed = f"file://{tmp_path}/done", f"file://{tmp_path}/failed"
    seen = []

    def work(rows):
        hashes = [r[0] for r in rows.collect()]
        seen.extend(hashes)
        return spark.createDataFrame([(h, h != "h7", 1) for h in hashes], "hash string, ok boolean, x int")

    left = iter([False, False, True])
    assert catalog.extract(todo, work, done, failed, "1", 4, lambda: next(left)) == 2 and len(seen) < 40
    assert catalog.extract(todo, work, done, failed, "1", 4) == 4 and sorted(seen) == sorted(f"h{i}" for i in range(40))
    assert spark.read.parquet(done).count() == 39
    catalog.extract(todo, work, done, failed, "2", 4)
    assert seen[40:] == ["h7"]


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.jpg").write_bytes(b"1")
    got = []
    run = lambda: events.on_changes(
        events.watch(spark, f"file://{tmp_path}/in"), lambda p: got.extend(r[0].rsplit("/", 1)[1] for r in p.collect()) or p.count(), f"{tmp_path}/state", lambda n: None
    ).awaitTermination()
    run()
    (tmp_path / "in" / "sub" / "b.jpg").write_bytes(b"2")
    run()
    assert got == ["a.jpg", "b.jpg"]


def test_peek_and_counts(spark, tmp_path):
    for name in ("b.jpg", "A.jpg", "sub/c.jpg"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert [r["path"] for r in files.peek(spark, f"file://{tmp_path}").collect()] == ["A.jpg", "b.jpg"]
    meta = spark.createDataFrame([("a", 0, None, []), ("b", 1, None, []), ("b", 0, "red", []), ("c", 0, None, ["x"])], "hash string, rating int, label string, albums array<string>")
    assert listing.described(meta).first()["photos"] == 2
    kept = spark.createDataFrame([("thumbs/a", 2), ("thumbs/b", 3), ("index", 5)], "path string, size long")
    assert {tuple(r) for r in listing.stored(kept).collect()} == {("thumbs", 2, 5), ("", 1, 5)}
