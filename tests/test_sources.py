"""File trees, side files, gazetteers, images and their metadata, on files made here."""

import datetime
import hashlib
import json
import os
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glassine.plans import catalog
from glassine.sources import exif, files, gazetteer, images


def png(gray: np.ndarray) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    rows = b"".join(b"\0" + r.tobytes() for r in np.repeat(gray.astype(np.uint8)[..., None], 3, 2))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def tiff(order: str = "<", lat=(37, 58, 30), lat_ref=b"N", lon=(23, 43, 12), taken=b"2026:08:16 15:12:56\0") -> bytes:
    """A block with a make, a model, an EXIF time and coordinates."""
    body, extra = [], b""
    at = 8

    def entry(tag, kind, count, value: bytes):
        return (tag, kind, count, value)

    gps = [entry(1, 2, 2, lat_ref + b"\0"), entry(2, 5, 3, struct.pack(order + "6I", *(x for v in lat for x in (v, 1)))),
           entry(3, 2, 2, b"E\0"), entry(4, 5, 3, struct.pack(order + "6I", *(x for v in lon for x in (v, 1))))]
    sub = [entry(0x9003, 2, len(taken), taken), entry(0x8827, 3, 1, struct.pack(order + "H", 400))]
    main = [entry(0x010F, 2, 6, b"Canon\0"), entry(0x0110, 2, 10, b"Canon EOS\0"), entry(0x8769, 4, 1, None), entry(0x8825, 4, 1, None)]
    size = lambda d: 2 + 12 * len(d) + 4
    places = {"main": at, "sub": at + size(main), "gps": at + size(main) + size(sub)}
    data_at = places["gps"] + size(gps)
    for name, d in (("main", main), ("sub", sub), ("gps", gps)):
        body.append(struct.pack(order + "H", len(d)))
        for tag, kind, count, value in d:
            if value is None:
                value = struct.pack(order + "I", places["sub" if tag == 0x8769 else "gps"])
            if len(value) > 4:
                value, extra = struct.pack(order + "I", data_at + len(extra)), extra + value
            body.append(struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0"))
        body.append(struct.pack(order + "I", 0))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + b"".join(body) + extra


def jpeg(block: bytes | None = None, size=(640, 480), pad: int = 0) -> bytes:
    part = lambda m, d: b"\xff" + bytes([m]) + struct.pack(">H", len(d) + 2) + d
    out = b"\xff\xd8" + part(0xE0, b"JFIF\0") + (part(0xE1, b"Exif\0\0" + block) if block else b"")
    return out + part(0xFE, b"comment") + part(0xC0, b"\x08" + struct.pack(">HH", size[1], size[0]) + b"\x03") + b"\xff\xda" + b"\1" * pad + b"\xff\xd9"


@pytest.mark.parametrize("order", ["<", ">"])
def test_exif(order):
    got = exif.describe(jpeg(tiff(order)))
    assert got["taken_at"] == datetime.datetime(2026, 8, 16, 15, 12, 56)
    assert got["camera"] == "Canon EOS" and got["iso"] == 400
    assert got["lat"] == pytest.approx(37.975) and got["lon"] == pytest.approx(23.72)
    assert exif.describe(jpeg(tiff(order, lat_ref=b"S")))["lat"] == pytest.approx(-37.975)
    assert "lat" not in exif.describe(jpeg(tiff(order, lat=(0, 0, 0), lon=(0, 0, 0))))
    assert "lat" not in exif.describe(jpeg(tiff(order, lat=(95, 0, 0))))
    assert exif.describe(jpeg(tiff(order, taken=b"not a time at all!\0")))["taken_at"] is None


def test_exif_of_broken_files():
    whole = jpeg(tiff())
    for n in range(0, len(whole), 7):
        exif.describe(whole[:n])
    assert exif.describe(b"") == {} and exif.describe(b"text") == {}
    loop = b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", 0) + struct.pack("<I", 8)
    exif.describe(loop)


def test_strip():
    bare = exif.stripped(jpeg(tiff(), pad=9))
    assert b"Exif" not in bare and b"comment" not in bare and b"JFIF" in bare and bare.endswith(b"\1" * 9 + b"\xff\xd9")
    assert exif.stripped(bare) == bare and exif.describe(bare) == {}
    assert b"tEXt" not in exif.stripped(png(np.zeros((4, 4)))) and exif.stripped(b"RAW") == b"RAW"


def test_raw_preview():
    small, large = jpeg(size=(320, 200)), jpeg(size=(1600, 1200), pad=50)
    head = b"II*\0" + struct.pack("<I", 8)
    ifd = lambda at, n, nxt: struct.pack("<H", 2) + struct.pack("<HHII", 0x0201, 4, 1, at) + struct.pack("<HHII", 0x0202, 4, 1, n) + struct.pack("<I", nxt)
    one = len(ifd(0, 0, 0))
    data_at = 8 + 2 * one
    raw = head + ifd(data_at, len(small), 8 + one) + ifd(data_at + len(small), len(large), 0) + small + large
    assert exif.preview(raw) == large
    assert exif.preview(raw[: data_at + len(small)]) is None and exif.preview(b"junk") is None


def test_scan_is_incremental(spark, tmp_path):
    root = tmp_path / "lib rary+1"
    for name in ("20260816_151256.jpg", "Trip/b.mov", "Trip/._b.mov", "Library/c.jpg", "n.txt", "Tr é/d.PNG"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(name.encode())
    first = files.scan(spark, f"file://{root}").cache()
    got = {r["path"]: r for r in first.collect()}
    assert set(got) == {"20260816_151256.jpg", "Trip/b.mov", "Tr é/d.PNG"}
    assert got["20260816_151256.jpg"]["taken_src"] == "filename" and got["Trip/b.mov"]["kind"] == "video"
    assert {r["path"] for r in files.scan(spark, f"file://{root}", skip=False).collect()} == set(got) | {"Library/c.jpg"}
    assert {r["path"] for r in files.scan(spark, f"file://{root}", shallow=True).collect()} == {"20260816_151256.jpg"}
    (root / "Trip/b.mov").rename(root / "moved.mov")
    second = files.scan(spark, f"file://{root}", first)
    status = {r["status"]: r["files"] for r in catalog.stats(catalog.reconcile(first, second)).collect()}
    assert status == {"unchanged": 2, "moved": 1}
    # Known files aren't opened: other bytes of the same size and time keep the hash.
    known = root / "moved.mov"
    second = spark.createDataFrame(second.collect(), second.schema)
    stat = known.stat()
    known.write_bytes(b"x" * stat.st_size)
    os.utime(known, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    (root / "new [1]{a}*.jpg").write_bytes(jpeg(tiff()))
    third = {r["path"]: r for r in files.scan(spark, f"file://{root}", second).collect()}
    assert set(third) == {"20260816_151256.jpg", "Tr é/d.PNG", "moved.mov", "new [1]{a}*.jpg"} and third["moved.mov"]["hash"] == got["Trip/b.mov"]["hash"]
    new = third["new [1]{a}*.jpg"]
    assert new["taken_src"] == "exif" and str(new["taken_at"]) == "2026-08-16 15:12:56"
    assert new["hash"] == hashlib.sha256((root / "new [1]{a}*.jpg").read_bytes()).hexdigest()
    assert third["20260816_151256.jpg"]["taken_src"] == "filename"
    first.unpersist()
    again = {r["path"]: r["hash"] for r in files.scan(spark, f"file://{root}", second, rehash=True).collect()}
    assert again["moved.mov"] != third["moved.mov"]["hash"]


def test_side_files(spark, tmp_path):
    (tmp_path / "Trip").mkdir()
    (tmp_path / files.META_FILE).write_text(json.dumps({"photos": {"h": {"rating": 1}, "g": {"label": "red", "albums": ["x"]}}, "new": 1}))
    (tmp_path / "Trip" / files.META_FILE).write_text(json.dumps({"photos": {"h": {"rating": 3}}}))
    (tmp_path / "Trip" / "bad").mkdir()
    (tmp_path / "Trip" / "bad" / files.META_FILE).write_text("{")
    meta = files.read_meta(spark, f"file://{tmp_path}")
    got = {(r["folder"], r["hash"]): (r["rating"], r["label"], r["albums"]) for r in meta.collect()}
    assert got == {("", "h"): (1, None, []), ("", "g"): (0, "red", ["x"]), ("Trip", "h"): (3, None, [])}
    docs = {r["folder"]: json.loads(r["json"]) for r in files.meta_documents(meta).collect()}
    assert docs["Trip"] == {"photos": {"h": {"rating": 3}}} and docs[""]["photos"]["g"] == {"label": "red", "albums": ["x"]}


def test_people_files(spark):
    text = {"people": [{"name": "Ann", "faces": ["h:0", "gone:1", "odd"], "excluded": ["e"]}, {"name": "Bob", "references": [[1.0, 2.0]]}], "dismissed": ["a:b:2"]}
    faces = spark.createDataFrame([("h", 0, [0.5, 0.5])], "hash string, idx long, embedding array<float>")
    got = files.read_people(spark.createDataFrame([(json.dumps(text),)], ["value"]), faces)
    assert sorted(r["name"] for r in got["refs"].collect()) == ["Ann", "Bob"]
    assert [tuple(r) for r in got["exclusions"].collect()] == [("Ann", "e")]
    assert [tuple(r) for r in got["dismissed"].collect()] == [("a:b", 2)]


def test_gazetteer(spark, tmp_path):
    cities = spark.createDataFrame(
        [("Paris", "Paris", 48.8534, 2.3488, "FR", "11", 2_000_000), ("Fíra", "Fira", 36.4166, 25.4324, "GR", "L", 2_000), ("Paris", "Paris", 33.66, -95.55, "US", "TX", 25_000)],
        "name string, ascii string, lat double, lon double, country_code string, region_code string, population long",
    )
    regions = spark.createDataFrame([("FR.11", "Île-de-France")], ["code", "region"])
    countries = spark.createDataFrame([("FR", "France"), ("GR", "Greece")], ["country_code", "country"])
    built = gazetteer.build(cities, regions, countries).orderBy("place_id").collect()
    assert [(r["name"], r["ascii"], r["country"]) for r in built] == [("Paris", "", "France"), ("Paris", "", "US"), ("Fíra", "Fira", "Greece")]
    data = gazetteer.pack([tuple(r)[1:] for r in built])
    (tmp_path / "places.bin").write_bytes(data)
    back = gazetteer.read(spark, f"file://{tmp_path}/places.bin").orderBy("place_id").collect()
    assert [tuple(r) for r in back] == [tuple(r)[:7] for r in built]
    assert data.startswith(b"OFGEO2\n\x03\0\0\0\x02FR\x06France")
    for bad in (b"XX" + data, data[:-1]):
        with pytest.raises(ValueError):
            list(gazetteer.unpack(bad))
    square = [[0.001, 0.0], [0.002, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]
    shape = {"features": [{"geometry": {"type": "Polygon", "coordinates": [square, [[0, 0], [0, 0], [0, 1]]]}}]}
    rings = gazetteer.outlines(spark.createDataFrame([(json.dumps(shape),)], ["value"])).collect()
    assert [r["points"] for r in rings] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]


def scene(seed: int, jitter: float = 0.0, soft: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:240, 0:320] / 240
    out = sum(rng.uniform(20, 60) * np.sin(rng.uniform(2, 14) * x + rng.uniform(2, 14) * y + rng.uniform(0, 6)) for _ in range(6)) + 128
    fine = np.random.default_rng(seed + 1000).normal(0, 18, out.shape)
    return np.clip(out + jitter + (0 if soft else fine), 0, 255)


def test_signatures(spark, tmp_path):
    from glassine.functions import vectors
    from glassine.operators import similarity

    for name, pixels in {"a": scene(1), "b": scene(1, 6, soft=True), "c": scene(2), "d": scene(3)}.items():
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    found = images.signatures(spark, f"file://{tmp_path}").withColumn("path", F.regexp_extract("origin", "([^/]*)$", 1))
    rows = {r["path"]: r for r in found.collect()}
    assert set(rows) == {"a.png", "b.png", "c.png", "d.png"} and (rows["a.png"]["width"], rows["a.png"]["height"]) == (320, 240)
    assert rows["a.png"]["sharpness"] > rows["b.png"]["sharpness"]
    pairs = similarity.image_pairs(found.withColumn("norm", vectors.standardise(F.col("thumb"))))
    assert [(r["i"], r["j"]) for r in pairs.collect()] == [("a.png", "b.png")]


def test_fixed_signature():
    """A 33 x 32 image is its own resized one, so the bits can be read off it."""
    gray = np.zeros((32, 33))
    gray[0, 0], gray[0, 8], gray[28, 28], gray[4, 5] = 200, 200, 9, 7
    assert images.dhash(gray) == -(1 << 63) | 1 << 61 | 1
    assert images.resized(np.full((100, 50), 7.0), 32, 32).tolist() == np.full((32, 32), 7.0).tolist()
    ramp = images.resized(np.tile(np.arange(64.0), (64, 1)), 32, 32)
    assert ramp[5, 10] == 21 and ramp[0].tolist() == sorted(ramp[0])


def test_pixels():
    p = np.arange(6).reshape(2, 3, 1)
    shapes = {o: images.oriented(p, o)[..., 0].tolist() for o in range(1, 9)}
    assert shapes[1] == [[0, 1, 2], [3, 4, 5]] and shapes[3] == [[5, 4, 3], [2, 1, 0]] and shapes[2] == [[2, 1, 0], [5, 4, 3]]
    assert shapes[4] == [[3, 4, 5], [0, 1, 2]] and shapes[5] == [[0, 3], [1, 4], [2, 5]] and shapes[6] == [[3, 0], [4, 1], [5, 2]]
    assert shapes[8] == [[2, 5], [1, 4], [0, 3]] and shapes[7] == [[5, 2], [4, 1], [3, 0]]
    w, h = images.inscribed(400, 300, 10)
    assert w < 400 and w / h == pytest.approx(4 / 3) and images.inscribed(400, 300, 0) == (400, 300)
    left, top, side = images.crop_boxes(100, 80, 90, 70, 20, 20)
    assert left + side <= 100 and top + side <= 80
