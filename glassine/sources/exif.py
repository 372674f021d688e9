"""TIFF directories in photographs: times, places, cameras, previews; and files without their metadata."""

from __future__ import annotations

import datetime
import math
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Sizes of TIFF's types, and tags.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
MAKE, MODEL, DATE, EXIF_IFD, GPS_IFD = 0x010F, 0x0110, 0x0132, 0x8769, 0x8825
DIGITISED = 0x9004
TAKEN, EXPOSURE, APERTURE, ISO, FOCAL, LENS = 0x9003, 0x829A, 0x829D, 0x8827, 0x920A, 0xA434
THUMB_AT, THUMB_SIZE, ORIENTATION = 0x0201, 0x0202, 0x0112
#: Directories read at most, how deep, and what a preview may be.
DIRECTORIES, DEPTH, LONG_EDGE, PREVIEW_BYTES = 48, 3, 512, 64 << 20


class Tiff:
    """The directories of a TIFF block; whatever lies outside the block is left out."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8:
            raise ValueError("not a TIFF block")
        self.seen: set[int] = set()

    def entries(self, at: int) -> tuple[dict[int, tuple], int]:
        """A directory's values by tag, and the next directory's place."""
        d, o = self.data, self.order
        if at in self.seen or at + 2 > len(d) or len(self.seen) >= DIRECTORIES:
            return {}, 0
        self.seen.add(at)
        (n,) = struct.unpack_from(o + "H", d, at)
        out = {}
        for i in range(n):
            e = at + 2 + 12 * i
            if e + 12 > len(d):
                return out, 0
            tag, kind, count = struct.unpack_from(o + "HHI", d, e)
            size = SIZES.get(kind, 0) * count
            place = e + 8
            if size > 4:
                (place,) = struct.unpack_from(o + "I", d, place)
            if not size or place + size > len(d):
                continue
            out[tag] = self._values(kind, count, place)
        after = at + 2 + 12 * n
        return out, struct.unpack_from(o + "I", d, after)[0] if after + 4 <= len(d) else 0

    def _values(self, kind: int, count: int, at: int) -> tuple:
        d, o = self.data, self.order
        if kind == 2:
            return (d[at : at + count].split(b"\0")[0].decode("utf-8", "replace").strip(),)
        if kind in (5, 10):
            raw = struct.unpack_from(f"{o}{2 * count}{'I' if kind == 5 else 'i'}", d, at)
            return tuple(a / b if b else float("nan") for a, b in zip(raw[::2], raw[1::2]))
        if kind in (1, 7):
            return tuple(d[at : at + count])
        return struct.unpack_from(f"{o}{count}{ {3: 'H', 4: 'I', 6: 'b', 8: 'h', 9: 'i', 11: 'f', 12: 'd'}[kind] }", d, at)

    def first(self) -> int:
        return struct.unpack_from(self.order + "I", self.data, 4)[0]


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG's segments before its pixels; start is the marker's own place."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA or marker == 0xD9:
            return
        (size,) = struct.unpack_from(">H", data, at + 2)
        yield marker, at, at + 2 + size
        at += 2 + size


#: Boxes of an ISO base media file that hold others, and what precedes the children of a named box.
HOLDERS, NAMED = (b"moov", b"trak", b"mdia", b"minf", b"stbl"), b"uuid"


def boxes(data: bytes, start: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the bodies of an ISO base media file's boxes, parents before children; a box that reaches
    beyond its parent ends the walk of that parent."""
    end = len(data) if end is None else end
    while start + 8 <= end and depth <= 6:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        size = size or end - start
        if size < head or start + size > end:
            return
        body, after = start + head, start + size
        yield kind, body, after
        if kind in HOLDERS or kind == NAMED:
            yield from boxes(data, body + 16 * (kind == NAMED), after, depth + 1)
        start = after


def _media_spans(data: bytes) -> list[tuple[int, int]]:
    """(start, length) of the pictures in an ISO base media file: preview boxes, and the first sample of each track."""
    spans, size, offset = [], None, None
    for kind, start, end in boxes(data):
        if kind in (b"PRVW", b"THMB"):
            at = data.find(b"\xff\xd8\xff", start, min(end, start + 128))
            if at >= 0:
                spans.append((at, end - at))
        elif kind == b"trak":
            size = offset = None
        elif kind == b"stsz" and end - start >= 12:
            same = struct.unpack_from(">I", data, start + 4)[0]
            size = same or (struct.unpack_from(">I", data, start + 12)[0] if end - start >= 16 else None)
        elif kind in (b"stco", b"co64") and end - start >= 16 - 4 * (kind == b"stco"):
            (offset,) = struct.unpack_from(">Q" if kind == b"co64" else ">I", data, start + 8)
        else:
            continue
        if kind in (b"stsz", b"stco", b"co64") and size and offset:
            spans.append((offset, size))
            size = offset = None
    return spans


def tiff_block(data: bytes) -> bytes | None:
    """The EXIF block: a JPEG's, or the data themselves where they are a TIFF file; of RAW files in other containers the
    one in their preview or in a box of its own."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:15] == b"FUJIFILMCCD-RAW" and len(data) >= 92:
        at, size = struct.unpack_from(">II", data, 84)
        data = data[at : at + size]
    elif data[4:8] == b"ftyp":
        found = (data[a:b] for kind, a, b in boxes(data) if kind == b"CMT1")
        return next((block for block in found if block[:2] in (b"II", b"MM")), None)
    for marker, start, end in segments(data):
        if marker == 0xE1 and data[start + 4 : start + 10] == b"Exif\0\0":
            return data[start + 10 : end]
    return None


def _time(text: str | None) -> datetime.datetime | None:
    try:
        return datetime.datetime.strptime(text or "", "%Y:%m:%d %H:%M:%S")
    except ValueError:
        return None


def describe(data: bytes) -> dict:
    """taken_at, lat, lon, make, model, camera, lens, iso, exposure, aperture, focal, orientation, as far as there are any.

    Coordinates that are not finite, off the globe or (0, 0) are none.  The camera is the model, with the make before
    it unless the model begins with it.
    """
    out: dict = {}
    block = tiff_block(data)
    if block is None:
        return out
    try:
        tiff = Tiff(block)
        main, _ = tiff.entries(tiff.first())
        sub = tiff.entries(int(main[EXIF_IFD][0]))[0] if EXIF_IFD in main else {}
        gps = tiff.entries(int(main[GPS_IFD][0]))[0] if GPS_IFD in main else {}
    except (ValueError, struct.error):
        return out
    one = lambda d, tag: d[tag][0] if d.get(tag) else None
    out["taken_at"] = _time(one(sub, TAKEN)) or _time(one(main, DATE))
    make, model = one(main, MAKE) or "", one(main, MODEL) or ""
    out["make"], out["model"] = make or None, model or None
    out["camera"] = (model if model.lower().startswith(make.lower()) else f"{make} {model}".strip()) or None
    out |= {"lens": one(sub, LENS), "iso": one(sub, ISO), "exposure": one(sub, EXPOSURE), "aperture": one(sub, APERTURE)}
    out |= {"focal": one(sub, FOCAL), "orientation": one(main, ORIENTATION)}
    if len(gps.get(2, ())) == 3 and len(gps.get(4, ())) == 3:
        lat, lon = (d + m / 60 + s / 3600 for d, m, s in (gps[2], gps[4]))
        lat = -lat if one(gps, 1) == "S" else lat
        lon = -lon if one(gps, 3) == "W" else lon
        if abs(lat) <= 90 and abs(lon) <= 180 and (lat or lon):
            out["lat"], out["lon"] = lat, lon
    return out


SCHEMA = (
    "taken_at timestamp, lat double, lon double, make string, model string, camera string, lens string, iso long, "
    "exposure double, aperture double, focal double, orientation int"
)


def read(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, SCHEMA) of files (key, content)."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [describe(bytes(c)) if c is not None else {} for c in batch["content"]]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)
            out["taken_at"] = pd.to_datetime(out["taken_at"])
            for n in ("iso", "orientation"):
                out[n] = out[n].astype("Int64")
            out.insert(0, key, batch[key].values)
            yield out

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, "content").mapInPandas(run, f"{key} {kind}, {SCHEMA}")


def stripped(data: bytes) -> bytes:
    """A JPEG or PNG without its metadata, its pixels' bytes untouched; other data as they are.

    Fixed values: of JPEG's segments APP1, APP3-13, APP15 and comments go; of PNG's chunks tEXt, zTXt, iTXt, eXIf, tIME.
    """
    if data[:2] == b"\xff\xd8":
        out, at = [data[:2]], 2
        for marker, start, end in segments(data):
            if not (marker in (0xE1, 0xEF, 0xFE) or 0xE3 <= marker <= 0xED):
                out.append(data[start:end])
            at = end
        return b"".join(out) + data[at:]
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        out, at = [data[:8]], 8
        while at + 8 <= len(data):
            (size,) = struct.unpack_from(">I", data, at)
            if data[at + 4 : at + 8] not in (b"tEXt", b"zTXt", b"iTXt", b"eXIf", b"tIME"):
                out.append(data[at : at + 12 + size])
            at += 12 + size
        return b"".join(out)
    return data


def shown(data: bytes) -> dict[str, str]:
    """What describe finds, as text for people: camera, lens, iso, exposure ('1/250 s'), aperture ('f/2.8'), focal
    ('50 mm') and gps ('37 deg 58 min 30 sec N, …'), as far as there are any."""
    got = describe(data)
    number = lambda x: f"{x:.10g}"
    out = {k: got[k] for k in ("camera", "lens") if got.get(k)}
    known = {k: got[k] for k in ("iso", "exposure", "aperture", "focal") if got.get(k) is not None and math.isfinite(got[k])}
    if "iso" in known:
        out["iso"] = number(known["iso"])
    if known.get("exposure"):
        out["exposure"] = (number(known["exposure"]) if known["exposure"] >= 1 else f"1/{number(1 / known['exposure'])}") + " s"
    if "aperture" in known:
        out["aperture"] = f"f/{number(known['aperture'])}"
    if "focal" in known:
        out["focal"] = f"{number(known['focal'])} mm"
    if "lat" in got:
        parts = []
        for value, signs in ((got["lat"], "NS"), (got["lon"], "EW")):
            d, m, s = _sexagesimal(value)
            parts.append(f"{d} deg {m} min {number(s / SECOND)} sec {signs[value < 0]}")
        out["gps"] = ", ".join(parts)
    return out


#: Coordinates are written to a ten-thousandth of a second of arc.
SECOND = 10_000


def _sexagesimal(value: float) -> tuple[int, int, int]:
    """Degrees, minutes and parts (1/SECOND) of seconds of a coordinate's amount; sixty seconds are a minute."""
    minutes, parts = divmod(round(abs(value) * 3600 * SECOND), 60 * SECOND)
    return minutes // 60, minutes % 60, parts


def rewritten_block(block: bytes | None, taken: datetime.datetime | None = None, place: tuple[float, float] | None = None) -> bytes:
    """A TIFF block with another capture time or place.

    The directories that change are written anew behind the block and the header points there, so that nothing else in
    it moves and every other value, makers' notes included, keeps its place.
    """
    data = bytearray(block or b"II*\0" + struct.pack("<I", 8) + bytes(6))
    order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]

    def read(at: int) -> tuple[dict[int, bytes], bytes]:
        (n,) = struct.unpack_from(order + "H", data, at)
        raw = [bytes(data[at + 2 + 12 * i : at + 14 + 12 * i]) for i in range(n)]
        after = bytes(data[at + 2 + 12 * n : at + 6 + 12 * n]).ljust(4, b"\0")
        return {struct.unpack_from(order + "H", e)[0]: e for e in raw if len(e) == 12}, after

    def put(value: bytes) -> bytes:
        data.extend(bytes(len(data) % 2))
        at = struct.pack(order + "I", len(data))
        data.extend(value)
        return at

    def entry(tag: int, kind: int, count: int, value: bytes) -> bytes:
        return struct.pack(order + "HHI", tag, kind, count) + (value.ljust(4, b"\0") if len(value) <= 4 else put(value))

    def directory(entries: dict[int, bytes], after: bytes) -> bytes:
        return put(struct.pack(order + "H", len(entries)) + b"".join(entries[t] for t in sorted(entries)) + after)

    main, after = read(struct.unpack_from(order + "I", data, 4)[0])
    if taken is not None:
        sub, rest = read(struct.unpack_from(order + "I", main[EXIF_IFD], 8)[0]) if EXIF_IFD in main else ({}, bytes(4))
        text = f"{taken:%Y:%m:%d %H:%M:%S}".encode() + b"\0"
        sub |= {tag: entry(tag, 2, len(text), text) for tag in (TAKEN, DIGITISED)}
        main[EXIF_IFD] = entry(EXIF_IFD, 4, 1, directory(sub, rest))
    if place is not None:
        gps = {0: entry(0, 1, 4, b"\2\3\0\0")}
        for tag, value, signs in ((1, place[0], b"NS"), (3, place[1], b"EW")):
            d, m, s = _sexagesimal(value)
            gps[tag] = entry(tag, 2, 2, signs[value < 0 :][:1] + b"\0")
            gps[tag + 1] = entry(tag + 1, 5, 3, struct.pack(order + "6I", d, 1, m, 1, s, SECOND))
        main[GPS_IFD] = entry(GPS_IFD, 4, 1, directory(gps, bytes(4)))
    data[4:8] = directory(main, after)
    return bytes(data)


def rewritten(data: bytes, taken: datetime.datetime | None = None, place: tuple[float, float] | None = None) -> bytes:
    """A JPEG with another capture time or place in its metadata, its pixels' bytes untouched.

    ValueError where the data are no JPEG, the metadata don't fit a segment, or what was written doesn't read back.
    """
    if data[:2] != b"\xff\xd8":
        raise ValueError("only JPEG files can be given a time or place")
    spans = [(a, b) for marker, a, b in segments(data) if marker == 0xE1 and data[a + 4 : a + 10] == b"Exif\0\0"]
    start, end = spans[0] if spans else (2, 2)
    try:
        block = rewritten_block(data[start + 10 : end] if spans else None, taken, place)
    except (struct.error, KeyError) as e:
        raise ValueError("the metadata can't be read") from e
    if len(block) + 8 > 0xFFFF:
        raise ValueError("the metadata are too large to rewrite")
    out = data[:start] + b"\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + data[end:]
    got = describe(out)
    if taken is not None and got.get("taken_at") != taken.replace(microsecond=0):
        raise ValueError("the time doesn't read back")
    if place is not None and not all(abs(got.get(k, 999) - v) <= 1e-6 for k, v in zip(("lat", "lon"), place)):
        raise ValueError("the place doesn't read back")
    return out


def write(files: DataFrame) -> DataFrame:
    """files (…, content, new_taken_at, new_lat, new_lon) with the new values in their content, and problem: null, or why
    a file's content was left as it was.  A null value is none to write; a row without any is left alone."""
    names = files.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            contents, problems = [], []
            for c, t, lat, lon in zip(*(batch[n] for n in ("content", "new_taken_at", "new_lat", "new_lon"))):
                taken = None if pd.isna(t) else pd.Timestamp(t).to_pydatetime()
                place = None if pd.isna(lat) or pd.isna(lon) else (float(lat), float(lon))
                problem = None
                if c is not None and (taken or place):
                    try:
                        c = rewritten(bytes(c), taken, place)
                    except ValueError as e:
                        problem = str(e)
                contents.append(c)
                problems.append(problem)
            yield batch.assign(content=contents, problem=problems)[[*names, "problem"]]

    schema = T.StructType([*files.schema.fields, T.StructField("problem", T.StringType())])
    return files.mapInPandas(run, schema)


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) as the picture is shown, from the header alone: JPEG, turned as EXIF says, PNG or GIF."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack_from(">II", data, 16)
    if data[:3] == b"GIF" and len(data) >= 10:
        return struct.unpack_from("<HH", data, 6)
    size = jpeg_size(data)
    return size[::-1] if size and (describe(data).get("orientation") or 1) >= 5 else size


def embedded(data: bytes, least: int) -> bytes | None:
    """The preview in a JPEG's first APP1 segment: of at least so many pixels along its long edge, and of the photo's own
    shape within 2 %."""
    whole = jpeg_size(data)
    body = next((data[a + 4 : b] for marker, a, b in segments(data) if marker == 0xE1), b"")
    start, end = body.find(b"\xff\xd8\xff"), body.rfind(b"\xff\xd9")
    small = jpeg_size(body[start : end + 2]) if 0 <= start < end else None
    if not whole or not small or not all(whole + small) or max(small) < least:
        return None
    shapes = [w / h for w, h in (whole, small)]
    return body[start : end + 2] if abs(shapes[0] - shapes[1]) <= 0.02 * max(shapes) else None


def jpeg_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) from a JPEG's frame header, baseline to progressive."""
    for marker, start, _ in segments(data):
        if 0xC0 <= marker <= 0xC2 and start + 9 <= len(data):
            h, w = struct.unpack_from(">HH", data, start + 5)
            return w, h
    return None


def preview(data: bytes) -> bytes | None:
    """The largest JPEG embedded in a RAW file's directories: of at least LONG_EDGE pixels and at most PREVIEW_BYTES."""
    spans: list[tuple[int, int]] = []
    if data[:15] == b"FUJIFILMCCD-RAW" and len(data) >= 92:
        spans.append(struct.unpack_from(">II", data, 84))
    elif data[4:8] == b"ftyp":
        spans = _media_spans(data)
    else:
        try:
            tiff = Tiff(data)
        except ValueError:
            return None
        queue = [(tiff.first(), 0)]
        while queue:
            at, depth = queue.pop(0)
            while at:
                tags, at = tiff.entries(at)
                if THUMB_AT in tags and THUMB_SIZE in tags:
                    spans.append((int(tags[THUMB_AT][0]), int(tags[THUMB_SIZE][0])))
                if len(tags.get(0x0111, ())) == 1 and len(tags.get(0x0117, ())) == 1:
                    spans.append((int(tags[0x0111][0]), int(tags[0x0117][0])))
                if depth < DEPTH:
                    queue += [(int(x), depth + 1) for t in (0x014A, EXIF_IFD) for x in tags.get(t, ())]
    for start, size in sorted(spans, key=lambda s: -s[1]):
        body = data[start : start + size]
        found = jpeg_size(body) if len(body) == size <= PREVIEW_BYTES else None
        if found and max(found) >= LONG_EDGE:
            return body
    return None


def strip(files: DataFrame) -> DataFrame:
    """files (…, content) with their content stripped."""
    at = files.columns.index("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch.iloc[:, at] = [stripped(bytes(c)) if c is not None else None for c in batch["content"]]
            yield batch

    return files.mapInPandas(run, files.schema)


