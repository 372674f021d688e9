"""Paths, names and kinds of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
PHOTO = (
    "jpg jpeg png heic heif webp gif tif tiff bmp ico tga qoi pbm pgm ppm pnm hdr dds"
).split()
RAW = "cr2 cr3 dng nef arw raf".split()
VIDEO = "mp4 mov m4v".split()
#: Directories that a scan skips by default.
SKIPPED_DIRS = [
    "Library", "Applications", "System", "Volumes", "private", "node_modules", ".git", ".Trash", "$RECYCLE.BIN",
    "Windows", "Program Files",
]
#: Fixed value: characters that a file name can't have on exFAT.
RESERVED = '"*/:<>?\\|'


def folder_of(path: Column) -> Column:
    """The folder part of a path; '' at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def ext_of(path: Column) -> Column:
    """What follows the last dot, lower-cased; the whole path if there is none."""
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def stem_of(path: Column) -> Column:
    """The name without its last extension."""
    return F.regexp_replace(name_of(path), r"(?<=.)\.[^.]*$", "")


def depth_of(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def kind_of(path: Column) -> Column:
    """`photo`, `video` or null, by extension."""
    ext = ext_of(path)
    return F.when(ext.isin(PHOTO + RAW), "photo").when(ext.isin(VIDEO), "video")


def is_sidecar(path: Column) -> Column:
    return name_of(path).startswith("._")


def is_skipped(path: Column, names: list[str] | None = None) -> Column:
    """Whether a folder of the path is one that scans skip, whatever its case."""
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*(F.lit(n.lower()) for n in names or SKIPPED_DIRS)))


def in_folder(path: Column, folder: Column | str) -> Column:
    """Whether a file lies in a folder or below: by whole segments; the empty folder holds everything."""
    if isinstance(folder, str):
        return path.startswith(folder + "/") if folder else F.lit(True)
    return (folder == "") | F.startswith(path, F.concat(folder, F.lit("/")))


def folder_within(folder: Column, top: str) -> Column:
    """Whether a folder is top or below it."""
    return (folder == top) | in_folder(folder, top)


def ancestors(folder: Column) -> Column:
    """A folder, the folders above it and the root '', nearest first."""
    n = F.size(F.split(folder, "/"))
    above = F.transform(
        F.sequence(n, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(F.split(folder, "/"), F.lit(1), i), "/")
    )
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(above, F.array(F.lit(""))))


def filename_problem(name: Column) -> Column:
    """Why a file name is invalid, or null."""
    return (
        F.when(name == "", "empty")
        .when(name.rlike(r'["*/:<>?\\|]'), "reserved character")
        .when(name.rlike(r"[\x00-\x1F]"), "control character")
        .when(name.rlike(r"[ .]\z"), "ends with a space or dot")
    )


def split_counter(stem: Column) -> Column:
    """(base, counter): a trailing _N of fewer than four digits is a counter, a longer one is a year."""
    base = F.regexp_extract(stem, r"^(.*)_\+?(\d{1,3})$", 1)
    n = F.regexp_extract(stem, r"^(.*)_\+?(\d{1,3})$", 2)
    return F.struct(
        F.when(n == "", stem).otherwise(base).alias("base"), F.when(n != "", n.cast("int")).alias("counter")
    )


def folder_name(album: Column) -> Column:
    """An album's name as a folder's: reserved characters dashed, outer spaces and dots cut, null if nothing is left."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")
    clean = trim(F.translate(album, RESERVED, "-" * len(RESERVED)))
    return F.nullif(trim(F.regexp_replace(clean, r"^\.+|\.+\z", "")), F.lit(""))


def slug(label: Column) -> Column:
    """A label reduced to letters, digits, dashes and underscores; `op` if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_-]", "-"), "^-+|-+$", "")
    return F.when(out == "", "op").otherwise(out)


def face_key(hash: Column, idx: Column) -> Column:
    return F.concat_ws(":", hash, idx.cast("string"))


def split_face_key(key: Column) -> Column:
    """(hash, idx), split at the last colon; nulls if there is no number after it."""
    pattern = r"^(.*):(-?\d+)$"
    ok = key.rlike(pattern)
    return F.struct(
        F.when(ok, F.regexp_extract(key, pattern, 1)).alias("hash"),
        F.when(ok, F.regexp_extract(key, pattern, 2).try_cast("long")).alias("idx"),
    )


def bytes_label(n: Column) -> Column:
    """1536 as '1.5 KB'."""
    size = n.cast("double")
    out = F.when(size < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for unit, at in (("KB", 1 << 10), ("MB", 1 << 20), ("GB", 1 << 30)):
        text = F.concat(F.format_string("%.1f", F.bround(size / at, 1)), F.lit(f" {unit}"))
        out = out.otherwise(text) if unit == "GB" else out.when(size < at * 1024, text)
    return out


def id32(text: Column) -> Column:
    """A 32-digit hexadecimal id."""
    return F.md5(text)


def byte_range(header: Column, size: Column) -> Column:
    """struct(start, end) of a request header like 'bytes=0-99', 'bytes=500-' or 'bytes=-500' for a file of so many bytes;
    null where it says no range of the file."""
    spec = F.regexp_extract(F.trim(header), r"^bytes=\s*(\d*)\s*-\s*(\d*)\s*$", 0)
    a, b = (F.regexp_extract(spec, r"^bytes=\s*(\d*)\s*-\s*(\d*)\s*$", i).try_cast("long") for i in (1, 2))
    bounded = F.regexp_extract(spec, r"-\s*\d", 0) != ""
    last = size - 1
    start = F.when(a.isNotNull(), a).otherwise(F.greatest(size - b, F.lit(0)))
    end = F.when(a.isNotNull() & bounded, F.least(b, last)).otherwise(last)
    suffix = a.isNull() & (b > 0) & (size > 0)
    good = F.when(a.isNotNull(), (a < size) & (a <= end)).otherwise(suffix)
    return F.when((spec != "") & F.coalesce(good, F.lit(False)), F.struct(start.alias("start"), end.alias("end")))
