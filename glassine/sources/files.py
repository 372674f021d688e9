"""File trees as tables, and user-authored JSON beside the files."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import folder_of, is_sidecar, is_skipped, kind_of, name_of
from ..functions.times import resolve


def tree(
    spark: SparkSession, root: str, shallow: bool = False, content: bool = False, only: list[str] | None = None
) -> DataFrame:
    """(path relative to root, size, mtime, uri[, content]) of every file below root, or of the uris in only; without
    content no file is opened."""
    read = spark.read.format("binaryFile")
    if not shallow:
        read = read.option("recursiveFileLookup", "true")
    found = read.load(root if only is None else only)
    bare = root.removeprefix("file://").rstrip("/") + "/"
    # Spark lists encoded URIs: a plus sign stands for itself there.
    decoded = F.regexp_replace(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "^[a-z0-9]+:/+", "/")
    path = F.substring(decoded, F.lit(len(bare) + 1), F.length(decoded))
    columns = [path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), F.col("path").alias("uri")]
    return found.select(*columns, *(["content"] if content else []))


def media(files: DataFrame, skip: bool = True) -> DataFrame:
    """The photos and videos among files, with their kind: no sidecars and, unless told, no skipped folders."""
    path = F.col("path")
    out = files.withColumn("kind", kind_of(path)).where(F.col("kind").isNotNull() & ~is_sidecar(path))
    return out.where(~is_skipped(path)) if skip else out


def hashed(files: DataFrame) -> DataFrame:
    """files with the hash of their content, which is dropped."""
    return files.withColumn("hash", F.sha2("content", 256)).drop("content")


def opened(files: DataFrame) -> DataFrame:
    """(path, hash, exif_at) of files (path, content): SHA-256 of the bytes and the time that EXIF gives, in one reading."""
    from .exif import describe

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, hashlib.sha256(c).hexdigest(), describe(bytes(c)).get("taken_at")) for p, c in zip(batch["path"], batch["content"])]
            out = pd.DataFrame(rows, columns=["path", "hash", "exif_at"])
            out["exif_at"] = pd.to_datetime(out["exif_at"])
            yield out

    return files.select("path", "content").mapInPandas(run, "path string, hash string, exif_at timestamp")


def scan(spark: SparkSession, root: str, catalogue: DataFrame | None = None, rehash: bool = False, **options) -> DataFrame:
    """The catalogue rows of what is below root now.

    Files that the catalogue knows by path, size and time keep their hash and time: only the others are opened, by name.
    The driver holds the new files' names, as it holds the listing.  A photo's time is that of its EXIF block, else of
    its name, else its file's.
    """
    listed = media(tree(spark, root, options.get("shallow", False)), options.get("skip", True))
    columns = ["hash", "path", "size", "mtime", "kind", "taken_at", "taken_src"]
    if catalogue is None or rehash:
        fresh, known = listed, None
    else:
        keys = ["path", "size", "mtime"]
        fresh = listed.join(catalogue.select(*keys), keys, "left_anti")
        known = listed.join(catalogue.select(*keys, "hash", "taken_at", "taken_src"), keys).select(*columns)
    if known is None:
        bodies = tree(spark, root, options.get("shallow", False), content=True).join(fresh.select("path"), "path")
    else:
        # In a name to load, what begins a pattern is escaped.
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", r[0]) for r in fresh.select("uri").toLocalIterator()]
        bodies = tree(spark, root, content=True, only=names) if names else tree(spark, root, content=True).limit(0)
    found = opened(bodies).join(fresh, "path")
    at = resolve(F.col("exif_at"), name_of(F.col("path")), F.col("mtime"))
    found = found.withColumn("at", at).select("hash", "path", "size", "mtime", "kind", "at.taken_at", "at.taken_src")
    return found if known is None else found.unionByName(known)


META_FILE = "photos.json"
_META = (
    "photos map<string, struct<rating: int, label: string, albums: array<string>>>, "
    "searches array<struct<name: string, query: string>>, view struct<sort: string, `order`: array<string>>"
)


def side_files(spark: SparkSession, root: str, name: str = META_FILE, legacy: str | None = None) -> DataFrame:
    """(folder, json) of the side files below root, without those in hidden folders.

    A folder that has no file of the name is read from its file of the legacy name, if one is given.
    """
    names = [name] + ([legacy] if legacy else [])
    text = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
    rows = text.option("pathGlobFilter", "{" + ",".join(names) + "}" if legacy else name).text(root)
    bare = root.removeprefix("file://").rstrip("/") + "/"
    decoded = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    path = F.regexp_replace(decoded, "^[a-z0-9]+:/+", "/")
    path = F.substring(path, F.lit(len(bare) + 1), F.length(path))
    rows = rows.select(folder_of(path).alias("folder"), (name_of(path) == name).alias("current"), F.col("value").alias("json"))
    rows = rows.where(~F.col("folder").rlike(r"(^|/)\."))
    return rows.groupBy("folder").agg(F.max_by("json", "current").alias("json")) if legacy else rows.select("folder", "json")


def read_meta(spark: SparkSession, root: str, name: str = META_FILE, legacy: str | None = None) -> DataFrame:
    """(folder, hash, rating, label, albums) of the side files below root; a broken file says nothing."""
    rows = side_files(spark, root, name, legacy).select("folder", F.from_json("json", _META).alias("j"))
    out = rows.select("folder", F.explode("j.photos").alias("hash", "m"))
    empty = F.array().cast("array<string>")
    return out.select("folder", "hash", F.coalesce("m.rating", F.lit(0)).alias("rating"), "m.label", F.coalesce("m.albums", empty).alias("albums"))


def meta_documents(meta: DataFrame) -> DataFrame:
    """(folder, json): each folder's side file, to be written by whoever owns the folder; folders without rows have none."""
    record = F.struct(
        F.nullif("rating", F.lit(0)).alias("rating"), "label", F.when(F.size("albums") > 0, F.col("albums")).alias("albums")
    )
    photos = F.map_from_entries(F.array_sort(F.collect_list(F.struct("hash", record.alias("m")))))
    return meta.groupBy("folder").agg(F.to_json(F.struct(photos.alias("photos"))).alias("json"))


def put_file(uri: str, body: bytes) -> None:
    """Writes a file that appears whole or not at all, on any file system that Arrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with system.open_output_stream(part) as out:
        out.write(body)
    system.move(part, path)


def write_meta(meta: DataFrame, dirty: DataFrame, root: str, name: str = META_FILE, legacy: str | None = None) -> DataFrame:
    """Writes the side files of the dirty folders (folder) below root; (folder, done) says what became of each.

    written, or removed where the folder has nothing to say, or gone where there is no such folder.  What a file says
    beyond photos (searches, view) stays.  The file of the legacy name goes.  A task that runs twice does the same again;
    nothing is done until the result is read, so read it once.  root is a URI that every machine reaches.
    """
    old = side_files(meta.sparkSession, root, name, legacy).withColumnRenamed("json", "old")
    todo = dirty.select("folder").distinct().join(meta_documents(meta), "folder", "left").join(old, "folder", "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root.rstrip("/"))
        for batch in batches:
            done = []
            for folder, new, was in zip(batch["folder"], batch["json"], batch["old"]):
                place = f"{base}/{folder}".rstrip("/")
                if system.get_file_info(place).type != fs.FileType.Directory:
                    done.append("gone")
                    continue
                try:
                    kept = json.loads(was or "{}")
                except ValueError:
                    kept = {}
                kept = {k: v for k, v in kept.items() if k != "photos" and v} if isinstance(kept, dict) else {}
                body = (json.loads(new) if new else {}) | kept
                unwanted = [legacy] if legacy else []
                if body:
                    put_file(f"{root.rstrip('/')}/{quote(folder)}/{name}" if folder else f"{root.rstrip('/')}/{name}", json.dumps(body, indent=2, ensure_ascii=False).encode())
                else:
                    unwanted.append(name)
                for n in unwanted:
                    if system.get_file_info(f"{place}/{n}").type == fs.FileType.File:
                        system.delete_file(f"{place}/{n}")
                done.append("written" if body else "removed")
            yield pd.DataFrame({"folder": batch["folder"], "done": done})

    return todo.mapInPandas(run, "folder string, done string")


def peek(spark: SparkSession, root: str) -> DataFrame:
    """What is in one folder, without its subfolders, in order of lower-cased paths; nothing is kept or written."""
    return scan(spark, root, shallow=True).orderBy(F.lower("path"), "path")


_PEOPLE = "people array<struct<name: string, faces: array<string>, references: array<array<float>>, excluded: array<string>>>, dismissed array<string>"


def read_people(text: DataFrame, faces: DataFrame) -> dict[str, DataFrame]:
    """refs, exclusions and dismissed faces of people files (value: JSON).

    Pointers "hash:idx" are looked up in faces; those that resolve to nothing yield nothing.  Inline vectors stay.
    """
    from ..functions.paths import split_face_key

    doc = text.select(F.from_json("value", _PEOPLE).alias("j"))
    person = doc.select(F.explode("j.people").alias("p")).select("p.*")
    pointed = person.select("name", F.posexplode("faces").alias("ref_idx", "key")).withColumn("k", split_face_key(F.col("key")))
    pointed = pointed.select("name", "ref_idx", "k.hash", "k.idx").join(faces.select("hash", "idx", "embedding"), ["hash", "idx"])
    inline = person.select("name", F.posexplode("references").alias("ref_idx", "embedding"))
    inline = inline.withColumn("ref_idx", F.col("ref_idx") + 1_000_000)
    refs = pointed.select("name", "ref_idx", "embedding").where("embedding IS NOT NULL").unionByName(inline)
    dismissed = doc.select(F.explode("j.dismissed").alias("key")).select(split_face_key(F.col("key")).alias("k")).select("k.*")
    return {
        "refs": refs,
        "exclusions": person.select("name", F.explode("excluded").alias("hash")),
        "dismissed": dismissed.where("hash IS NOT NULL"),
    }
