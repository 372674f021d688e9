"""Plans: which files would move where, and why others wouldn't.  Nothing is moved here.

Each builder returns (ops, skipped): ops (kind, hash, from, to) and skipped (path, reason).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import RESERVED, ext_of, filename_problem, folder_name, folder_of, in_folder, name_of

OPS = ["kind", "hash", "from", "to"]


def _ops(rows: DataFrame, to, kind: str = "move") -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), "hash", F.col("path").alias("from"), to.alias("to"))


def clean_destination(dest: str) -> str:
    """dest without outer blanks and slashes; an error if it is empty or can't be a folder's name."""
    dest = dest.strip().strip("/")
    if not dest:
        raise ValueError("no destination folder given")
    bad = next((c for part in dest.split("/") for c in part if c in RESERVED), None)
    if bad:
        raise ValueError(f"folder name contains a reserved character {bad!r}")
    return dest


def move_into(files: DataFrame, hashes: DataFrame, dest: str) -> tuple[DataFrame, DataFrame]:
    """The selected files to one folder: those already there stay, names taken there are skipped."""
    dest = clean_destination(dest)
    chosen = files.join(hashes.select("hash").distinct(), "hash", "left_semi").where(folder_of(F.col("path")) != dest)
    chosen = chosen.withColumn("name", name_of(F.col("path")))
    there = files.where(folder_of(F.col("path")) == dest).select(name_of(F.col("path")).alias("name")).distinct()
    ops = _ops(chosen.join(there, "name", "left_anti"), F.concat(F.lit(f"{dest}/"), F.col("name")))
    reason = F.concat(F.lit(f"{dest}/"), F.col("name"), F.lit(" already exists")).alias("reason")
    return ops, chosen.join(there, "name", "left_semi").select("path", reason)


def duplicates(members: DataFrame, dest: str = "Duplicates") -> DataFrame:
    """Ops that bring all but each group's keeper into dest."""
    return _ops(members.where("NOT is_keep"), F.concat(F.lit(f"{dest}/"), name_of(F.col("path"))))


def scenery(split: DataFrame, files: DataFrame, dest: str = "Scenery") -> DataFrame:
    """Ops for the photos found to be scenery that aren't in dest yet."""
    rows = files.join(split.where("is_scenery").select("hash").distinct(), "hash", "left_semi")
    return _ops(rows.where(~in_folder(F.col("path"), dest)), F.concat(F.lit(f"{dest}/"), name_of(F.col("path"))))


def by_person(files: DataFrame, found: DataFrame) -> DataFrame:
    """(hash, path, status, to): one identified person claims a file, two or more share it, none leaves it unclaimed.

    found (hash, name) holds people after exclusions.  to is null unless the file would move.
    """
    who = found.groupBy("hash").agg(F.array_sort(F.collect_set("name")).alias("people"))
    rows = files.join(who, "hash", "left")
    n = F.coalesce(F.size("people"), F.lit(0))
    status = F.when(n == 0, "unclaimed").when(n == 1, "claimed").otherwise("shared")
    owner = F.when(n == 1, F.col("people")[0])
    to = F.when(~in_folder(F.col("path"), owner), F.concat(owner, F.lit("/"), name_of(F.col("path"))))
    return rows.select("hash", "path", status.alias("status"), F.when(n == 1, to).alias("to"))


def albums_to_folders(files: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Albums as folders: a file goes to the first album by name that has it; members has hash and album."""
    paths = files.groupBy("hash").agg(F.max("path").alias("path"))
    rows = members.select("hash", "album").distinct().withColumn("dest", folder_name(F.col("album")))
    nameless = rows.where("dest IS NULL").select(F.col("album").alias("path"), F.lit("no usable folder name").alias("reason")).distinct()
    rows = rows.where("dest IS NOT NULL").join(paths, "hash").withColumn("to", F.concat("dest", F.lit("/"), name_of(F.col("path"))))
    # A file that lies where an album wants it isn't claimed by that album.
    order = Window.partitionBy("hash").orderBy("album")
    ranked = rows.where("to <> path").withColumn("n", F.row_number().over(order)).withColumn("first", F.first("dest").over(order))
    ops = ranked.where("n = 1").select(F.lit("move").alias("kind"), "hash", F.col("path").alias("from"), "to")
    reason = F.concat(F.lit("also in "), F.col("album"), F.lit("; it went to "), F.col("first")).alias("reason")
    late = rows.join(ranked.where("n = 1").select("hash", F.col("album").alias("claim"), F.col("dest").alias("first")), "hash")
    skipped = late.where("album > claim").select("path", reason)
    return ops, nameless.union(skipped)


def to_trash(files: DataFrame, hashes: DataFrame, trash: str = "Trash") -> DataFrame:
    """Ops that bring a selection to the trash, keeping each file's folder below it."""
    rows = files.join(hashes.select("hash").distinct(), "hash", "left_semi").where(~in_folder(F.col("path"), trash))
    return _ops(rows, F.concat(F.lit(f"{trash}/"), F.col("path")))


def restore(files: DataFrame, hashes: DataFrame, trash: str = "Trash") -> DataFrame:
    """Ops that bring a selection back from the trash."""
    rows = files.join(hashes.select("hash").distinct(), "hash", "left_semi").where(in_folder(F.col("path"), trash))
    return _ops(rows, F.substring("path", len(trash) + 2, 2**30))


def violations(ops: DataFrame, files: DataFrame, directories: DataFrame) -> DataFrame:
    """(rule, path): what keeps a plan from being applied; an empty result means that it can be.

    Rules: no-op, duplicate target, duplicate source, bad name, missing source, target exists (and isn't itself moved
    away), missing parent folder.
    """
    own = ops.select("from", "to")
    have = files.select("path").distinct()
    folders = directories.select(F.col("folder").alias("parent")).distinct()
    twice = lambda c, rule: own.groupBy(c).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(c).alias("path"))
    name = name_of(F.col("to"))
    found = [
        own.where(F.col("from") == F.col("to")).select(F.lit("no-op").alias("rule"), F.col("from").alias("path")),
        twice("to", "duplicate target"),
        twice("from", "duplicate source"),
        own.where(filename_problem(name).isNotNull()).select(F.lit("bad name"), "to"),
        own.join(have.withColumnRenamed("path", "from"), "from", "left_anti").select(F.lit("missing source"), "from"),
        own.join(have.withColumnRenamed("path", "to"), "to", "left_semi")
        .join(own.select(F.col("from").alias("to")), "to", "left_anti")
        .select(F.lit("target exists"), "to"),
        own.withColumn("parent", folder_of(F.col("to"))).where("parent <> ''").join(folders, "parent", "left_anti").select(F.lit("missing parent"), "to"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def stale(expected: DataFrame, files: DataFrame) -> DataFrame:
    """The (path, hash) pairs of a plan that the catalogue no longer has."""
    return expected.join(files.select("path", "hash"), ["path", "hash"], "left_anti")


def undo(ops: DataFrame) -> DataFrame:
    """A plan's inverse: the last op first, sources and targets swapped."""
    swapped = ops.select("kind", "hash", F.col("to").alias("from"), F.col("from").alias("to"), *(["seq"] if "seq" in ops.columns else []))
    return swapped.orderBy(F.desc("seq")) if "seq" in ops.columns else swapped


def relocate(meta: DataFrame, ops: DataFrame) -> DataFrame:
    """User metadata (folder, hash, …) that follows its files to other folders."""
    moved = ops.select("hash", folder_of(F.col("from")).alias("folder"), folder_of(F.col("to")).alias("new_folder"))
    moved = moved.where("folder <> new_folder").dropDuplicates(["hash", "folder"])
    out = meta.join(moved, ["hash", "folder"], "left").withColumn("folder", F.coalesce("new_folder", "folder"))
    return out.select(*meta.columns)


def rekey(table: DataFrame, changes: DataFrame) -> DataFrame:
    """A table keyed by hash after files were rewritten; changes has hash and new_hash."""
    out = table.join(changes, "hash", "left").withColumn("hash", F.coalesce("new_hash", "hash"))
    return out.select(*table.columns)


def keep_aside(files: DataFrame, paths: DataFrame, folder: str = "Originals") -> DataFrame:
    """Ops that move chosen files (path) into a folder, under their own names or, where taken, with _2, _3 and so on.

    Files of one name take the free numbers in path order; the names that others of the choice have count as taken.
    """
    chosen = files.join(paths.select("path").distinct(), "path", "left_semi").withColumn("name", name_of(F.col("path")))
    dotted = F.col("name").contains(".")
    stem = F.when(dotted, F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name"))
    ext = F.when(dotted, F.regexp_extract("name", r"([^.]*)$", 1)).otherwise("jpg")
    held = files.where(folder_of(F.col("path")) == folder).select(name_of(F.col("path")).alias("as")).distinct()
    plain = chosen.select(F.col("name").alias("as")).distinct()
    taken = held.union(plain.select("as")).distinct()
    numbered = taken.groupBy(F.regexp_replace("as", r"_\d+(\.[^.]*)$", "$1").alias("family")).agg(F.count("*").alias("names"))
    wanted = chosen.groupBy("name").agg(F.count("*").alias("files"))
    wanted = wanted.withColumn("family", F.concat(stem, F.lit("."), ext)).join(numbered, "family", "left")
    most = F.col("files") + F.coalesce("names", F.lit(0)) + 1
    slots = wanted.select("name", stem.alias("stem"), ext.alias("ext"), F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("n"))
    own = F.col("n") == 1
    slots = slots.withColumn("as", F.when(own, F.col("name")).otherwise(F.concat("stem", F.lit("_"), F.col("n").cast("string"), F.lit("."), F.col("ext"))))
    free = slots.where(own).join(held, "as", "left_anti").union(slots.where(~own).join(taken, "as", "left_anti"))
    rank = lambda *order: F.row_number().over(Window.partitionBy("name").orderBy(*order))
    dealt = chosen.withColumn("k", rank("path")).join(free.select("name", "as", rank("n").alias("k")), ["name", "k"])
    return _ops(dealt, F.concat(F.lit(f"{folder}/"), F.col("as")))


def strip_files(files: DataFrame, keep: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Files (path, hash, content) without their metadata, and the ops that keep the originals aside, if they are kept.

    The first table has path, content, hash and new_hash for rekey; problem says why a file was left alone.
    """
    from ..sources.exif import strip

    can = ext_of(F.col("path")).isin("jpg", "jpeg", "png")
    bare = strip(files.where(can).select("path", "hash", "content")).withColumn("new_hash", F.sha2("content", 256))
    left = files.where(~can).select("path", "hash", "content", F.col("hash").alias("new_hash"))
    problem = F.when(can, F.lit(None).cast("string")).otherwise("this kind of file can't be stripped")
    out = bare.unionByName(left).withColumn("problem", problem)
    return out, keep_aside(files, files.where(can).select("path")) if keep else None
