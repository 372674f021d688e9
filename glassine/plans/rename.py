"""Renaming files to their capture times."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import ext_of, filename_problem, folder_of, name_of, split_counter
from ..functions.times import COUNTER, DEFAULT_FORMAT, format_stem
from ..scratch import numbered, written


def _wanted(files: DataFrame, pattern: str) -> DataFrame:
    """files with base, ext and name, for the files whose name isn't right yet as well as the others."""
    at = F.coalesce("taken_at", "mtime")
    if COUNTER in pattern:
        # Numbers run over the whole scope.
        files = numbered(files.withColumn("__at", at), "__n", "__at", "path").drop("__at")
        width = max(1, len(str(files.count())))
        token = pattern.replace(COUNTER, "%%")
        base = F.replace(format_stem(at, token), F.lit("%"), F.lpad((F.col("__n") + 1).cast("string"), width, F.lit("0")))
    else:
        base = format_stem(at, pattern)
    name, ext = name_of(F.col("path")), ext_of(F.col("path"))
    out = files.withColumns({"base": base, "ext": ext, "name": name})
    # The extension is only cut off where it is lower-case already, so X.JPG is always renamed.
    cut = F.when(F.endswith("name", F.concat(F.lit("."), F.col("ext"))), F.expr("substring(name, 1, length(name) - length(ext) - 1)"))
    return out.withColumn("settled", split_counter(F.coalesce(cut, F.col("name")))["base"] == F.col("base"))


def _numbered_names(todo: DataFrame, taken: DataFrame) -> DataFrame:
    """(hash, path, new_name): the k-th file of a family by path gets its k-th free number.

    The j-th taken number h has h - j free ones before it, so the k-th free number is k plus the taken ones with
    h - j < k: a running count over both kinds of rows in that order.
    """
    family = Window.partitionBy("base", "ext")
    files = todo.withColumn("at", F.row_number().over(family.orderBy("path", "hash")).cast("long")).withColumn("held", F.lit(0))
    gaps = taken.select("base", "ext", "number").distinct()
    gaps = gaps.withColumn("at", F.col("number") - F.row_number().over(family.orderBy("number")) + 1)
    none = F.lit(None).cast("string")
    gaps = gaps.select("base", "ext", none.alias("hash"), none.alias("path"), none.alias("name"), "at", F.lit(1).alias("held"))
    order = family.orderBy("at", F.desc("held")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = F.col("at") + F.sum("held").over(order)
    rows = files.unionByName(gaps).withColumn("number", number).where("held = 0")
    counter = F.when(F.col("number") == 1, "").otherwise(F.concat(F.lit("_"), F.col("number").cast("string")))
    return rows.select("hash", "path", F.concat("base", counter, F.lit("."), "ext").alias("new_name"))


def _names_one_by_one(todo: DataFrame, taken: DataFrame) -> DataFrame:
    """_numbered_names where names become free on the way."""

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        held = set(part.loc[part["hash"].isna(), "name"])
        out = []
        for r in part[part["hash"].notna()].sort_values(["path", "hash"]).itertuples(index=False):
            name, n = f"{r.base}.{r.ext}", 2
            while name in held:
                name, n = f"{r.base}_{n}.{r.ext}", n + 1
            held.discard(r.name)
            held.add(name)
            out.append((r.hash, r.path, name))
        return pd.DataFrame(out, columns=["hash", "path", "new_name"])

    none = F.lit(None).cast("string")
    held = taken.join(todo.select("base", "ext").distinct(), ["base", "ext"], "left_semi")
    held = held.select("base", "ext", none.alias("hash"), none.alias("path"), F.col("held").alias("name"))
    return todo.unionByName(held).groupBy("base", "ext").applyInPandas(deal, "hash string, path string, new_name string")


def plan(files: DataFrame, pattern: str = DEFAULT_FORMAT, scope: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(ops, skipped): names from capture times, unique in the whole library by a counter _2, _3, …

    Files whose name is right but for a counter stay, so a second plan is empty.  A family of equal names (base and
    extension) is dealt out in path order (with %%n by its numbers): its counters are the free ones of the library's
    names, and a name is free if its holder is of the family's own plan and comes earlier.
    """
    own = files if scope is None else files.join(scope.select("hash").distinct(), "hash", "left_semi")
    todo = written(_wanted(own, pattern).where("NOT settled").select("base", "ext", "hash", "path", "name"))
    keys = todo.select("base", "ext").distinct()
    names = files.select(name_of(F.col("path")).alias("held")).distinct()
    # The numbers that are taken: base.ext holds 1, base_N.ext holds N.
    stem, ext = F.regexp_extract("held", r"^(.*)\.[^.]*$", 1), F.regexp_extract("held", r"\.([^.]*)$", 1)
    whole = F.struct(stem.alias("base"), F.lit(1).cast("long").alias("number"))
    counted = F.struct(
        F.regexp_extract("held", r"^(.*)_[1-9]\d{0,17}\.[^.]*$", 1).alias("base"),
        F.regexp_extract("held", r"_([1-9]\d{0,17})\.[^.]*$", 1).try_cast("long").alias("number"),
    )
    taken = names.select("held", ext.alias("ext"), F.explode(F.array(whole, counted)).alias("h"))
    taken = taken.select("h.base", "ext", "h.number", "held").where("base <> '' AND (number > 1 OR held = concat(base, '.', ext))")
    taken = written(taken.join(keys, ["base", "ext"], "left_semi"))
    # A name that a file of the family gives up is free for the files after it: such families are dealt file by file.
    giving = written(todo.join(taken, (todo["base"] == taken["base"]) & (todo["ext"] == taken["ext"]) & (todo["name"] == taken["held"]), "left_semi")
                     .select("base", "ext").distinct())
    dealt = _numbered_names(todo.join(giving, ["base", "ext"], "left_anti"), taken)
    if not giving.isEmpty():
        dealt = dealt.unionByName(_names_one_by_one(todo.join(giving, ["base", "ext"], "left_semi"), taken))
    problem = filename_problem(F.col("new_name"))
    folder = folder_of(F.col("path"))
    to = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.col("new_name"))
    ops = dealt.where(problem.isNull()).select(F.lit("rename").alias("kind"), "hash", F.col("path").alias("from"), to.alias("to"))
    return ops, dealt.where(problem.isNotNull()).select("path", problem.alias("reason"))
