"""Capture times: out of names, into names, and in batches."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The formats of names.
OWN = r"(?i)^(\d{2})-(\d{2})-(\d{2})_(am|pm)_(\d{2})_([a-z]{3})_(\d{4})"
CAMERA = r"(\d{8})[_-](\d{6})"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DEFAULT_FORMAT = "%I-%M-%S_%p_%d_%b_%Y"
#: What a pattern can hold, as Spark's date_format has it.
CODES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "p": "a", "b": "MMM",
    "B": "MMMM", "j": "DDD", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm",
}
COUNTER = "%%n"


def from_filename(name: Column) -> Column:
    """The time in a file name: the engine's own format, else a camera's; null if neither is a valid time."""
    part = lambda i: F.regexp_extract(name, OWN, i)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(part(6)))
    hour = F.try_mod(part(1).try_cast("int"), F.lit(12)) + F.when(F.lower(part(4)) == "pm", 12).otherwise(0)
    # Hours over 12 are no times in this format, except that 00 counts as 12.
    whole = F.when(part(1).try_cast("int") > 12, F.when(F.lower(part(4)) == "am", part(1).try_cast("int"))).otherwise(hour)
    own = F.try_to_timestamp(
        F.concat(part(7), F.lpad(month.cast("string"), 2, "0"), part(5), F.lpad(whole.cast("string"), 2, "0"), part(2), part(3)),
        F.lit("yyyyMMddHHmmss"),
    )
    digits = F.concat(F.regexp_extract(name, CAMERA, 1), F.regexp_extract(name, CAMERA, 2))
    camera = F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMddHHmmss"))
    return F.when(name.rlike(OWN), own).otherwise(camera)


def resolve(exif: Column, name: Column, mtime: Column) -> Column:
    """(taken_at, taken_src): EXIF's time, else the name's, else the file's."""
    named = from_filename(name)
    source = F.when(exif.isNotNull(), "exif").when(named.isNotNull(), "filename").otherwise("mtime")
    return F.struct(F.coalesce(exif, named, mtime).alias("taken_at"), source.alias("taken_src"))


def parse_picker(text: Column) -> Column:
    """A date and time as pickers write it, of the years 1900 to 9999; else null."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss")
    at = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in forms))
    return F.when(F.year(at).between(1900, 9999), at)


def java_pattern(pattern: str) -> str | None:
    """A strftime pattern as date_format's, or None if it holds what isn't known."""
    out, at = "", 0
    for m in re.finditer(r"%(.?)", pattern):
        literal = pattern[at : m.start()]
        at = m.end()
        if m[1] == "%":
            literal += "%"
            code = ""
        elif m[1] in CODES and m[1]:
            code = CODES[m[1]]
        else:
            return None
        out += (("'" + literal.replace("'", "''") + "'") if literal else "") + code
    literal = pattern[at:]
    return out + (("'" + literal.replace("'", "''") + "'") if literal else "")


def format_stem(at: Column, pattern: str) -> Column:
    """A time as a file's stem, lower-cased."""
    java = java_pattern(pattern)
    if not java:
        raise ValueError(f"{pattern!r} is not a pattern that can be read")
    return F.lower(F.date_format(at, java))


def iso_week(at: Column) -> Column:
    """'2026-34': the ISO year and week."""
    year = F.extract(F.lit("YEAROFWEEK"), at).cast("string")
    return F.concat_ws("-", year, F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def batch(at: Column, place: Column) -> Column:
    """(id, title): a trip by ISO week and place, else a day, else undated."""
    day = F.concat_ws(" ", F.dayofmonth(at).cast("string"), F.date_format(at, "MMMM"))
    id_ = (
        F.when(at.isNull(), "undated")
        .when(place.isNotNull(), F.concat(F.lit("trip:"), iso_week(at), F.lit(":"), place))
        .otherwise(F.concat(F.lit("day:"), F.date_format(at, "yyyy-MM-dd")))
    )
    title = (
        F.when(at.isNull(), "Undated").when(place.isNotNull(), F.concat(F.lit("Trip · "), place)).otherwise(day)
    )
    return F.struct(id_.alias("id"), title.alias("title"))
