"""String, time and JSON helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(c: Column) -> Column:
    return F.left(c, F.lit(8))


def slug(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def padded(c: Column, width: int = 3) -> Column:
    """Zeros in front up to `width`; a longer number stays whole."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def or_empty_mark(c: Column) -> Column:
    """A null or blank text is `[empty]`."""
    return F.when(c.isNull() | c.rlike(r"^\s*$"), "[empty]").otherwise(c)


def abbreviated(c: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), c), c) if pairs else c


def iso_micros(c: Column) -> Column:
    return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def shown_time(c: Column) -> Column:
    """A time as people read it; a null one is a dash."""
    return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def exif_time(c: Column) -> Column:
    """A time as image files have it; a null one is empty."""
    return F.coalesce(F.date_format(c.cast("timestamp"), "yyyy:MM:dd HH:mm:ss"), F.lit(""))


def age_seconds(c: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(c)


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def first_part(c: Column, separator_regex: str) -> Column:
    return F.split(c, separator_regex, 2)[0]
