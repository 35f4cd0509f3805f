"""Names, paths and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(col: Column) -> Column:
    """Lower case without outer spaces; only letters, digits and underscores, with underscores for runs of spaces and hyphens."""
    low = F.lower(F.trim(col))
    return F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9_\s-]", ""), r"[\s-]+", "_")


def joined_sorted(values: Column, separator: str = "_") -> Column:
    return F.array_join(F.array_sort(values), separator)


def position_of(path: Column, strict: bool = False) -> Column:
    """The number after the first P in a path's last part; null if there is none, or an error if strict."""
    found = F.nullif(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "P([0-9]+)", 1), F.lit("")).cast("int")
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no position in "), path)).cast("int")) if strict else found


def frame_in_name(name: Column, default: int | None = None, last: bool = True) -> Column:
    """The number after the last (or first) T in a name."""
    found = F.regexp_extract_all(name, F.lit("T([0-9]+)"), F.lit(1))
    return F.coalesce(F.try_element_at(found, F.lit(-1 if last else 1)).cast("int"), F.lit(default).cast("int"))


def date_part(name: Column) -> Column:
    return F.split(name, "_")[0]


def label_of(date: Column, shears: Column) -> Column:
    """date (a dyn/cm2), or date (a-b dyn/cm2) with two conditions."""
    return F.concat(date, F.lit(" ("), F.array_join(F.transform(shears, lambda s: s.cast("int").cast("string")), "-"), F.lit(" dyn/cm2)"))


def is_dataset_key(name: Column) -> Column:
    return name.rlike("20[0-9]{6}_")


def uri_parts(uri: Column) -> Column:
    """bucket, key and suffix of an address."""
    return F.struct(
        F.regexp_extract(uri, "^[a-z0-9]+://([^/]+)", 1).alias("bucket"),
        F.regexp_extract(uri, "^[a-z0-9]+://[^/]+/(.*)$", 1).alias("key"),
        F.regexp_extract(uri, r"(\.[A-Za-z0-9]+)$", 1).alias("suffix"),
    )
