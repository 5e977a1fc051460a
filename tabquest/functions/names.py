"""Names of tables, records and files, and blank-aware string helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separators.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def strip(value: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` knows spaces only)."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def non_blank(value: Column) -> Column:
    """The stripped text, or null when nothing is left."""
    return F.nullif(strip(value), F.lit(""))


def first_non_blank(*values: Column) -> Column:
    """The first value that is not blank, stripped; the empty string if none is."""
    return F.coalesce(*[non_blank(v) for v in values], F.lit(""))


def fold(value: Column) -> Column:
    """Strip and lower-case a name for case-insensitive comparison; null becomes ''."""
    return F.lower(strip(F.coalesce(value, F.lit(""))))


def normalize_name(value: Column, strict: bool = True) -> Column:
    """Turn any text into a lower-case identifier.

    Runs of other characters become one underscore, outer underscores go, and a
    leading digit gets the prefix ``dataset_``.  A text without letters or
    digits fails the job when ``strict``; otherwise it gives null, so that a
    caller can route the row to a reject output.
    """
    words = F.regexp_replace(F.lower(strip(value)), "[^a-z0-9]+", "_")
    name = F.regexp_replace(words, "^_+|_+$", "")
    prefixed = F.when(name.rlike("^[0-9]"), F.concat(F.lit("dataset_"), name)).otherwise(name)
    missing = (
        F.raise_error(F.concat(F.lit("Cannot derive a valid table name from: "), value)).cast("string")
        if strict
        else F.lit(None).cast("string")
    )
    return F.when(name == "", missing).otherwise(prefixed)


def file_stem(path: Column) -> Column:
    """The last path segment without its last extension (a leading dot is kept)."""
    trimmed = F.regexp_replace(path, "/+$", "")
    segment = F.regexp_extract(trimmed, "([^/]*)$", 1)
    return F.regexp_replace(segment, r"(?<=.)\.[^.]+$", "")


def table_name_of(table_name: Column, dataset_name: Column, file_path: Column, strict: bool = True) -> Column:
    """Name of a manifest entry's table: explicit name, else dataset name, else file stem."""
    return normalize_name(
        F.coalesce(non_blank(table_name), non_blank(dataset_name), file_stem(file_path)), strict
    )
