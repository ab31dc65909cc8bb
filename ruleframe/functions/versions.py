"""Versions as arrays of numbers, and their comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version(text: Column, parts: int = 4) -> Column:
    """The first run of dotted numbers, padded with zeros to ``parts`` numbers; null where there is none."""
    digits = F.regexp_extract(text, r"v?([0-9]+(?:\.[0-9]+)*)", 1)
    numbers = F.transform(F.split(digits, r"\."), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))
    return F.when(digits != "", F.slice(F.concat(numbers, F.array_repeat(F.lit(0).cast("long"), parts)), 1, parts))


def ordered(text: Column) -> Column:
    """Versions as values that sort as versions do: up to eight numbers, then a pre-release (``1.0-rc1``) before its release."""
    pre = F.regexp_extract(text, r"^v?[0-9]+(?:\.[0-9]+)*-([0-9A-Za-z.~-]+)(?:\+.*)?$", 1)
    numbers = version(text, 8)
    return F.when(numbers.isNotNull(), F.struct(numbers.alias("numbers"), (pre == "").alias("release"), pre.alias("pre")))


def within_bounds(text: Column, lower: str | None, upper: str | None) -> Column:
    """Inclusive bounds; no version or no bounds match."""
    if not lower and not upper:
        return F.lit(True)
    own, out = ordered(text), F.lit(True)
    if lower:
        out = out & (own >= ordered(F.lit(lower)))
    if upper:
        out = out & (own <= ordered(F.lit(upper)))
    return F.coalesce(text, F.lit("")).isin("") | F.coalesce(out, F.lit(False))


def semver(text: Column) -> Column:
    """``v1``, ``v1.2``, ``v1.2.3`` as numbers; null for anything else."""
    return F.when(text.rlike(r"^v\d+(\.\d+){0,2}$"), version(text, 3))


def latest(rows):
    """The last of ``rows(version)`` in descending order of text, as listings of releases are read."""
    return rows.agg(F.max("version").alias("version"))
