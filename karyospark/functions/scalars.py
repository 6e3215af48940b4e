"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapse_runs(text: Column) -> Column:
    """Neighbouring equal characters as one."""
    return F.regexp_replace(text, r"(?s)(.)\1+", "$1")


def ranges_overlap(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    return F.greatest(lo_a, lo_b) <= F.least(hi_a, hi_b)


def tuple_key(*parts: Column) -> Column:
    return F.concat_ws("_", *parts)


def distinct_flatten(nested: Column) -> Column:
    return F.array_distinct(F.flatten(nested))


def dot_size(bitscore: Column, most: Column) -> Column:
    return 60 * bitscore / most
