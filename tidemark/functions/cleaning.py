"""Column expressions that turn raw text into typed values.

Casts are ``try_cast`` throughout: a value that does not parse becomes null with ANSI mode
on or off, instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def to_int(c: Column) -> Column:
    """Whole part of a number or of its text: ``"3"``, ``"3.7"`` and ``3.7`` all give 3."""
    return c.try_cast("double").try_cast("int")


def blank_to_double(c: Column) -> Column:
    """Number from text in which a missing value is written as spaces."""
    return F.nullif(F.trim(c.cast("string")), F.lit("")).try_cast("double")


def flag(predicate: Column) -> Column:
    """1 where the predicate holds, 0 where it does not or is unknown."""
    return F.coalesce(predicate.cast("int"), F.lit(0))


def yes_flag(c: Column) -> Column:
    """1 for "yes" in any case; the text is not trimmed, so " yes" is 0."""
    return flag(F.lower(c) == "yes")
