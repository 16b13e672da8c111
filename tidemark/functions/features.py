"""Column expressions for model features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.cleaning import flag


def flag_equals(c: Column, value) -> Column:
    return flag(c == F.lit(value))


def flag_not_equals(c: Column, value) -> Column:
    return flag(c != F.lit(value))


def flag_above(c: Column, threshold) -> Column:
    """1 strictly above the threshold."""
    return flag(c > F.lit(threshold))


def guarded_ratio(numerator: Column, denominator: Column, fallback: Column) -> Column:
    """numerator / denominator for a positive denominator, else the fallback.

    A null denominator takes the fallback; a null numerator over a positive denominator
    stays null.
    """
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)
