"""Counting operators, each a single aggregate job with map-side combine."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_count(df: DataFrame, out: str = "rows") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(out))


def distinct_values(name: str) -> Column:
    """Aggregate: number of distinct values, where null counts as one value."""
    has_null = F.coalesce(F.max(F.col(name).isNull().cast("bigint")), F.lit(0))
    return F.count_distinct(F.col(name)) + has_null


def distinct_count(df: DataFrame, name: str, out: str = "distinct_values") -> DataFrame:
    return df.agg(distinct_values(name).alias(out))


def null_counts(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Nulls of each column, all in one pass."""
    return df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in names])


def duplicate_keys(df: DataFrame, name: str) -> DataFrame:
    """The keys that occur more than once, with their row counts."""
    return df.groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
