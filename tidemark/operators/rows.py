"""Row and column operators used by the stages."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table does not have the columns a stage needs."""


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """Reject a frame that lacks a column; renames and selects would hide some of those."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ContractError(f"{what} lacks column(s) {', '.join(missing)}")
    return df


def require_schema(df: DataFrame, schema: T.StructType, what: str = "table") -> DataFrame:
    """Reject a frame whose columns are missing or have another type; extra ones are fine."""
    require_columns(df, schema.names, what)
    wrong = [
        f"{f.name} is {df.schema[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}"
        for f in schema.fields
        if df.schema[f.name].dataType != f.dataType
    ]
    if wrong:
        raise ContractError(f"{what}: {'; '.join(wrong)}")
    return df


def project(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The listed columns in the listed order."""
    return df.select(*names)


def derive(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add or replace columns in one projection; none may refer to another one of them."""
    return df.withColumns(dict(columns))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns, insisting that each exists."""
    return require_columns(df, names, "rename").withColumnsRenamed(dict(names))


def flatten_struct(df: DataFrame, name: str) -> DataFrame:
    """The fields of a struct column as top-level columns."""
    return df.select(f"{name}.*")


def drop_null_rows(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop a row when any listed column is null."""
    return df.dropna(how="any", subset=list(names))


def dedup_key(df: DataFrame, key: str, prefer: Column | None = None) -> DataFrame:
    """One row per key: the smallest by the other columns in order, nulls first.

    The rule makes the survivor the same in every run. It is an aggregate, so copies of a
    hot key collapse in the map tasks and each task sends at most one row per key; null
    keys form one group. ``prefer`` ranks rows for which it is true before the others.
    """
    rest = [F.col(name) for name in df.columns if name != key]
    if not rest:
        return df.distinct()
    rank = [] if prefer is None else [F.coalesce(~prefer, F.lit(True)).alias("_rank")]
    chosen = df.groupBy(key).agg(F.min(F.struct(*rank, *rest)).alias("_row"))
    return chosen.select(*[key if name == key else F.col(f"_row.{name}").alias(name) for name in df.columns])
