"""Helpers that keep plans safe when data grows: checked broadcasts and sorted positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import enable_checkpoints, scratch_path

# What one executor can hold next to its other work, far below Spark's own 8 GB limit.
BROADCAST_BYTES = 64 * 1024 * 1024

# monotonically_increasing_id keeps the partition number above this bit, the row below it.
_ROW_BITS = 33


def materialize(df: DataFrame) -> DataFrame:
    """Run a plan with a small result once and continue from its checkpoint.

    The files are in the shared folder and outlive any executor, so a lost one never causes
    a different re-run.
    """
    enable_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As ``materialize`` for a result that grows with the data: a table in the shared folder.

    It is compressed, and what follows reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def measured_bytes(df: DataFrame) -> int:
    """An upper estimate of a materialized table's size, from its rows and text lengths."""
    widths = [
        F.octet_length(F.col(f.name)) if f.dataType.typeName() == "string" else F.lit(16) for f in df.schema.fields
    ]
    total = F.lit(32)
    for width in widths:
        total = total + F.coalesce(width, F.lit(0))
    return df.agg(F.coalesce(F.sum(total.cast("bigint")), F.lit(0)).alias("b")).first()["b"]


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame | None:
    """The table with a broadcast hint, or None when it is too large for one."""
    return F.broadcast(df) if measured_bytes(df) <= limit else None


def sorted_positions(df: DataFrame, *order: str) -> DataFrame:
    """Sort across the cluster and add ``_part`` and ``_row``, the place in the sort order.

    Rows of a lower ``_part`` come first; inside one, ``_row`` counts from 0. The result is
    stored because range boundaries are sampled again in every run.
    """
    ordered = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    return (
        store(ordered)
        .withColumn("_part", F.shiftright("_place", _ROW_BITS).cast("int"))
        .withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_place")
    )


def part_offsets(positioned: DataFrame, value: str, out: str) -> DataFrame:
    """Per ``_part``, the total of ``value`` over all earlier parts.

    The window runs over one row per partition of the sort, never over the data.
    """
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (
        positioned.groupBy("_part")
        .agg(F.sum(value).alias("_total"))
        .select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias(out))
    )
