"""Exact stratified split without ranking all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.encode import lookup
from tidemark.operators.sizing import broadcast_if_small, materialize, part_offsets, sorted_positions

# The keys of a boundary prefix with at most this many rows are counted one by one; a larger
# prefix is first cut finer.
RANK_ROWS = 1_000_000

_STEP = 4  # hex digits per level: 65,536 buckets
_DIGITS = 32


def split_key(id_column: str, seed: int) -> Column:
    """A row's place in a fixed random order: the MD5 text of seed and id."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_column).cast("string")).cast("binary"))


def train_quotas(sizes: DataFrame, rows: int, classes: int, test_size: float) -> DataFrame:
    """``_class, _want``: training rows per class, from a table of ``_class, n``.

    The test part has ceil(test_size * rows); the training rows are shared out in
    proportion, and what rounding leaves over goes to the largest remainders (ties: the
    smaller class value). The ranking is a sort across the cluster: there may be any number
    of classes.
    """
    train = rows - math.ceil(test_size * rows)
    if not classes or train < classes or rows - train < classes:
        raise ValueError(f"{rows} rows are too few to split {classes} classes at {test_size}")
    # The product of two counts may need more than 63 bits.
    share = f"CAST(n AS DECIMAL(19,0)) * CAST({train} AS DECIMAL(19,0))"
    whole = f"CAST({rows} AS DECIMAL(19,0))"
    base = F.expr(f"CAST(({share}) DIV {whole} AS BIGINT)").alias("_base")
    left = F.expr(f"-CAST(({share}) % {whole} AS BIGINT)").alias("_left")
    shares = sizes.select("_class", base, left)
    ranked = sorted_positions(shares, "_left", "_class").withColumn("_one", F.lit(1))
    spare = train - ranked.agg(F.sum("_base").alias("s")).first()["s"]
    # One row per partition of the sort.
    at = ranked.join(F.broadcast(part_offsets(ranked, "_one", "_before")), "_part")
    more = (F.col("_before") + F.col("_row") < spare).cast("bigint")
    return materialize(at.select("_class", (F.col("_base") + more).alias("_want")))


def stratified_split(
    df: DataFrame,
    id_column: str,
    label_column: str,
    test_size: float = 0.2,
    seed: int = 42,
    out: str = "split",
    rank_rows: int = RANK_ROWS,
) -> DataFrame:
    """Add ``out``: "train" or "test", with exact class ratios and the same rows every run.

    Within each class the rows with the smallest keys are the training part. The boundary
    key of each class is found by counting rows per key prefix, so only counts are
    shuffled; the rows themselves get their part from a comparison in a narrow pass.
    A null id or label is an error. Ids should be unique: rows with the same id go to the same
    part, so a repeated id at a class's boundary moves the ratio by as many rows.
    ``df`` is read a few times, mostly for two columns, so it should be a stored table.
    """
    label = F.col(label_column)
    open_keys = df.select(label.alias("_class"), split_key(id_column, seed).alias("_key"))
    counts = _prefix_counts(open_keys, _STEP)

    sizes = materialize(
        counts.groupBy("_class").agg(
            F.sum("n").alias("n"),
            F.coalesce(F.sum(F.when(F.col("_prefix").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        )
    )
    unlabelled = F.sum(F.when(F.col("_class").isNull(), F.col("n"))).alias("unlabelled")
    whole = sizes.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("nameless").alias("nameless"), unlabelled
    ).first()
    if whole["nameless"]:
        raise ValueError(f"{whole['nameless']} rows with null in {id_column}")
    if whole["unlabelled"]:
        raise ValueError(f"{whole['unlabelled']} rows with null in {label_column}")
    want = train_quotas(sizes.select("_class", "n"), whole["n"] or 0, whole["k"], test_size)

    digits = _STEP
    while True:
        boundary = _boundary(counts, want)
        if digits == _DIGITS:
            break
        widest = boundary.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        # Keep the rows of the boundary prefixes only, and look at more of their keys.
        inside = _broadcast(boundary.select("_class", "_prefix"))
        open_keys = (
            open_keys.withColumn("_prefix", F.substring("_key", 1, digits))
            .join(inside, ["_class", "_prefix"])
            .select("_class", "_key")
        )
        want = boundary.select("_class", "_want")
        digits = _DIGITS if widest <= rank_rows else digits + _STEP
        counts = _prefix_counts(open_keys, digits)

    # A class without a limit has no training row.
    limit = fresh_name(df, "_limit")
    limits = boundary.select(F.col("_class").alias("label"), F.col("_prefix").alias("code"))
    limits = limits.join(_broadcast(sizes.select(F.col("_class").alias("label"), F.col("n").alias("rows"))), "label")
    part = F.when(split_key(id_column, seed) <= F.col(limit), F.lit("train")).otherwise(F.lit("test"))
    joined = lookup(df, label_column, materialize(limits), limit, whole["n"])
    return joined.select(*df.columns, part.alias(out))


def fresh_name(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def _broadcast(table: DataFrame) -> DataFrame:
    """The table with a broadcast hint if its measured size allows one."""
    sent = broadcast_if_small(table)
    return table if sent is None else sent


def _prefix_counts(keys: DataFrame, digits: int) -> DataFrame:
    """Rows per class and key prefix."""
    prefix = F.substring("_key", 1, digits).alias("_prefix")
    return materialize(keys.groupBy("_class", prefix).agg(F.count(F.lit(1)).alias("n")))


def _boundary(counts: DataFrame, want: DataFrame) -> DataFrame:
    """Per class, the prefix in which the last wanted row lies, and how many it still takes.

    The running count goes over the prefixes of one level: at most 65,536 per class, or the
    keys of a boundary prefix with at most ``rank_rows`` rows.
    """
    upto = F.sum("n").over(Window.partitionBy("_class").orderBy("_prefix"))
    placed = counts.join(_broadcast(want), "_class").withColumn("_upto", upto)
    below = F.col("_upto") - F.col("n")
    holds = (below < F.col("_want")) & (F.col("_upto") >= F.col("_want"))
    return materialize(placed.where(holds).select("_class", "_prefix", (F.col("_want") - below).alias("_want"), "n"))
