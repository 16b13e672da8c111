"""Connected components of an edge table, without taking it to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.sizing import store


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One step: each vertex hangs its larger (or, if ``small``, smaller) neighbours on its least one."""
    if small:
        around = edges
    else:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The least neighbour is found by a sum in the tasks first, so a hub is no hot key there; in the
    # join below both sides are plain tables, which lets Spark split a hub's rows.
    least = store(around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    joined = around.join(least, "u")
    if small:
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
    else:
        hung = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return store(hung.where("u > v").distinct())


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` of all vertices of ``edges`` (two whole-number columns): the least reachable id.

    Large and small stars alternate until nothing changes, which takes about the logarithm of
    the longest chain in steps. Self-loops and repeated edges do no harm.
    """
    a, b = edges.columns
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    stars, mark = store(pairs.where("u > v").distinct()), None
    while True:
        mixed = F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        now = stars.agg(F.count(F.lit(1)).alias("n"), mixed.alias("h")).first()
        if now == mark or not now["n"]:
            break
        mark = now
        stars = _star(_star(stars, small=False), small=True)
    roots = stars.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
