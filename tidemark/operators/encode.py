"""Category text to codes, for any number of categories and any skew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sizing import BROADCAST_BYTES, broadcast_if_small, part_offsets, sorted_positions
from tidemark.session import scratch_path

_CODES = "label string, code int, rows long, place int"

# A label with at least this share of all rows is joined by broadcast; there can be no more
# than 1 / HOT_SHARE of them, and a label below it is small enough for one shuffle task.
HOT_SHARE = 1e-5


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """``(label, code, rows)``: codes 0..k-1 in the labels' sort order, nulls left out."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    placed = sorted_positions(counts, "label").withColumn("_one", F.lit(1))
    offsets = part_offsets(placed, "_one", "_before")
    # One row per partition of the sort, so the broadcast is bounded by the partition count.
    return placed.join(F.broadcast(offsets), "_part").select(
        "label", (F.col("_before") + F.col("_row")).cast("int").alias("code"), F.col("n").alias("rows")
    )


def lookup(
    df: DataFrame,
    column: str,
    table: DataFrame,
    out: str,
    rows: int,
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Add ``out``, the ``code`` of the row's ``column`` in ``table (label, code, rows)``; null if it is not there.

    A table of checked size is broadcast. A larger one is joined by a shuffle, after the
    frequent labels (a bounded number) were joined by broadcast, so that no task gets the rows
    of a hot label. ``rows`` is the sum of the table's ``rows``.
    """
    columns = [df[name] for name in df.columns]
    named = table.select(F.col("label").alias("_lookup_label"), F.col("code").alias("_lookup_code"), "rows")
    small = broadcast_if_small(named.drop("rows"), broadcast_bytes)
    if small is not None:
        joined = df.join(small, df[column] == small["_lookup_label"], "left")
        return joined.select(*columns, small["_lookup_code"].alias(out))

    hot = None
    while hot is None:
        is_hot = F.col("rows") >= F.lit(rows * hot_share)
        hot = broadcast_if_small(named.where(is_hot).drop("rows"))
        # Long labels may not fit; ask for a larger share, which fewer of them have.
        hot_share *= 10
    tagged = df.join(hot, df[column] == hot["_lookup_label"], "left").select(*columns, hot["_lookup_code"].alias(out))
    found = F.col(out).isNotNull() | F.col(column).isNull()
    cold = named.where(~is_hot).drop("rows")
    rest = tagged.where(~found).drop(out).join(cold, F.col(column) == F.col("_lookup_label"), "left")
    return tagged.where(found).unionByName(rest.select(*df.columns, F.col("_lookup_code").alias(out)))


def label_encode(
    df: DataFrame,
    column: str,
    out: str,
    nulls: str = "keep",
    broadcast_bytes: int = BROADCAST_BYTES,
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Add ``out``, the place of the row's label among all labels in sort order.

    Nulls get the next code after the last label (``keep``), stop the job (``error``) or
    drop the row (``skip``). The codes are joined as ``lookup`` says. ``df`` is read for its
    labels first, and then once or twice in full, so it should be a stored table.
    """
    if nulls not in ("keep", "error", "skip"):
        raise ValueError(f"nulls must be keep, error or skip, not {nulls}")
    codes = label_codes(df, column)
    size = codes.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("rows"), F.lit(0)).alias("n")).first()
    null_code = (
        F.raise_error(F.lit(f"null in {column}")).cast("int") if nulls == "error" else F.lit(size["k"]).cast("int")
    )
    source = df.where(F.col(column).isNotNull()) if nulls == "skip" else df
    coded = lookup(source, column, codes, out, size["n"], broadcast_bytes, hot_share)
    return coded.withColumn(out, F.when(F.col(column).isNull(), null_code).otherwise(F.col(out)))


def code_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(place, label, code, rows)`` of several columns from one pass: ``label_codes`` of each, by its place.

    Labels are compared as text.
    """
    each = [F.struct(F.lit(i).alias("place"), F.col(c).cast("string").alias("label")) for i, c in enumerate(columns)]
    counts = (
        df.select(F.explode(F.array(*each)).alias("c"))
        .where("c.label IS NOT NULL")
        .groupBy("c.place", "c.label")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    placed = sorted_positions(counts, "place", "label").withColumn("_one", F.lit(1))
    at = placed.join(F.broadcast(part_offsets(placed, "_one", "_before")), "_part")
    at = at.withColumn("_at", F.col("_before") + F.col("_row"))
    # One row per column.
    first = at.groupBy("place").agg(F.min("_at").alias("_first"))
    return at.join(F.broadcast(first), "place").select(
        "place", "label", (F.col("_at") - F.col("_first")).cast("int").alias("code"), "rows"
    )


class CategoryCodes(Transformer, MLWritable, MLReadable):
    """A pipeline stage that adds codes by joining a stored table of them.

    The stage holds the table's path and a few numbers per column, no labels, so a column may
    have any number of them. Nulls and labels that were not there when the table was made get
    the code after the last label. Saved, the stage has a copy of the table next to it.
    """

    columns = Param(Params._dummy(), "columns", "columns to encode", TypeConverters.toListString)
    outputs = Param(Params._dummy(), "outputs", "names of the code columns", TypeConverters.toListString)
    path = Param(Params._dummy(), "path", "where the table of codes is", TypeConverters.toString)
    labels = Param(Params._dummy(), "labels", "labels of each column", TypeConverters.toListInt)
    rows = Param(Params._dummy(), "rows", "rows with a label of each column", TypeConverters.toListInt)

    def table(self) -> DataFrame:
        spark = SparkSession.active()
        return spark.read.schema(_CODES).parquet(self.getOrDefault(self.path))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        codes, order = self.table(), dataset.columns
        sizes = zip(self.getOrDefault(self.labels), self.getOrDefault(self.rows), strict=True)
        names = zip(self.getOrDefault(self.columns), self.getOrDefault(self.outputs), strict=True)
        for place, ((column, out), (labels, rows)) in enumerate(zip(names, sizes, strict=True)):
            mine = codes.where(F.col("place") == place).drop("place")
            dataset = lookup(dataset, column, mine, out, rows).withColumn(out, F.coalesce(out, F.lit(labels)))
            order = [*order, out]
        return dataset.select(*order)

    def write(self) -> MLWriter:
        return _CodesWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _CodesReader(cls)


class _CodesWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.instance.table().write.partitionBy("place").parquet(f"{path}/codes")


class _CodesReader(DefaultParamsReader):
    def load(self, path: str) -> CategoryCodes:
        codes = super().load(path)
        return codes.copy({codes.path: f"{path}/codes"})


def category_codes(df: DataFrame, columns: Sequence[str], outputs: Sequence[str]) -> CategoryCodes:
    """The stage fitted on all rows of ``df``: codes in sort order of the labels as text."""
    path = scratch_path(df.sparkSession, "codes")
    # A folder per column, so that each is read alone.
    code_table(df, columns).write.partitionBy("place").parquet(path)
    stored = df.sparkSession.read.schema(_CODES).parquet(path)
    sizes = stored.groupBy("place").agg(F.count(F.lit(1)).alias("k"), F.sum("rows").alias("n")).collect()
    of = {r["place"]: (r["k"], r["n"]) for r in sizes}
    codes = CategoryCodes()
    labels, rows = zip(*[of.get(i, (0, 0)) for i in range(len(columns))], strict=True)
    for name, value in {
        "columns": list(columns),
        "outputs": list(outputs),
        "path": path,
        "labels": list(labels),
        "rows": list(rows),
    }.items():
        codes.set(codes.getParam(name), value)
    return codes
