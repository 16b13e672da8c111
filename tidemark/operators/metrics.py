"""Classifier metrics as DataFrames, exact at any size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import CLASS_NAMES

_WHOLE = "decimal(38,0)"
_RANGE_SCHEMA = f"_part int, _won {_WHOLE}, _pos bigint, _neg bigint, _bad bigint"


def range_fold() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function that folds a sorted range of scores to one row.

    The row holds the range's counts, and twice the pairs won inside it. A batch holds
    positives, negatives, the range's number and, if they are counted, the rows that cannot be
    ranked. Sums are exact: counts too large for
    64-bit products are multiplied as Python numbers. The function is nested so that it
    travels to the workers by value, whether or not they can import this package.
    """

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, won, positives, negatives, bad = None, 0, 0, 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            pos, neg = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = batch.column(2)[0].as_py()
            pos_total, neg_total = int(pos.sum()), int(neg.sum())
            below = np.cumsum(neg) - neg
            if 2 * pos_total * neg_total >= 2**63:
                pos, neg, below = pos.astype(object), neg.astype(object), below.astype(object)
            won += int(np.dot(pos, 2 * below + neg)) + 2 * negatives * pos_total
            positives, negatives = positives + pos_total, negatives + neg_total
            if batch.num_columns > 3:
                bad = (bad or 0) + int(batch.column(3).to_numpy().sum())
        if part is not None:
            columns = {
                "_part": pa.array([part], pa.int32()),
                "_won": pa.array([Decimal(won)], pa.decimal128(38, 0)),
                "_pos": pa.array([positives], pa.int64()),
                "_neg": pa.array([negatives], pa.int64()),
            }
            if bad is not None:
                columns["_bad"] = pa.array([bad], pa.int64())
            yield pa.RecordBatch.from_pydict(columns)

    return fold


def auc_roc(df: DataFrame, score: str, label: str, positive=1) -> DataFrame:
    """Area under the ROC curve: one row ``(auc_roc, positives, negatives)``.

    It is the share of (positive, negative) pairs that the score orders correctly, a tie
    counting half. Rows are first counted per score, so equal scores collapse before the
    shuffle, and the scores are then sorted across the cluster. Each sorted range is folded
    to one row where it lies; a window over ranges would need a third shuffle of all
    scores. What is left is one row per range, to which the negatives of the lower ranges
    are added. Sums are whole numbers, with one division at the end. Null when a class is
    missing. Rows without a label, or with a score that is null or NaN, are an error that
    names their number.
    """
    is_positive = F.col(label) == F.lit(positive)
    unknown = F.col(label).isNull() | F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    per_score = df.groupBy(F.col(score).alias("_score")).agg(
        F.count_if(is_positive).alias("_pos"),
        F.count_if(~is_positive).alias("_neg"),
        F.count_if(unknown).alias("_bad"),
    )
    ranges = (
        per_score.orderBy("_score")
        .select("_pos", "_neg", F.spark_partition_id().alias("_part"), "_bad")
        .mapInArrow(range_fold(), _RANGE_SCHEMA)
    )
    # One row per partition of the sort from here on.
    lower = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_neg").over(lower), F.lit(0)).cast("decimal(18,0)")
    lifted = ranges.withColumn("_won", F.col("_won") + F.col("_pos").cast("decimal(18,0)") * earlier * F.lit(2))
    summed = lifted.agg(
        F.sum(F.col("_won").cast(_WHOLE)).alias("_won"),
        F.coalesce(F.sum("_pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("_neg"), F.lit(0)).alias("negatives"),
        F.coalesce(F.sum("_bad"), F.lit(0)).alias("_bad"),
    )
    pairs = F.col("positives").cast("decimal(18,0)") * F.col("negatives").cast("decimal(18,0)") * F.lit(2)
    told = F.concat(F.col("_bad").cast("string"), F.lit(f" rows with null or NaN in {label} or {score}"))
    value = F.when(F.col("_bad") > 0, F.raise_error(told).cast("double")).when(
        (F.col("positives") > 0) & (F.col("negatives") > 0), F.col("_won").cast("double") / pairs.cast("double")
    )
    return summed.select(value.alias("auc_roc"), "positives", "negatives")


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Rows per actual and predicted class."""
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("rows")
    )


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def classification_report(
    df: DataFrame, label: str, prediction: str, names: Mapping[int, str] | None = None
) -> DataFrame:
    """``(name, precision, recall, f1_score, support)`` per class, then accuracy and averages.

    One aggregate yields one row of counts; the lines are expressions over that row. Labels or
    predictions that are null or not in ``names`` are an error that names their number.
    """
    names = names or CLASS_NAMES
    actual, predicted = F.col(label), F.col(prediction)
    counts = [F.count(F.lit(1)).alias("n"), F.count_if(actual == predicted).alias("hits")]
    for i, value in enumerate(names):
        is_actual, is_predicted = actual == F.lit(value), predicted == F.lit(value)
        counts += [
            F.count_if(is_actual & is_predicted).alias(f"tp{i}"),
            F.count_if(is_predicted).alias(f"pred{i}"),
            F.count_if(is_actual).alias(f"sup{i}"),
        ]

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("name"),
            precision.cast("double").alias("precision"),
            recall.cast("double").alias("recall"),
            f1.cast("double").alias("f1_score"),
            support.cast("bigint").alias("support"),
        )

    lines, measures = [], []
    for i, name in enumerate(names.values()):
        tp, pred, sup = F.col(f"tp{i}"), F.col(f"pred{i}"), F.col(f"sup{i}")
        measure = (_share(tp, pred), _share(tp, sup), _share(tp * 2, pred + sup))
        measures.append((measure, sup))
        lines.append(line(name, *measure, sup))

    def average(k: int, weighted: bool) -> Column:
        terms = [m[k] * sup if weighted else m[k] for m, sup in measures]
        total = terms[0]
        for term in terms[1:]:
            total = total + term
        return _share(total, F.col("n")) if weighted else total / F.lit(float(len(measures)))

    n, none = F.col("n"), F.lit(None)
    lines.append(line("accuracy", none, none, _share(F.col("hits"), n), n))
    lines.append(line("macro avg", *[average(k, False) for k in range(3)], n))
    lines.append(line("weighted avg", *[average(k, True) for k in range(3)], n))

    def listed(prefix: str) -> Column:
        total = F.lit(0)
        for i in range(len(names)):
            total = total + F.col(f"{prefix}{i}")
        return total

    unnamed = (n - listed("sup")) + (n - listed("pred"))
    where = F.lit(f" values of {label} or {prediction} are in none of the named classes")
    told = F.concat(unnamed.cast("string"), where)
    table = F.array(*lines)
    # The error has the type of the lines, so the frame's columns do not depend on the data.
    stop = F.array_repeat(F.element_at(table, 1), F.raise_error(told).cast("int"))
    return df.agg(*counts).select(F.inline(F.when(unnamed > 0, stop).otherwise(table)))
