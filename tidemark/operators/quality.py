"""Quality checks on a table: one aggregate job, a report, and a gate that stops the run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.config import JobConfig
from tidemark.operators.counts import distinct_values


class QualityError(AssertionError):
    """At least one check failed; the message names each with its counts."""


@dataclass(frozen=True)
class Check:
    """One check: ``observed`` is an aggregate, ``expected`` and ``passed`` follow from it.

    ``rows`` in the last two is the table's row count.
    """

    name: str
    column: str | None
    observed: Column
    expected: Column
    operator: str = "="

    def passed(self, observed: Column) -> Column:
        return observed >= self.expected if self.operator == ">=" else observed == self.expected


def not_null(column: str) -> Check:
    return Check("not_null", column, F.count_if(F.col(column).isNull()), F.lit(0).cast("bigint"))


def unique(column: str) -> Check:
    """As many distinct keys as rows; a null key counts as one key."""
    return Check("unique", column, distinct_values(column), F.col("rows"))


def in_set(column: str, values: Sequence) -> Check:
    """Counts values outside the set. A null is not counted: ``not_null`` is its check."""
    return Check("in_set", column, F.count_if(~F.col(column).isin(*values)), F.lit(0).cast("bigint"))


def min_rows(n: int) -> Check:
    return Check("min_rows", None, F.count(F.lit(1)), F.lit(n).cast("bigint"), ">=")


def gold_checks(threshold: int = JobConfig.min_rows) -> list[Check]:
    """The checks a feature table must pass before it is published."""
    return [
        not_null("customer_id"),
        not_null("monthly_charges"),
        not_null("churn"),
        unique("customer_id"),
        in_set("churn", (0, 1)),
        min_rows(threshold),
    ]


def dq_report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: ``(check, column, observed, expected, passed)``.

    All checks share one aggregate over the columns they name. A uniqueness check adds one
    exchange on its key, after map-side combine; the report itself is one row turned into
    a few.
    """
    measured = df.agg(
        F.count(F.lit(1)).alias("rows"), *[check.observed.alias(f"m{i}") for i, check in enumerate(checks)]
    )
    lines = [
        F.struct(
            F.lit(check.name).alias("check"),
            F.lit(check.column).cast("string").alias("column"),
            F.col(f"m{i}").cast("bigint").alias("observed"),
            check.expected.alias("expected"),
            check.passed(F.col(f"m{i}")).alias("passed"),
        )
        for i, check in enumerate(checks)
    ]
    return measured.select(F.inline(F.array(*lines)))


def gate(report: DataFrame) -> list[dict]:
    """Raise when a check failed; otherwise return the report's rows (one per check)."""
    lines = [row.asDict() for row in report.collect()]
    failed = [
        f"{line['check']}({line['column'] or ''}): observed {line['observed']}, expected {line['expected']}"
        for line in lines
        if not line["passed"]
    ]
    if failed:
        raise QualityError("; ".join(failed))
    return lines
