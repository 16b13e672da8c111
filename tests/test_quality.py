import pytest

from tidemark.operators.counts import distinct_count, duplicate_keys, null_counts, row_count
from tidemark.operators.quality import QualityError, dq_report, gate, gold_checks, in_set, min_rows, not_null, unique

SCHEMA = "customer_id string, monthly_charges double, churn int"
GOOD = [("A", 1.0, 0), ("B", 2.0, 1), ("C", 3.0, 0)]


def report(spark, rows, checks=None, threshold=3):
    df = spark.createDataFrame(rows, SCHEMA)
    return {(r.check, r.column): r for r in dq_report(df, checks or gold_checks(threshold)).collect()}


def test_good_table_passes(spark):
    lines = report(spark, GOOD)
    assert all(line.passed for line in lines.values())
    assert len(lines) == 6
    assert len(gate(dq_report(spark.createDataFrame(GOOD, SCHEMA), gold_checks(3)))) == 6


@pytest.mark.parametrize(
    "extra, failed, observed",
    [
        ((None, 1.0, 0), ("not_null", "customer_id"), 1),
        (("D", None, 0), ("not_null", "monthly_charges"), 1),
        (("D", 1.0, None), ("not_null", "churn"), 1),
        (("A", 1.0, 0), ("unique", "customer_id"), 3),
        (("D", 1.0, 2), ("in_set", "churn"), 1),
    ],
)
def test_each_check_fails_alone(spark, extra, failed, observed):
    lines = report(spark, [*GOOD, extra])
    assert [key for key, line in lines.items() if not line.passed] == [failed]
    assert lines[failed].observed == observed
    with pytest.raises(QualityError, match=failed[0]):
        gate(dq_report(spark.createDataFrame([*GOOD, extra], SCHEMA), gold_checks(3)))


def test_too_few_rows(spark):
    lines = report(spark, GOOD, threshold=4)
    assert not lines[("min_rows", None)].passed
    with pytest.raises(QualityError, match="observed 3, expected 4"):
        gate(dq_report(spark.createDataFrame(GOOD, SCHEMA), gold_checks(4)))


def test_a_null_key_counts_as_one_value(spark):
    once = report(spark, [("A", 1.0, 0), (None, 1.0, 0)], [unique("customer_id")])
    twice = report(spark, [("A", 1.0, 0), (None, 1.0, 0), (None, 1.0, 0)], [unique("customer_id")])
    assert once[("unique", "customer_id")].passed
    assert (twice[("unique", "customer_id")].observed, twice[("unique", "customer_id")].expected) == (2, 3)


def test_empty_table(spark):
    lines = report(spark, [], [not_null("churn"), unique("customer_id"), in_set("churn", (0, 1)), min_rows(1)])
    assert [line.passed for line in lines.values()] == [True, True, True, False]


def test_report_is_one_pass_over_the_named_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame(GOOD, SCHEMA).selectExpr("*", "'wide' AS other").write.parquet(path)
    plan = dq_report(spark.read.parquet(path), gold_checks(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<customer_id:string,monthly_charges:double,churn:int>" in plan


def test_counts(spark):
    df = spark.createDataFrame([("A", None, 0), ("A", 1.0, 1), (None, None, 0)], SCHEMA)
    assert row_count(df).first()[0] == 3
    assert distinct_count(df, "customer_id").first()[0] == df.select("customer_id").distinct().count() == 2
    assert tuple(null_counts(df, ["customer_id", "monthly_charges", "churn"]).first()) == (1, 2, 0)
    assert [tuple(r) for r in duplicate_keys(df, "customer_id").collect()] == [("A", 2)]
