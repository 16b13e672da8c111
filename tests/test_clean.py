import random

import pytest
from pyspark.sql import functions as F
from rows import RAW_ROWS, raw_frame

from tidemark.functions import blank_to_double, flag, to_int, yes_flag
from tidemark.operators.rows import ContractError, dedup_key, drop_null_rows, rename
from tidemark.operators.stages import bronze_to_silver, clean_values


def values(spark, texts, expression):
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    return [row[0] for row in df.select(expression(F.col("c"))).collect()]


@pytest.mark.parametrize("on", [True, False])
def test_blank_numeric(spark, ansi, on):
    ansi(on)
    assert values(spark, [" ", "", "29.85", " 1.5 ", "abc", None], blank_to_double) == [
        None,
        None,
        29.85,
        1.5,
        None,
        None,
    ]


def test_blank_numeric_on_a_column_that_is_already_a_number(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "c double")
    assert [r[0] for r in df.select(blank_to_double(F.col("c"))).collect()] == [1.5, None]


@pytest.mark.parametrize("on", [True, False])
def test_whole_numbers(spark, ansi, on):
    ansi(on)
    texts = ["3", "3.7", "-2.9", "x", "", "99999999999", None]
    assert values(spark, texts, to_int) == [3, 3, -2, None, None, None, None]


def test_yes_in_any_case_untrimmed(spark):
    assert values(spark, ["Yes", "YES", "yes", " Yes", "No", "", None], yes_flag) == [1, 1, 1, 0, 0, 0, 0]


def test_flag_takes_unknown_as_zero(spark):
    assert values(spark, ["a", "b", None], lambda c: flag(c == "a")) == [1, 0, 0]


def test_fixture_rows(spark):
    cleaned = clean_values(raw_frame(spark))
    assert [r.Churn for r in cleaned.collect()] == [0, 1, 1, 1, 0, 0]
    assert dedup_key(cleaned, "customerID").count() == 5
    silver = {r.customer_id: r for r in bronze_to_silver(raw_frame(spark)).collect()}
    assert sorted(silver) == ["A", "B", "C"]
    assert silver["B"].total_charges is None
    assert silver["C"].churn == 1


def test_silver_columns_and_types(spark):
    silver = bronze_to_silver(raw_frame(spark))
    assert [(f.name, f.dataType.simpleString()) for f in silver.schema.fields] == [
        ("customer_id", "string"),
        ("senior_citizen", "int"),
        ("tenure", "int"),
        ("phone_service", "string"),
        ("internet_service", "string"),
        ("contract", "string"),
        ("monthly_charges", "double"),
        ("total_charges", "double"),
        ("churn", "int"),
        ("extra", "string"),
    ]


def test_survivor_is_the_smallest_with_nulls_first(spark):
    df = spark.createDataFrame(
        [("k", 2, "a"), ("k", None, "z"), ("k", None, "b"), ("j", 1, None), (None, 5, "q"), (None, 4, "r")],
        "k string, n int, s string",
    )
    rows = sorted(dedup_key(df, "k").collect(), key=str)
    assert [tuple(r) for r in rows] == [("j", 1, None), ("k", None, "b"), (None, 4, "r")]
    assert dedup_key(df, "k").columns == ["k", "n", "s"]


def test_survivor_does_not_depend_on_order_or_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abcdef"), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for _ in range(500)]
    seen = set()
    for parts in (1, 3, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, n int, s string").repartition(parts)
        seen.add(tuple(sorted((tuple(r) for r in dedup_key(df, "k").collect()), key=str)))
    assert len(seen) == 1


def test_dedup_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(2)
    keys = ["hot"] * 400 + [f"k{i % 150}" for i in range(800)]
    rows = [(k, rng.randint(0, 9), rng.choice([None, 0.5, 1.5])) for k in keys]

    def order(row):
        return (row[1], (row[2] is not None, row[2] or 0))

    expected = {}
    for row in rows:
        if row[0] not in expected or order(row) < order(expected[row[0]]):
            expected[row[0]] = row
    df = spark.createDataFrame(rows, "k string, n int, v double")
    assert {r.k: tuple(r) for r in dedup_key(df, "k").collect()} == expected


def test_dedup_of_a_key_alone(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert sorted((r.k for r in dedup_key(df, "k").collect()), key=str) == [None, "a"]


def test_dedup_combines_before_the_shuffle(spark):
    plan = dedup_key(raw_frame(spark), "customerID")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert "partial_min" in plan.split("Exchange")[1]


def test_null_charge_on_the_surviving_copy_drops_the_customer(spark):
    rows = [
        ("E", "0", "5", "Yes", "DSL", "One year", None, "1", "No", "x"),
        ("E", "0", "5", "Yes", "DSL", "One year", "30", "1", "No", "x"),
    ]
    assert bronze_to_silver(raw_frame(spark, rows)).count() == 0
    kept = bronze_to_silver(raw_frame(spark, rows), prefer_complete=True).collect()
    assert [r.monthly_charges for r in kept] == [30.0]


def test_drop_null_rows_needs_every_listed_column(spark):
    df = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "a int, b int")
    assert drop_null_rows(df, ["a", "b"]).count() == 1


def test_missing_column_is_rejected(spark):
    with pytest.raises(ContractError, match="Churn"):
        bronze_to_silver(raw_frame(spark).drop("Churn"))
    with pytest.raises(ContractError, match="nope"):
        rename(raw_frame(spark), {"nope": "x"})


def test_pass_through_columns_keep_their_values(spark):
    assert {r.extra for r in bronze_to_silver(raw_frame(spark, RAW_ROWS)).collect()} == {"x"}
