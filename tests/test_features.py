import pytest

from tidemark.config import GOLD_SCHEMA, SILVER_SCHEMA, FeatureRules
from tidemark.operators.rows import ContractError
from tidemark.operators.stages import silver_to_gold


def gold(spark, rules=None, **values):
    row = {
        "customer_id": "A",
        "senior_citizen": 0,
        "tenure": 10,
        "phone_service": "Yes",
        "internet_service": "DSL",
        "contract": "One year",
        "monthly_charges": 50.0,
        "total_charges": 500.0,
        "churn": 0,
    } | values
    silver = spark.createDataFrame([tuple(row[n] for n in SILVER_SCHEMA.names)], SILVER_SCHEMA)
    return silver_to_gold(silver, rules).first()


@pytest.mark.parametrize("value, flag", [("Yes", 1), ("yes", 0), ("No", 0), ("No phone service", 0), (None, 0)])
def test_phone(spark, value, flag):
    assert gold(spark, phone_service=value).has_phone_service == flag


@pytest.mark.parametrize("value, flag", [("DSL", 1), ("Fiber optic", 1), ("no", 1), ("No", 0), (None, 0)])
def test_internet(spark, value, flag):
    assert gold(spark, internet_service=value).has_internet == flag


@pytest.mark.parametrize(
    "value, monthly, long", [("Month-to-month", 1, 0), ("One year", 0, 0), ("Two year", 0, 1), (None, 0, 0)]
)
def test_contract(spark, value, monthly, long):
    row = gold(spark, contract=value)
    assert (row.is_month_to_month, row.is_long_term) == (monthly, long)


@pytest.mark.parametrize("charge, flag", [(64.99, 0), (65.0, 0), (65.01, 1), (None, 0)])
def test_high_charge_is_strict(spark, charge, flag):
    assert gold(spark, monthly_charges=charge).high_monthly_charges == flag


@pytest.mark.parametrize("tenure, flag", [(23, 0), (24, 0), (25, 1), (None, 0)])
def test_long_tenure_is_strict(spark, tenure, flag):
    assert gold(spark, tenure=tenure).long_tenure == flag


@pytest.mark.parametrize(
    "tenure, total, expected",
    [(10, 500.0, 50.0), (0, 500.0, 42.0), (None, 500.0, 42.0), (-1, 500.0, 42.0), (10, None, None)],
)
def test_charge_per_month(spark, tenure, total, expected):
    row = gold(spark, tenure=tenure, total_charges=total, monthly_charges=42.0)
    assert row.charges_per_month_tenure == expected


def test_columns_in_order(spark):
    assert gold(spark).__fields__ == GOLD_SCHEMA.names


def test_rules_can_be_changed(spark):
    row = gold(spark, FeatureRules(high_charge=10, long_tenure=5, long_contract="One year"))
    assert (row.high_monthly_charges, row.long_tenure, row.is_long_term) == (1, 1, 1)


def test_no_shuffle(spark):
    silver = spark.createDataFrame([], SILVER_SCHEMA)
    assert "Exchange" not in silver_to_gold(silver)._jdf.queryExecution().executedPlan().toString()


def test_wrong_type_is_rejected(spark):
    silver = spark.createDataFrame([], SILVER_SCHEMA)
    with pytest.raises(ContractError, match="tenure is string"):
        silver_to_gold(silver.withColumn("tenure", silver.tenure.cast("string")))
