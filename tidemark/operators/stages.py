"""The two table stages: raw to silver (cleaned) and silver to gold (features)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import GOLD_SCHEMA, KEY, RAW_COLUMNS, SILVER_NAMES, SILVER_SCHEMA, FeatureRules
from tidemark.functions import (
    blank_to_double,
    flag_above,
    flag_equals,
    flag_not_equals,
    guarded_ratio,
    to_double,
    to_int,
    yes_flag,
)
from tidemark.operators.rows import (
    dedup_key,
    derive,
    drop_null_rows,
    project,
    rename,
    require_columns,
    require_schema,
)


def clean_values(raw: DataFrame) -> DataFrame:
    """Typed and cleaned columns under their raw names; other columns pass through."""
    return derive(
        require_columns(raw, RAW_COLUMNS, "raw table"),
        {
            "SeniorCitizen": to_int(F.col("SeniorCitizen")),
            "tenure": to_int(F.col("tenure")),
            "MonthlyCharges": to_double(F.col("MonthlyCharges")),
            "TotalCharges": blank_to_double(F.col("TotalCharges")),
            "Churn": yes_flag(F.col("Churn")),
        },
    )


def bronze_to_silver(raw: DataFrame, prefer_complete: bool = False) -> DataFrame:
    """One cleaned row per customer.

    Rows without a key are filtered before the shuffle: they would all share one group,
    which the last step drops anyway. The charge is tested after the choice of a survivor,
    so a customer whose surviving copy has no charge is dropped, unless ``prefer_complete``
    picks copies with a charge first.
    """
    cleaned = clean_values(raw)
    keyed = cleaned.where(F.col(KEY).isNotNull())
    prefer = F.col("MonthlyCharges").isNotNull() if prefer_complete else None
    survivors = dedup_key(keyed, KEY, prefer)
    return rename(drop_null_rows(survivors, [KEY, "MonthlyCharges"]), SILVER_NAMES)


def silver_to_gold(silver: DataFrame, rules: FeatureRules | None = None) -> DataFrame:
    """Feature columns per customer; a narrow projection without a shuffle."""
    rules = rules or FeatureRules()
    features = derive(
        require_schema(silver, SILVER_SCHEMA, "silver table"),
        {
            "has_phone_service": flag_equals(F.col("phone_service"), rules.phone_yes),
            "has_internet": flag_not_equals(F.col("internet_service"), rules.internet_no),
            "is_month_to_month": flag_equals(F.col("contract"), rules.monthly_contract),
            "is_long_term": flag_equals(F.col("contract"), rules.long_contract),
            "charges_per_month_tenure": guarded_ratio(
                F.col("total_charges"), F.col("tenure"), F.col("monthly_charges")
            ),
            "high_monthly_charges": flag_above(F.col("monthly_charges"), rules.high_charge),
            "long_tenure": flag_above(F.col("tenure"), rules.long_tenure),
        },
    )
    return project(features, GOLD_SCHEMA.names)
