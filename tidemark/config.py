"""Names, thresholds and paths shared by the stages."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- Fixed values: column names, category values, thresholds, schemas, hyperparameters ---

KEY = "customerID"

# Raw columns that get a new name in the silver table; every other column passes through.
SILVER_NAMES = {
    "customerID": "customer_id",
    "SeniorCitizen": "senior_citizen",
    "PhoneService": "phone_service",
    "InternetService": "internet_service",
    "Contract": "contract",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "Churn": "churn",
}

# Raw columns the cleaning stage reads; a file without one of them is rejected.
RAW_COLUMNS = (
    "customerID",
    "SeniorCitizen",
    "tenure",
    "PhoneService",
    "InternetService",
    "Contract",
    "MonthlyCharges",
    "TotalCharges",
    "Churn",
)

SILVER_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("senior_citizen", T.IntegerType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("phone_service", T.StringType()),
        T.StructField("internet_service", T.StringType()),
        T.StructField("contract", T.StringType()),
        T.StructField("monthly_charges", T.DoubleType()),
        T.StructField("total_charges", T.DoubleType()),
        T.StructField("churn", T.IntegerType()),
    ]
)

GOLD_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("senior_citizen", T.IntegerType()),
        T.StructField("tenure", T.IntegerType()),
        T.StructField("monthly_charges", T.DoubleType()),
        T.StructField("total_charges", T.DoubleType()),
        T.StructField("contract", T.StringType()),
        T.StructField("internet_service", T.StringType()),
        T.StructField("has_phone_service", T.IntegerType()),
        T.StructField("has_internet", T.IntegerType()),
        T.StructField("is_month_to_month", T.IntegerType()),
        T.StructField("is_long_term", T.IntegerType()),
        T.StructField("charges_per_month_tenure", T.DoubleType()),
        T.StructField("high_monthly_charges", T.IntegerType()),
        T.StructField("long_tenure", T.IntegerType()),
        T.StructField("churn", T.IntegerType()),
    ]
)

CATEGORIES = ("contract", "internet_service")

# Model inputs, in vector order.
FEATURES = (
    "senior_citizen",
    "tenure",
    "monthly_charges",
    "total_charges",
    "has_phone_service",
    "has_internet",
    "is_month_to_month",
    "is_long_term",
    "charges_per_month_tenure",
    "high_monthly_charges",
    "long_tenure",
    "contract_enc",
    "internet_service_enc",
)
LABEL = "churn"
CLASS_NAMES = {0: "No Churn", 1: "Churn"}

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("customer_id", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("internet_service", T.StringType()),
        T.StructField("contract", T.StringType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("monthly_charges", T.DoubleType()),
        T.StructField("tenure_months", T.IntegerType()),
        T.StructField("support_calls", T.IntegerType()),
        T.StructField("late_payments", T.IntegerType()),
    ]
)

SERVICES = ("DSL", "Fiber optic", "No")
CONTRACTS = ("Month-to-month", "One year", "Two year")
PAYMENT_METHODS = ("Electronic check", "Mailed check", "Bank transfer", "Credit card")

# Inclusive bounds of the numeric event fields.
EVENT_RANGES = {
    "monthly_charges": (20, 120),
    "tenure_months": (1, 72),
    "support_calls": (0, 10),
    "late_payments": (0, 5),
}

# Category values and thresholds behind the gold flags.
PHONE_YES = "Yes"
INTERNET_NO = "No"
MONTHLY_CONTRACT = "Month-to-month"
LONG_CONTRACT = "Two year"
HIGH_CHARGE = 65
LONG_TENURE = 24

# Rows a feature table must have to be published.
MIN_ROWS = 5000

# Boosted trees, the split they are evaluated on, and the name of the run.
ROUNDS = 100
LEARNING_RATE = 0.1
DEPTH = 4
SEED = 42
TEST_SIZE = 0.2
RUN_NAME = "gradient-boosting-v1"

# Consumer timeouts in milliseconds.
REQUEST_TIMEOUT_MS = 60000
SESSION_TIMEOUT_MS = 30000

# --- End of fixed values ---

EVENT_ID_PATTERN = r"^CUST-([0-9]{5}|[1-9][0-9]{5,})$"
# An event's time is a date, or a date and a time, in ISO 8601; the offset may be any or missing,
# which means UTC. The text must also name a moment that exists.
ISO_PATTERN = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"


@dataclass(frozen=True)
class FeatureRules:
    """Values and thresholds behind the gold flags."""

    phone_yes: str = PHONE_YES
    internet_no: str = INTERNET_NO
    monthly_contract: str = MONTHLY_CONTRACT
    long_contract: str = LONG_CONTRACT
    high_charge: float = HIGH_CHARGE
    long_tenure: int = LONG_TENURE


@dataclass(frozen=True)
class ModelParams:
    """Boosted-tree settings and the split they are evaluated on."""

    rounds: int = ROUNDS
    learning_rate: float = LEARNING_RATE
    depth: int = DEPTH
    seed: int = SEED
    test_size: float = TEST_SIZE

    def logged(self) -> dict[str, str]:
        """The settings a run record keeps."""
        return {
            "n_estimators": str(self.rounds),
            "learning_rate": str(self.learning_rate),
            "max_depth": str(self.depth),
        }


@dataclass(frozen=True)
class JobConfig:
    """Where a batch run reads and writes, and the settings it uses."""

    raw_path: str
    silver_path: str
    gold_path: str
    model_path: str
    runs_path: str
    table_format: str = "parquet"
    min_rows: int = MIN_ROWS
    run_name: str = RUN_NAME
    infer_schema: bool = False
    prefer_complete: bool = False
    rules: FeatureRules = field(default_factory=FeatureRules)
    model: ModelParams = field(default_factory=ModelParams)

    @classmethod
    def under(cls, base: str, raw_path: str, **settings) -> JobConfig:
        """A config with one folder per layer below ``base``."""
        return cls(
            raw_path=raw_path,
            silver_path=f"{base}/silver/customers",
            gold_path=f"{base}/gold/features",
            model_path=f"{base}/models/churn",
            runs_path=f"{base}/models/runs",
            **settings,
        )
