"""Hand-made raw customer rows."""

RAW_SCHEMA = (
    "customerID string, SeniorCitizen string, tenure string, PhoneService string, InternetService string, "
    "Contract string, MonthlyCharges string, TotalCharges string, Churn string, extra string"
)

RAW_ROWS = [
    ("A", "0", "1", "Yes", "DSL", "Month-to-month", "29.85", "29.85", "No", "x"),
    ("B", "1", "0", "No", "No", "Two year", "50.5", " ", "Yes", "x"),
    ("C", "0", "30", "Yes", "Fiber optic", "One year", "70.0", "2100", "YES", "x"),
    ("C", "0", "30", "Yes", "Fiber optic", "One year", "70.0", "2100", "YES", "x"),
    ("D", "0", None, "Yes", "", "One year", None, "12.5", None, "x"),
    (None, "0", "3", "Yes", "DSL", "One year", "20.0", "60", "No", "x"),
]


def raw_frame(spark, rows=None):
    return spark.createDataFrame(RAW_ROWS if rows is None else rows, RAW_SCHEMA)
