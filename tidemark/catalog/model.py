"""Split, features, training and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.catalog.inputs import GOLD_SQL, SILVER_SQL, raw_customers, table
from tidemark.catalog.tables import staged_batch
from tidemark.config import FEATURES, LABEL, ModelParams
from tidemark.operators.metrics import auc_roc, classification_report, confusion
from tidemark.operators.model import (
    Trained,
    load_model,
    predict,
    save_model,
    select_features,
    train_and_evaluate,
    train_gbt,
)
from tidemark.operators.split import stratified_split
from tidemark.operators.stages import bronze_to_silver, silver_to_gold
from tidemark.plans.batch import run_batch
from tidemark.session import scratch_path
from tidemark.sources.runs import scan_runs
from tidemark.sources.tables import scan_table, write_overwrite


def stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "gold")
    write_overwrite(silver_to_gold(bronze_to_silver(raw_customers(spark, sf_dir))), path)
    return scan_table(spark, path)


# Rounds of the queries whose rows are checks that hold for any number of them.
FEW = ModelParams(rounds=5)


def trained(
    spark: SparkSession, sf_dir: str, params: ModelParams | None = None, features: Sequence[str] = FEATURES
) -> Trained:
    """A model fitted on the training part of the whole table, for the calling query alone."""
    return train_and_evaluate(stored_gold(spark, sf_dir), params, features=features)


@query(
    "select_features",
    f"""WITH gold AS ({GOLD_SQL}),
             contracts AS (SELECT contract, row_number() OVER (ORDER BY contract) - 1 AS code
                           FROM (SELECT DISTINCT contract FROM gold WHERE contract IS NOT NULL)),
             services AS (SELECT internet_service, row_number() OVER (ORDER BY internet_service) - 1 AS code
                          FROM (SELECT DISTINCT internet_service FROM gold WHERE internet_service IS NOT NULL))
        SELECT customer_id, churn,
               {", ".join(f"CAST(coalesce({c}, 0) AS DOUBLE) AS {c}" for c in FEATURES if not c.endswith("_enc"))},
               CAST(coalesce(contracts.code, (SELECT count(*) FROM contracts)) AS DOUBLE) AS contract_enc,
               CAST(coalesce(services.code, (SELECT count(*) FROM services)) AS DOUBLE) AS internet_service_enc
        FROM gold LEFT JOIN contracts USING (contract) LEFT JOIN services USING (internet_service)""",
)
def select_features_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = select_features(stored_gold(spark, sf_dir)).withColumn("_v", vector_to_array("features"))
    return values.select("customer_id", LABEL, *[F.col("_v")[i].alias(name) for i, name in enumerate(FEATURES)])


def split_sql(source: str, key: str, label: str) -> str:
    """The exact split as SQL: rank all rows of a class, and take the class's quota."""
    return f"""
WITH source AS ({source}),
     sizes AS (SELECT count(*) AS n, count(*) - CAST(ceil(0.2::DOUBLE * count(*)) AS BIGINT) AS train FROM source),
     classes AS (SELECT {label}, count(*) AS class_rows FROM source GROUP BY {label}),
     shares AS (SELECT {label}, train, train * class_rows // n AS base, (train * class_rows) % n AS remainder
                FROM classes, sizes),
     quotas AS (SELECT {label}, base + CASE WHEN row_number() OVER (ORDER BY remainder DESC, {label})
                                                 <= train - sum(base) OVER () THEN 1 ELSE 0 END AS quota
                FROM shares),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5('42:' || CAST({key} AS VARCHAR)))
                          AS place
                FROM source)
SELECT {key}, {label}, CASE WHEN place <= quota THEN 'train' ELSE 'test' END AS split
FROM ranked JOIN quotas USING ({label})
"""


_SPLIT_SQL = split_sql(
    """SELECT event_id, CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS label FROM events""",
    "event_id",
    "label",
)
_GOLD_SPLIT_SQL = split_sql(GOLD_SQL, "customer_id", LABEL)


def labelled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    is_purchase = (F.col("event_type") == "purchase").cast("int")
    return table(spark, sf_dir, "events").select("event_id", "value", is_purchase.alias("label"))


@query("stratified_split", _SPLIT_SQL)
def stratified_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(labelled_events(spark, sf_dir).drop("value"), "event_id", "label")


@query(
    "split_shape",
    f"""SELECT split, label, count(*) AS "rows" FROM ({_SPLIT_SQL}) AS parts GROUP BY split, label""",
)
def split_shape_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = stratified_split(labelled_events(spark, sf_dir), "event_id", "label")
    return parts.groupBy("split", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "auc_roc",
    """SELECT CAST(sum(positives * (2 * below + negatives)) AS DOUBLE)
              / CAST(2 * sum(positives) * sum(negatives) AS DOUBLE) AS auc_roc,
              CAST(sum(positives) AS BIGINT) AS positives, CAST(sum(negatives) AS BIGINT) AS negatives
       FROM (SELECT *, sum(negatives) OVER (ORDER BY value) - negatives AS below
             FROM (SELECT value, count(*) FILTER (WHERE event_type = 'purchase') AS positives,
                          count(*) FILTER (WHERE event_type <> 'purchase') AS negatives
                   FROM events GROUP BY value) AS per_score) AS ranked""",
)
def auc_roc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auc_roc(table(spark, sf_dir, "events"), "value", "event_type", "purchase")


_SCORED_SQL = """SELECT CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS label,
       CAST(CASE WHEN value > 60 THEN 1 ELSE 0 END AS INTEGER) AS prediction FROM events"""


def thresholded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_events(spark, sf_dir).select("label", (F.col("value") > 60).cast("int").alias("prediction"))


@query(
    "confusion",
    f"""SELECT label, prediction, count(*) AS "rows" FROM ({_SCORED_SQL}) AS scored GROUP BY label, prediction""",
)
def confusion_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion(thresholded_events(spark, sf_dir), "label", "prediction")


def report_sql(scored: str) -> str:
    """The report's lines as SQL, from ``label, prediction``."""
    return f"""WITH scored AS ({scored}),
             classes AS (SELECT * FROM (VALUES (0, 'No Churn'), (1, 'Churn')) AS c(label, name)),
             counts AS (SELECT c.name,
                          (SELECT count(*) FROM scored AS s WHERE s.label = c.label AND s.prediction = c.label) AS tp,
                          (SELECT count(*) FROM scored AS s WHERE s.prediction = c.label) AS predicted,
                          (SELECT count(*) FROM scored AS s WHERE s.label = c.label) AS support
                        FROM classes AS c),
             measures AS (SELECT name, support,
                            CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
                            CASE WHEN support > 0 THEN tp::DOUBLE / support ELSE 0 END AS recall,
                            CASE WHEN predicted + support > 0 THEN 2 * tp::DOUBLE / (predicted + support) ELSE 0 END
                              AS f1_score
                          FROM counts)
        SELECT name, precision, recall, f1_score, support FROM measures
        UNION ALL
        SELECT 'accuracy', NULL, NULL, (SELECT count(*) FROM scored WHERE label = prediction)::DOUBLE / count(*),
               count(*) FROM scored
        UNION ALL
        SELECT 'macro avg', sum(precision) / 2, sum(recall) / 2, sum(f1_score) / 2, CAST(sum(support) AS BIGINT)
        FROM measures
        UNION ALL
        SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
               sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM measures"""


@query("classification_report", report_sql(_SCORED_SQL))
def classification_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classification_report(thresholded_events(spark, sf_dir), "label", "prediction")


@query(
    "train_gbt",
    f"""SELECT CAST(100 AS INTEGER) AS trees, CAST(13 AS INTEGER) AS features, true AS depth_kept,
               count(*) FILTER (WHERE split = 'test') AS held_out, true AS better_than_chance,
               true AS auc_confirmed
        FROM ({_GOLD_SPLIT_SQL}) AS parts""",
)
def train_gbt_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of the fitted model, the rows it was not fitted on, and its AUC found in another way."""
    fitted = trained(spark, sf_dir)
    trees = fitted.model.stages[-1]
    scores = fitted.scored.withColumn(LABEL, F.col(LABEL).cast("double"))
    # No bins: every distinct score is a point of the curve.
    other = BinaryClassificationEvaluator(rawPredictionCol="churn_probability", labelCol=LABEL, numBins=0)
    return fitted.scored.agg(
        F.lit(trees.getNumTrees).alias("trees"),
        F.lit(trees.numFeatures).alias("features"),
        F.lit(max(tree.depth for tree in trees.trees) <= 4).alias("depth_kept"),
        F.count(F.lit(1)).alias("held_out"),
        F.lit(fitted.auc > 0.5).alias("better_than_chance"),
        F.lit(abs(other.evaluate(scores) - fitted.auc) < 1e-9).alias("auc_confirmed"),
    )


# One round of one split on a 0/1 feature: a leaf is the mean of 2y - 1 over its rows.
_LEAF_SQL = f"""SELECT customer_id, churn, avg(2 * churn - 1) OVER (PARTITION BY is_month_to_month) AS leaf
                FROM ({GOLD_SQL}) AS gold"""


def scored_by_one_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = stored_gold(spark, sf_dir)
    model = train_gbt(gold, gold, ModelParams(rounds=1, depth=1), features=["is_month_to_month"])
    return predict(model, gold)


@query(
    "predict_proba",
    f"SELECT customer_id, round(1 / (1 + exp(-2 * leaf)), 9) AS churn_probability FROM ({_LEAF_SQL}) AS leaves",
)
def predict_proba_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of a model whose answer is known in closed form."""
    scored = scored_by_one_split(spark, sf_dir)
    return scored.select("customer_id", F.round("churn_probability", 9).alias("churn_probability"))


@query(
    "predict",
    f"""SELECT customer_id, churn, CAST(CASE WHEN leaf > 0 THEN 1 ELSE 0 END AS INTEGER) AS prediction
        FROM ({_LEAF_SQL}) AS leaves""",
)
def predict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_by_one_split(spark, sf_dir).select("customer_id", LABEL, "prediction")


@query(
    "scored_rows",
    f"""SELECT customer_id, churn, true AS is_probability, true AS agrees
        FROM ({_GOLD_SPLIT_SQL}) AS parts WHERE split = 'test'""",
)
def scored_rows_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the held-out rows are scored, and label and probability agree."""
    probability, prediction = F.col("churn_probability"), F.col("prediction")
    return trained(spark, sf_dir, FEW).scored.select(
        "customer_id",
        LABEL,
        probability.between(0, 1).alias("is_probability"),
        (prediction == (probability > 0.5).cast("int")).alias("agrees"),
    )


# Features of two values: as many levels as flags give every combination of them a leaf of its own.
FLAGS = ("is_month_to_month", "high_monthly_charges", "has_internet", "has_phone_service")
THREE = ModelParams(rounds=3, learning_rate=0.3, depth=2)
# Scores agree up to the rounding of sums; this many digits are compared.
_DIGITS = 6


def boosted_sql(params: ModelParams, flags: Sequence[str]) -> str:
    """The held-out customers' scores under boosted trees over ``flags``, one leaf for each combination.

    The first tree is the mean of 2y - 1 over a leaf's training rows, at weight 1. Each later one is
    the mean of the loss's gradient there, 4y / (1 + exp(2yf)) for y of 1 and -1, at the learning rate.
    """
    keys = ", ".join(flags)
    step = "4 * (positives / (1 + exp(2 * f)) - negatives / (1 + exp(-2 * f))) / (positives + negatives)"
    return f"""
WITH RECURSIVE gold AS ({GOLD_SQL}),
     parts AS (SELECT gold.*, split FROM gold JOIN ({_GOLD_SPLIT_SQL}) AS s USING (customer_id)),
     leaves AS (SELECT {keys}, sum(churn)::DOUBLE AS positives, sum(1 - churn)::DOUBLE AS negatives
                FROM parts WHERE split = 'train' GROUP BY {keys}),
     rounds AS (SELECT *, 1 AS round, (positives - negatives) / (positives + negatives) AS f FROM leaves
                UNION ALL
                SELECT {keys}, positives, negatives, round + 1, f + {params.learning_rate} * {step}
                FROM rounds WHERE round < {params.rounds})
SELECT customer_id, churn, 1 / (1 + exp(-2 * f)) AS score, CAST(CASE WHEN f > 0 THEN 1 ELSE 0 END AS INTEGER) AS class
FROM parts JOIN rounds USING ({keys}) WHERE split = 'test' AND round = {params.rounds}
"""


_AUC_SQL = """SELECT CAST(sum(positives * (2 * below + negatives)) AS DOUBLE)
                     / CAST(2 * sum(positives) * sum(negatives) AS DOUBLE) AS auc_roc
              FROM (SELECT *, sum(negatives) OVER (ORDER BY score) - negatives AS below
                    FROM (SELECT score, sum(churn) AS positives, sum(1 - churn) AS negatives
                          FROM held_out GROUP BY score) AS per_score) AS ranked"""


@query(
    "train_rounds",
    f"""WITH held_out AS ({boosted_sql(THREE, FLAGS[:2])})
        SELECT customer_id, churn, round(score, {_DIGITS}) AS churn_probability, class AS prediction,
               round(({_AUC_SQL}), {_DIGITS}) AS auc_roc
        FROM held_out""",
)
def train_rounds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three rounds learn from the training part, as scores of the test part and their AUC.

    The features have two values each, so that the scores can be found in closed form; they
    follow from the split, the rounds, the learning rate, the loss and the weight of the first tree.
    """
    fitted = trained(spark, sf_dir, THREE, FLAGS[:2])
    return fitted.scored.select(
        "customer_id",
        LABEL,
        F.round("churn_probability", _DIGITS).alias("churn_probability"),
        "prediction",
        F.round(F.lit(fitted.auc), _DIGITS).alias("auc_roc"),
    )


@query(
    "model_report",
    f"""WITH held_out AS ({boosted_sql(ModelParams(), FLAGS)}),
             report AS ({report_sql("SELECT churn AS label, class AS prediction FROM held_out")})
        SELECT report.*, round(({_AUC_SQL}), {_DIGITS}) AS auc_roc FROM report""",
)
def model_report_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report and the AUC of the production settings (100 rounds of depth 4), over the four flags."""
    fitted = trained(spark, sf_dir, ModelParams(), FLAGS)
    return fitted.report.withColumn("auc_roc", F.round(F.lit(fitted.auc), _DIGITS))


@query("save_model", f"SELECT customer_id, true AS same_probability, true AS same_class FROM ({GOLD_SQL}) AS gold")
def save_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored model predicts for all of gold what the fitted one does."""
    model = trained(spark, sf_dir, FEW).model
    loaded = load_model(save_model(model, scratch_path(spark, "model")))
    first = predict(model, stored_gold(spark, sf_dir))
    names = {"churn_probability": "first_probability", "prediction": "first_class"}
    both = predict(loaded, first.withColumnsRenamed(names))
    return both.select(
        "customer_id",
        (F.col("churn_probability") == F.col("first_probability")).alias("same_probability"),
        (F.col("prediction") == F.col("first_class")).alias("same_class"),
    )


@query(
    "run_batch",
    f"""SELECT 'gradient-boosting-v1' AS run_name, '100' AS n_estimators, '0.1' AS learning_rate, '4' AS max_depth,
               (SELECT count(*) FROM ({SILVER_SQL}) AS silver) AS silver_rows, count(*) AS gold_rows,
               CAST(6 AS INTEGER) AS checks_passed,
               (SELECT count(*) FROM ({_GOLD_SPLIT_SQL}) AS parts WHERE split = 'test') AS test_rows,
               true AS better_than_chance
        FROM ({GOLD_SQL}) AS gold""",
)
def run_batch_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole batch run from raw files to run record."""
    config = staged_batch(spark, sf_dir)
    result = run_batch(spark, config)
    run = scan_runs(spark, config.runs_path)
    params = F.col("params")
    return run.select(
        "run_name",
        *[params[name].alias(name) for name in ("n_estimators", "learning_rate", "max_depth")],
        F.lit(result.rows["silver"]).cast("bigint").alias("silver_rows"),
        F.lit(result.rows["gold"]).cast("bigint").alias("gold_rows"),
        F.lit(sum(line["passed"] for line in result.quality)).alias("checks_passed"),
        F.lit(result.trained.scored.count()).cast("bigint").alias("test_rows"),
        (F.col("metrics")["auc_roc"] > 0.5).alias("better_than_chance"),
    )
