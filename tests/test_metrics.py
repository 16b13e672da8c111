import random
from decimal import Decimal

import pyarrow as pa
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator

from tidemark.operators.metrics import auc_roc, classification_report, confusion, range_fold


def brute_force_auc(rows):
    positives = [s for s, y in rows if y == 1]
    negatives = [s for s, y in rows if y == 0]
    halves = sum(2 if p > n else 1 if p == n else 0 for p in positives for n in negatives)
    return halves / (2 * len(positives) * len(negatives))


def scored(n, seed, digits=2):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        y = int(rng.random() < 0.3)
        rows.append((0.5 if rng.random() < 0.33 else round(rng.gauss(0.4 + 0.2 * y, 0.2), digits), y))
    return rows


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("digits", [1, 2, 9])
def test_auc_matches_brute_force(spark, adaptive, digits):
    rows = scored(700, digits, digits)
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        df = spark.createDataFrame(rows, "score double, label int").repartition(5)
        result = auc_roc(df, "score", "label").first()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert result.auc_roc == brute_force_auc(rows)
    assert (result.positives, result.negatives) == (sum(y for _, y in rows), sum(1 - y for _, y in rows))


def test_auc_equals_the_evaluator(spark):
    df = spark.createDataFrame(scored(2000, 5), "score double, label int").selectExpr(
        "score", "CAST(label AS DOUBLE) AS label"
    )
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", metricName="areaUnderROC", numBins=0)
    assert auc_roc(df, "score", "label").first().auc_roc == pytest.approx(evaluator.evaluate(df), abs=1e-12)


def test_auc_extremes(spark):
    def auc(rows):
        return auc_roc(spark.createDataFrame(rows, "score double, label int"), "score", "label").first().auc_roc

    assert auc([(0.9, 1), (0.8, 1), (0.1, 0)]) == 1.0
    assert auc([(0.1, 1), (0.9, 0)]) == 0.0
    assert auc([(0.5, 1), (0.5, 0), (0.5, 0)]) == 0.5
    assert auc([(0.5, 1)]) is None
    assert auc([]) is None


@pytest.mark.parametrize("scale", [1, 10**11])
def test_fold_is_exact_for_any_counts(scale):
    rng = random.Random(8)
    pos = [rng.randint(0, 9) * scale for _ in range(200)]
    neg = [rng.randint(0, 9) * scale for _ in range(200)]
    expected = sum(p * (2 * sum(neg[:i]) + neg[i]) for i, p in enumerate(pos))
    table = pa.table({"p": pos, "n": neg, "part": pa.array([3] * 200, pa.int32())})
    for size in (7, 200):
        (row,) = range_fold()(table.to_batches(max_chunksize=size))
        assert row.to_pylist() == [{"_part": 3, "_won": Decimal(expected), "_pos": sum(pos), "_neg": sum(neg)}]
    assert list(range_fold()([])) == []


def test_two_shuffles_of_the_scores(spark):
    df = spark.createDataFrame([(0.1, 0)], "score double, label int")
    plan = auc_roc(df, "score", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") + plan.count("Exchange rangepartitioning(") == 2


def report(spark, pairs):
    df = spark.createDataFrame(pairs, "label int, prediction int")
    return {r["name"]: r for r in classification_report(df, "label", "prediction").collect()}


def test_report_by_hand(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 1 + [(1, 0)] * 2 + [(1, 1)] * 2
    lines = report(spark, pairs)
    assert list(lines) == ["No Churn", "Churn", "accuracy", "macro avg", "weighted avg"]
    stay, churn = lines["No Churn"], lines["Churn"]
    assert (stay.precision, stay.recall, stay.support) == (5 / 7, 5 / 6, 6)
    assert (churn.precision, churn.recall, churn.support) == (2 / 3, 2 / 4, 4)
    assert stay.f1_score == pytest.approx(10 / 13) and churn.f1_score == pytest.approx(4 / 7)
    assert (lines["accuracy"].f1_score, lines["accuracy"].support) == (0.7, 10)
    assert lines["accuracy"].precision is None
    assert lines["macro avg"].recall == pytest.approx((5 / 6 + 1 / 2) / 2)
    assert lines["weighted avg"].precision == pytest.approx((5 / 7 * 6 + 2 / 3 * 4) / 10)


def test_empty_denominators_are_zero(spark):
    lines = report(spark, [(0, 0), (1, 0)])
    assert (lines["Churn"].precision, lines["Churn"].recall, lines["Churn"].f1_score) == (0.0, 0.0, 0.0)
    lines = report(spark, [])
    assert (lines["accuracy"].f1_score, lines["accuracy"].support) == (0.0, 0)


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (0, 1), (1, 1)], "label int, prediction int")
    rows = confusion(df, "label", "prediction").collect()
    assert {(r.label, r.prediction): r["rows"] for r in rows} == {(0, 0): 1, (0, 1): 2, (1, 1): 1}


@pytest.mark.parametrize("bad", [(None, 0.5), (1, None), (0, float("nan"))])
def test_rows_that_cannot_be_ranked_are_refused(spark, bad):
    rows = [(1, 0.9), (0, 0.1), (1, 0.4), bad, bad]
    with pytest.raises(Exception, match="2 rows with null or NaN in label or score"):
        auc_roc(spark.createDataFrame(rows, "label int, score double"), "score", "label").collect()


@pytest.mark.parametrize("bad", [(2, 0), (None, 1), (0, 2), (1, None)])
def test_values_outside_the_named_classes_are_refused(spark, bad):
    rows = [(0, 0), (1, 1), (0, 1), bad]
    report = classification_report(spark.createDataFrame(rows, "label int, prediction int"), "label", "prediction")
    assert [name for name, _ in report.dtypes] == ["name", "precision", "recall", "f1_score", "support"]
    with pytest.raises(Exception, match="1 values of label or prediction"):
        report.collect()
