import random

import pytest

from tidemark.config import JobConfig, ModelParams
from tidemark.operators.model import load_model, predict
from tidemark.operators.quality import QualityError
from tidemark.plans.batch import build_gold, build_silver, run_batch
from tidemark.sources.runs import scan_runs
from tidemark.sources.tables import current_location, scan_table

HEADER = "customerID,SeniorCitizen,tenure,PhoneService,InternetService,Contract,MonthlyCharges,TotalCharges,Churn,extra"


def write_raw(path, n, seed=1):
    rng = random.Random(seed)
    lines = [HEADER]
    for i in range(n):
        churn = rng.random() < 0.3
        charge = rng.uniform(60, 110) if churn else rng.uniform(20, 70)
        tenure = rng.randint(0, 60)
        total = " " if tenure == 0 else f"{charge * tenure:.2f}"
        contract = rng.choice(["Month-to-month", "One year", "Two year"])
        internet = rng.choice(["DSL", "Fiber optic", "No"])
        line = f"C{i},0,{tenure},Yes,{internet},{contract},{charge:.2f},{total},{'Yes' if churn else 'No'},x"
        lines += [line] * (2 if i % 10 == 0 else 1)
    path.write_text("\n".join(lines) + "\n")
    return str(path)


@pytest.fixture
def config(tmp_path):
    raw = write_raw(tmp_path / "raw.csv", 600)
    return JobConfig.under(str(tmp_path / "lake"), raw, min_rows=500, model=ModelParams(rounds=3))


def test_whole_run(spark, config):
    result = run_batch(spark, config)
    assert all(line["passed"] for line in result.quality)
    assert result.rows == {"silver": 600, "gold": 600}
    gold = scan_table(spark, config.gold_path)
    assert gold.count() == 600
    run = scan_runs(spark, config.runs_path).first()
    assert run.run_name == "gradient-boosting-v1"
    assert run.params == {"n_estimators": "3", "learning_rate": "0.1", "max_depth": "4"}
    assert run.metrics == {"auc_roc": result.trained.auc}
    assert run.model_path == result.model_path
    assert predict(load_model(run.model_path), gold).count() == 600
    run_batch(spark, config)
    assert scan_runs(spark, config.runs_path).count() == 2


def test_failed_check_stops_the_run_and_keeps_the_published_gold(spark, config, tmp_path):
    build_silver(spark, config)
    build_gold(spark, config)
    before = current_location(spark, config.gold_path)
    write_raw(tmp_path / "raw.csv", 400)
    with pytest.raises(QualityError, match="min_rows.*observed 400, expected 500"):
        run_batch(spark, config)
    assert current_location(spark, config.gold_path) == before
    assert scan_table(spark, config.gold_path).count() == 600
    with pytest.raises(Exception, match="(?i)path"):
        scan_runs(spark, config.runs_path).count()


def test_defaults():
    config = JobConfig.under("base", "raw")
    assert config.min_rows == 5000
    assert (config.silver_path, config.gold_path) == ("base/silver/customers", "base/gold/features")
