import math
import random

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.catalog import model as catalog_model
from tidemark.config import FEATURES, GOLD_SCHEMA, ModelParams
from tidemark.operators import model as m
from tidemark.operators import encode
from tidemark.operators.encode import category_codes, label_encode, lookup
from tidemark.operators.metrics import auc_roc
from tidemark.operators.sizing import store

SMALL = ModelParams(rounds=5)


@pytest.fixture(scope="module")
def gold(spark):
    rng = random.Random(11)
    rows = []
    for i in range(1200):
        churn = int(rng.random() < 0.3)
        contract = rng.choice(["Month-to-month"] * (4 if churn else 1) + ["One year", "Two year"])
        charge = rng.uniform(60, 110) if churn else rng.uniform(20, 80)
        tenure = rng.randint(0, 20) if churn else rng.randint(5, 72)
        internet = None if i % 97 == 0 else rng.choice(["DSL", "Fiber optic", "No"])
        total = None if i % 41 == 0 else charge * tenure
        rows.append(
            (f"C{i}", i % 2, tenure, charge, total, contract, internet, 1, int(internet not in ("No", None)),
             int(contract == "Month-to-month"), int(contract == "Two year"),
             total / tenure if total and tenure else charge, int(charge > 65), int(tenure > 24), churn)
        )
    return spark.createDataFrame(rows, GOLD_SCHEMA)


@pytest.fixture(scope="module")
def trained(gold):
    return m.train_and_evaluate(gold, SMALL)


def test_auc_above_a_floor(trained):
    assert trained.auc > 0.85
    assert trained.auc == auc_roc(trained.scored, "churn_probability", "churn").first().auc_roc


def test_scores_only_the_held_out_rows(trained):
    assert trained.scored.count() == 240
    row = trained.scored.first()
    assert 0 <= row.churn_probability <= 1
    assert trained.scored.where("prediction <> CAST(churn_probability > 0.5 AS INT)").count() == 0


def test_report_lines(trained):
    lines = {r["name"]: r for r in trained.report.collect()}
    assert lines["accuracy"].support == 240
    assert lines["No Churn"].support + lines["Churn"].support == 240


def test_same_seed_same_result(gold, trained):
    """Equal up to the rounding of sums that tasks deliver in any order."""
    again = {r.customer_id: r for r in m.train_and_evaluate(gold.repartition(3), SMALL).scored.collect()}
    first = {r.customer_id: r for r in trained.scored.collect()}
    assert set(again) == set(first)
    for key, row in first.items():
        assert again[key].prediction == row.prediction
        assert again[key].churn_probability == pytest.approx(row.churn_probability, rel=1e-9)


def test_reloaded_model_predicts_the_same(gold, trained, tmp_path):
    path = m.save_model(trained.model, str(tmp_path / "model"))
    loaded = m.load_model(path)
    columns = ["customer_id", "churn_probability", "prediction"]
    before = sorted(map(tuple, m.predict(trained.model, gold).select(*columns).collect()))
    assert sorted(map(tuple, m.predict(loaded, gold).select(*columns).collect())) == before


def test_scores_rows_without_a_label_and_with_new_categories(spark, gold, trained):
    new = gold.drop("churn").limit(5).selectExpr("* EXCEPT (contract)", "'Weekly' AS contract")
    assert m.predict(trained.model, new).where("prediction IS NULL").count() == 0


def test_feature_vector(gold):
    values = m.select_features(gold).select("*", vector_to_array("features").alias("v")).collect()
    codes = {"Month-to-month": 0.0, "One year": 1.0, "Two year": 2.0}
    internet = {"DSL": 0.0, "Fiber optic": 1.0, "No": 2.0, None: 3.0}
    for row in values:
        assert len(row.v) == len(FEATURES) == 13
        assert row.v[2] == row.monthly_charges
        assert row.v[3] == (row.total_charges or 0.0)
        assert row.v[11] == codes[row.contract]
        assert row.v[12] == internet[row.internet_service]


def test_table_encoder_agrees_with_the_model_encoder(gold):
    inside = m.select_features(gold).select("customer_id", "internet_service_enc")
    table = label_encode(gold, "internet_service", "code").select("customer_id", "code")
    assert inside.join(table, "customer_id").where("internet_service_enc <> code").count() == 0


def test_codes_are_numbers_to_the_trees(gold):
    attributes = m.select_features(gold).schema["features"].metadata["ml_attr"]["attrs"]
    assert set(attributes) == {"numeric"}


def test_any_number_of_labels(spark, gold):
    """Codes made outside the model are used as they are."""
    wide = gold.withColumn("contract", F.concat_ws("-", "contract", "customer_id"))
    many = wide.unionByName(
        spark.range(20_000).select(F.concat(F.lit("N"), "id").alias("customer_id")).join(
            gold.drop("customer_id", "contract").limit(1)
        ).withColumn("contract", F.concat(F.lit("L"), "customer_id")).select(*gold.columns)
    )
    encoded = store(m.encode_categories(many))
    assert encoded.select("contract_enc").distinct().count() == 21_200
    model = m.train_gbt(encoded, encoded, ModelParams(rounds=2))
    assert len(model.stages) == 3
    assert m.predict(model, encoded).where("prediction IS NULL").count() == 0


def test_training_does_not_depend_on_the_cluster(spark):
    """More rows than the learner looks at without sampling, from several layouts of the input."""
    rows = spark.range(30_000).select(
        F.concat(F.lit("C"), "id").alias("customer_id"),
        *[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10_007)) / 7).alias(f"x{i}") for i in range(4)],
    )
    churn = (F.col("x0") + F.col("x1") * F.sin("x2") + F.col("x3") > 1_500).cast("int")
    stored = store(rows.withColumn("churn", churn))
    features = [f"x{i}" for i in range(4)]
    found = {}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts, shuffles in ((1, "3"), (5, "8"), (12, "17")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        model = m.train_gbt(stored, stored.repartition(parts), ModelParams(rounds=3), features=features)
        scored = m.predict(model, stored).select("customer_id", "churn_probability", "prediction")
        found[parts] = sorted(map(tuple, scored.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for other in (5, 12):
        for a, b in zip(found[1], found[other], strict=True):
            assert (a[0], a[2]) == (b[0], b[2]) and a[1] == pytest.approx(b[1], abs=1e-9)


def test_hyperparameters():
    params = ModelParams()
    trees = m.classifier(params)
    assert (trees.getMaxIter(), trees.getStepSize(), trees.getMaxDepth(), trees.getSeed()) == (100, 0.1, 4, 42)
    assert params.logged() == {"n_estimators": "100", "learning_rate": "0.1", "max_depth": "4"}


def test_fill_zero(spark):
    df = spark.createDataFrame([(None, float("nan"), None)], "a int, b double, c double")
    row = m.fill_zero(df, ["a", "b"]).first()
    assert (row.a, row.b, row.c) == (0, 0.0, None)
    stages = m.feature_stages(["a", "b"])
    assert isinstance(stages[1], VectorAssembler)
    assert list(stages[1].transform(stages[0].transform(df)).first().features) == [0.0, 0.0]


def test_layout_follows_from_the_rows(spark, monkeypatch):
    for parts in (1, 9):
        df = spark.range(0, 100, 1, parts)
        assert m.spread(df, "id").rdd.getNumPartitions() == 1
        with monkeypatch.context() as patch:
            patch.setattr(m, "ROWS_PER_TASK", 40)
            assert m.spread(df, "id").rdd.getNumPartitions() == 3
            patch.setattr(m, "MAX_TASKS", 2)
            assert m.spread(df, "id").rdd.getNumPartitions() == 2


def test_report_is_of_the_production_settings(spark, monkeypatch):
    """The query fits with the default settings; what it returns is not fitted here."""
    asked = []

    def trained(spark, sf_dir, params=None, features=FEATURES):
        asked.append(params or ModelParams())
        report = spark.createDataFrame([("accuracy",)], "name string")
        return m.Trained(model=None, scored=None, auc=0.5, report=report)

    monkeypatch.setattr(catalog_model, "trained", trained)
    assert catalog_model.model_report_query(spark, "").columns == ["name", "auc_roc"]
    assert asked == [ModelParams()] and asked[0].rounds == 100


def boosted(rows, params, flags):
    """Scores by combination of flags, the trees worked out by hand."""
    cells = {}
    for row in rows:
        cells.setdefault(tuple(row[f] for f in flags), []).append(2 * row["churn"] - 1)
    scores = {}
    for cell, labels in cells.items():
        f = sum(labels) / len(labels)
        for _ in range(params.rounds - 1):
            f += params.learning_rate * sum(4 * y / (1 + math.exp(2 * y * f)) for y in labels) / len(labels)
        scores[cell] = 1 / (1 + math.exp(-2 * f))
    return scores


def test_boosting_in_closed_form(gold):
    """Rounds, rate and split decide the scores; changing any of them changes these."""
    flags = catalog_model.FLAGS[:2]
    params = ModelParams(rounds=3, learning_rate=0.3, depth=2)
    fitted = m.train_and_evaluate(gold, params, features=flags)
    held_out = {r.customer_id: r.churn_probability for r in fitted.scored.collect()}
    rows = {r.customer_id: r for r in gold.collect()}

    def worst(params, train):
        scores = boosted([rows[i] for i in train], params, flags)
        return max(abs(p - scores[tuple(rows[i][f] for f in flags)]) for i, p in held_out.items())

    train = set(rows) - set(held_out)
    assert worst(params, train) < 1e-9
    assert worst(ModelParams(rounds=4, learning_rate=0.3), train) > 1e-6
    assert worst(ModelParams(rounds=3, learning_rate=0.1), train) > 1e-6
    assert worst(params, set(rows)) > 1e-6


def test_a_million_labels_saved_and_loaded(spark, gold, tmp_path):
    """The model holds no label: its table of codes is stored next to it and joined."""
    n = 1_000_000
    one = gold.limit(1).drop("customer_id", "contract")
    wide = spark.range(n).select(
        F.concat(F.lit("C"), "id").alias("customer_id"), F.format_string("L%07d", "id").alias("contract")
    )
    wide = store(wide.join(F.broadcast(one)).select(*gold.columns))
    model = m.train_gbt(wide, gold, ModelParams(rounds=1, depth=1))
    path = m.save_model(model, str(tmp_path / "model"))
    files = [f for f in (tmp_path / "model").rglob("*") if f.is_file() and "metadata" in str(f)]
    assert max(f.stat().st_size for f in files) < 10_000
    with pytest.raises(ValueError, match="another path"):
        m.save_model(m.load_model(path), path)
    loaded = m.load_model(path)
    codes = loaded.stages[0].transform(wide)
    assert codes.where("contract_enc <> CAST(substr(contract, 2) AS INT)").count() == 0
    odd = gold.limit(2).selectExpr("* EXCEPT (contract)", "CASE WHEN senior_citizen = 0 THEN 'new' END AS contract")
    assert {r.contract_enc for r in loaded.stages[0].transform(odd).collect()} == {n}
    scored = m.predict(loaded, wide)
    assert scored.count() == n and scored.where("prediction IS NULL").count() == 0


def test_codes_that_are_too_many_to_broadcast(spark, gold, monkeypatch):
    stage = category_codes(gold, ["contract", "internet_service"], ["a", "b"])
    before = sorted(map(tuple, stage.transform(gold).select("customer_id", "a", "b").collect()))
    monkeypatch.setattr(
        encode, "lookup", lambda *args: lookup(*args, broadcast_bytes=0, hot_share=0.5)
    )
    new = gold.withColumn("contract", F.when(F.col("tenure") == 3, "new").otherwise(F.col("contract")))
    assert sorted(map(tuple, stage.transform(gold).select("customer_id", "a", "b").collect())) == before
    assert {r.a for r in stage.transform(new).where("contract = 'new'").collect()} == {3}
