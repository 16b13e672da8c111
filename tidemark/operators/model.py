"""Train and apply the churn classifier with Spark ML; rows never leave the executors."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from py4j.java_gateway import JavaObject
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import CATEGORIES, FEATURES, LABEL, ModelParams
from tidemark.operators.boosting import (
    NEVER,
    TREE_SCHEMA,
    Layout,
    Rounds,
    Tree,
    cell_maker,
    cuts_of,
    finer_starts,
    first_starts,
    level_sums,
    range_counter,
    refined,
    rescored,
    trees_of,
    whole_fit,
)
from tidemark.operators.encode import CategoryCodes, category_codes, label_encode
from tidemark.operators.metrics import auc_roc, classification_report
from tidemark.operators.sizing import store
from tidemark.operators.split import stratified_split
from tidemark.session import enable_checkpoints, run_scratch

# Up to so many cells of binned rows are boosted in one task; beyond that a level of a tree is a job.
WHOLE_CELLS = 1_000_000
# Below this many rows a task of such a job costs more to start than to run; very large tables get
# larger tasks instead of more.
ROWS_PER_TASK = 250_000
MAX_TASKS = 30_000

# A level's sums are for all its nodes at once, so they double with each level.
DEEPEST = 10


@dataclass(frozen=True)
class Trained:
    """A fitted model with the held-out rows it was scored on."""

    model: PipelineModel
    scored: DataFrame
    auc: float | None
    report: DataFrame


def encode_categories(gold: DataFrame, columns: Sequence[str] = CATEGORIES) -> DataFrame:
    """Gold with a code column per category; training takes these as they are.

    The code tables stay distributed, so a column may have any number of labels.
    """
    for column in columns:
        gold = label_encode(gold, column, f"{column}_enc")
    return gold


def _encoder(gold: DataFrame, features: Sequence[str]) -> list[CategoryCodes]:
    """The in-model encoder for those categories that are used and not encoded yet."""
    open_ = [c for c in CATEGORIES if f"{c}_enc" in features and f"{c}_enc" not in gold.columns]
    return [category_codes(gold, open_, [f"{c}_enc" for c in open_])] if open_ else []


def fill_zero(df: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Nulls and NaNs of the listed columns as 0."""
    return df.na.fill(0, subset=list(columns))


def feature_stages(features: Sequence[str] = FEATURES) -> list:
    """Stages that turn the feature columns into one vector, with 0 for a missing value.

    The filled copies carry no category metadata, so the trees treat codes as numbers.
    """
    filled = ", ".join(f"coalesce(nanvl(CAST(`{c}` AS DOUBLE), 0D), 0D) AS `{c}_in`" for c in features)
    return [
        SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__"),
        VectorAssembler(inputCols=[f"{c}_in" for c in features], outputCol="features"),
    ]


def select_features(gold: DataFrame, encoder: CategoryCodes | None = None) -> DataFrame:
    """Gold rows with the model's input vector in ``features``."""
    stages = [*([encoder] if encoder else _encoder(gold, FEATURES)), *feature_stages()]
    return Pipeline(stages=stages).fit(gold).transform(gold)


class BoostedTrees(GBTClassifier):
    """Spark's estimator, fitted on cells of binned rows; what comes out is Spark's own model.

    All rows are read to find the cuts, once for each level of detail, and once to be counted by bins
    and class. The rounds run over these cells: as many as there are rows at worst, and far fewer where
    features are flags or depend on each other. It heeds the columns, ``maxIter``, ``stepSize``,
    ``maxDepth``, ``maxBins`` and ``checkpointInterval``; the loss is the logistic one, and every round
    sees all rows and features. Deeper trees than ``DEEPEST`` are left to Spark's learner.
    """

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        with run_scratch(dataset.sparkSession):
            return self._copyValues(self._fitted(dataset))

    def _fitted(self, dataset: DataFrame) -> GBTClassificationModel:
        label = F.col(self.getLabelCol())
        found = F.coalesce(label.cast("string"), F.lit("null"))
        told = F.concat(F.lit(f"{self.getLabelCol()} must be 0 or 1, not "), found)
        known = F.when(label.isin(0, 1), label.cast("int")).otherwise(F.raise_error(told).cast("int"))
        rows = store(dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), known.alias("y")))
        if self.getMaxDepth() > DEEPEST:
            laid = spread(rows.withColumn("_key", F.xxhash64("x")), "_key")
            vector = array_to_vector("x").alias(self.getFeaturesCol())
            return super()._fit(laid.select(vector, F.col("y").alias(self.getLabelCol())))
        bins = self.getMaxBins()
        ranges = value_ranges(rows, bins)
        cuts = [cuts_of(r, bins) for r in ranges]
        layout = Layout.of(cuts)
        cells = cells_of(rows, cuts, layout)
        n = int(ranges[0][:, 0].sum())
        rounds = Rounds.over(layout, n, self.getMaxIter(), self.getStepSize(), self.getMaxDepth())
        trees = boosted(cells, rounds, self.getCheckpointInterval())
        return spark_model(dataset.sparkSession, self.uid, trees, rounds, cuts)


def _counted(rows: DataFrame, starts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per feature the places of ``starts`` with rows, and their ``n, low, high``, in order."""
    schema = "feature int, at bigint, n bigint, low bigint, high bigint"
    parts = rows.select("x").mapInArrow(range_counter(starts), schema).groupBy("feature", "at")
    found = parts.agg(F.sum("n"), F.min("low"), F.max("high")).toArrow()
    feature, at, *rest = [column.to_numpy() for column in found.columns]
    order = np.lexsort((at, feature))
    feature, at, counts = feature[order], at[order], np.stack(rest, axis=1)[order]
    return [(at[feature == i], counts[feature == i]) for i in range(len(starts))]


def value_ranges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Per feature ``n, low, high`` of ranges of its values in order, from all rows.

    A range of more than one value holds at most an eighth of a bin's rows. What reaches the driver is
    bounded by the number of ranges.
    """
    width = rows.select(F.size("x")).first()
    if width is None:
        raise ValueError("no rows to train on")
    ranges = [counts for _, counts in _counted(rows, [first_starts()] * width[0])]
    while any(map(len, starts := [finer_starts(r, bins) for r in ranges])):
        counted = _counted(rows, starts)
        ranges = [
            refined(r, bins, s, *found) if len(s) else r for r, s, found in zip(ranges, starts, counted, strict=True)
        ]
    return ranges


def cells_of(rows: DataFrame, cuts: list[np.ndarray], layout: Layout) -> DataFrame:
    """Training rows counted by bins and class, with a score of 0."""
    schema = ", ".join([*[f"{w} bigint" for w in layout.words], "y int"])
    counts = rows.mapInArrow(cell_maker(cuts, layout), schema).groupBy(*layout.words)
    positives = F.sum("y").alias("positives")
    counted = counts.agg(positives, (F.count(F.lit(1)) - F.sum("y")).alias("negatives"))
    return store(counted.withColumn("score", F.lit(0.0)))


def boosted(cells: DataFrame, rounds: Rounds, interval: int) -> list[Tree]:
    """The trees: from one task where it may hold all cells, or else from a job for each level.

    Stored scores are brought up to date every ``interval`` rounds; the jobs in between add the trees since then.
    """
    if cells.count() <= WHOLE_CELLS:
        found = cells.coalesce(1).mapInArrow(whole_fit(rounds), TREE_SCHEMA)
        return trees_of(found.toArrow(), max(1, rounds.depth))
    cells = store(spread(cells, rounds.layout.words[0]))
    seen, before = 0, []

    def histogram(tree: Tree, level: int, first: bool, squares: bool) -> np.ndarray:
        parts = cells.mapInArrow(level_sums(rounds, before, tree, level, first, squares), "at bigint, n bigint")
        found = parts.groupBy("at").agg(F.sum("n")).toArrow()
        shape = (2 + squares, len(rounds.layout.word), (1 << level) * rounds.layout.bins)
        sums = np.zeros(shape)
        sums.ravel()[found.column(0).to_numpy()] = found.column(1).to_numpy()
        return sums

    def done(tree: Tree) -> None:
        nonlocal cells, seen, before
        before = [*before, (tree, rounds.weight(seen))]
        seen += 1
        if len(before) == interval and seen < rounds.rounds:
            cells, before = store(cells.mapInArrow(rescored(rounds.layout, before), cells.schema)), []

    return rounds.run(histogram, done)


def spark_model(
    spark: SparkSession, uid: str, trees: list[Tree], rounds: Rounds, cuts: list[np.ndarray]
) -> GBTClassificationModel:
    """The trees as Spark's model, each node with its statistics."""
    ml, new_array = spark._jvm.org.apache.spark.ml, spark.sparkContext._gateway.new_array
    variance = spark._jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator
    number, regression = spark._jvm.double, ml.regression.DecisionTreeRegressionModel

    def impurity(tree: Tree, node: int) -> float:
        return max(0.0, float(tree.squares[node] / tree.rows[node] - tree.value[node] ** 2))

    def node_of(tree: Tree, node: int) -> JavaObject:
        stats = new_array(number, 3)
        stats[0], stats[1], stats[2] = [float(x[node]) for x in (tree.rows, tree.total, tree.squares)]
        known = variance(stats, int(tree.rows[node]))
        value, found = float(tree.value[node]), impurity(tree, node)
        if node >= 1 << tree.levels or tree.cut[node] == NEVER:
            return ml.tree.LeafNode(value, found, known)
        sides = [2 * node, 2 * node + 1]
        gain = found - sum(float(tree.rows[s] / tree.rows[node]) * impurity(tree, s) for s in sides)
        feature = int(tree.feature[node])
        split = ml.tree.ContinuousSplit(feature, float(cuts[feature][tree.cut[node]]))
        return ml.tree.InternalNode(value, found, gain, *[node_of(tree, s) for s in sides], split, known)

    fitted, weights = new_array(regression, len(trees)), new_array(number, len(trees))
    for i, tree in enumerate(trees):
        fitted[i], weights[i] = regression(node_of(tree, 1), len(cuts)), rounds.weight(i)
    return GBTClassificationModel(ml.classification.GBTClassificationModel(uid, fitted, weights, len(cuts), 2))


def classifier(params: ModelParams, label: str = LABEL) -> BoostedTrees:
    return BoostedTrees(
        featuresCol="features",
        labelCol=label,
        maxIter=params.rounds,
        stepSize=params.learning_rate,
        maxDepth=params.depth,
        seed=params.seed,
        checkpointInterval=10,
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows in as many tasks as follow from their number alone, for the many jobs over them.

    ``df`` is counted first, so it should be a stored table.
    """
    tasks = min(MAX_TASKS, max(1, -(-df.count() // ROWS_PER_TASK)))
    return df.repartition(tasks, key).sortWithinPartitions(key)


def train_gbt(
    gold: DataFrame,
    train: DataFrame,
    params: ModelParams | None = None,
    features: Sequence[str] = FEATURES,
) -> PipelineModel:
    """Fit encoder (on all of gold) and trees (on the training rows) as one saved-together model.

    Categories that both tables have as codes already, see ``encode_categories``, need no encoder.
    The model follows from the training rows alone, not from how they lie or from the cluster.
    """
    enable_checkpoints(gold.sparkSession)
    stages = [*_encoder(gold, features), *feature_stages(features), classifier(params or ModelParams())]
    return Pipeline(stages=stages).fit(train)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``churn_probability`` (class 1) and ``prediction`` (0 or 1)."""
    return model.transform(df).select(
        *[F.col(c) for c in df.columns],
        vector_to_array("probability")[1].alias("churn_probability"),
        F.col("prediction").cast("int").alias("prediction"),
    )


def train_and_evaluate(
    gold: DataFrame,
    params: ModelParams | None = None,
    key: str = "customer_id",
    features: Sequence[str] = FEATURES,
) -> Trained:
    """Split, train, score the held-out part and measure it. ``gold`` should be a stored table."""
    params = params or ModelParams()
    parts = stratified_split(gold, key, LABEL, params.test_size, params.seed)
    train = parts.where(F.col("split") == "train").drop("split")
    test = parts.where(F.col("split") == "test").drop("split")
    model = train_gbt(gold, train, params, features)
    # Scored once: the metrics and the caller read the stored scores.
    scored = store(predict(model, test).select(key, LABEL, "churn_probability", "prediction"))
    return Trained(
        model=model,
        scored=scored,
        auc=auc_roc(scored, "churn_probability", LABEL).first()["auc_roc"],
        report=classification_report(scored, LABEL, "prediction"),
    )


def save_model(model: PipelineModel, path: str) -> str:
    """Save a model, with its tables of codes, under a path that may hold another one."""
    for stage in model.stages:
        if isinstance(stage, CategoryCodes) and stage.getOrDefault("path").startswith(f"{path.rstrip('/')}/"):
            raise ValueError(f"{path} holds the codes this model reads; save it under another path")
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
