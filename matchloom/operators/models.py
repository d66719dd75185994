"""Preprocessing, the linear and the boosted classifier, calibration and scoring, all on pyspark.ml."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators.boosting import Grower, as_model, binary_slots, boosted_trees, slot_bounds
from matchloom.operators.calibration import block_ends, isotonic_blocks
from matchloom.session import settle

#: How many rows a merged row stands for.
COUNT = "_rows"
#: Rows that a task of a fit holds at most, and at least where there are cores to spare.
FIT_ROWS, FIT_ROWS_LEAST = 1_000_000, 5_000
#: Rows that are worth a further task for boosting, where a job for each level of a tree takes about a tenth of a second.
GROW_ROWS = 1_000_000


def preprocessor(numeric: list[str], categorical: list[str]) -> Pipeline:
    """Numbers are standardised; a category is one slot for each value seen in training, and an unknown one fills none."""
    index, hot = [f"{c}_index" for c in categorical], [f"{c}_hot" for c in categorical]
    stages = [
        VectorAssembler(inputCols=numeric, outputCol="numeric"),
        StandardScaler(inputCol="numeric", outputCol="scaled", withMean=True),
    ]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=index, handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=index, outputCols=hot),
        ]
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=["scaled", *hot], outputCol="features")])


def slot_sources(prepared: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    """The column that each slot of the feature vector stems from."""
    if not categorical:
        return list(numeric)
    seen = prepared.stages[2].labelsArray
    return list(numeric) + [c for c, values in zip(categorical, seen, strict=True) for _ in values]


@dataclass
class Trained:
    """A fitted chain; the calibrator is fitted on rows that the classifier has not seen."""

    prepared: PipelineModel
    classifier: object
    calibrator: IsotonicRegressionModel | None = None

    def score(self, df: DataFrame) -> DataFrame:
        """df with ``features``, ``p_raw`` and ``p`` (calibrated where there is a calibrator)."""
        own = {c: f"_{c}" for c in ("rawPrediction", "probability", "prediction") if c in df.columns}
        scored = self.classifier.transform(self.prepared.transform(df.withColumnsRenamed(own)))
        scored = scored.withColumn("p_raw", vector_to_array("probability")[1])
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored.drop("prediction"))
            p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prediction")))
        else:
            p = F.col("p_raw")
        scored = scored.withColumn("p", p)
        return scored.select(*[F.col(v).alias(k) if k in own else F.col(k) for k, v in ((c, own.get(c, c)) for c in df.columns)], "features", "p_raw", "p")


def number(df: DataFrame) -> Column:
    """How many rows a row of df stands for."""
    return F.col(COUNT) if COUNT in df.columns else F.lit(1)


def positive_weight(df: DataFrame, label: str) -> float:
    """What a positive weighs for positives to weigh as much in all as negatives."""
    n = df.agg(*[F.coalesce(F.sum(F.when(F.col(label) == k, number(df))), F.lit(0)).alias(name) for k, name in ((1, "pos"), (0, "neg"))]).first()
    if not n["pos"] or not n["neg"]:
        raise ValueError("training rows need both classes")
    return n["neg"] / n["pos"]


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: positives weigh as much in all as negatives."""
    return df.withColumn("weight", F.when(F.col(label) == 1, positive_weight(df, label)).otherwise(1.0))


def inputs(prepared: PipelineModel) -> list[str]:
    """The columns that a fitted preprocessor reads."""
    first, *others = [stage for stage in prepared.stages if stage.hasParam("inputCols") and stage.isSet("inputCols")][:2]
    return [*first.getInputCols(), *(c for stage in others if isinstance(stage, StringIndexerModel) for c in stage.getInputCols())]


def merged(prepared: PipelineModel, df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(inputs, label, _rows): rows of equal values once, with their number, and the weight that goes by the label; settled."""
    if COUNT in df.columns:
        return df
    own = [] if weight is None else [F.first(weight).alias(weight)]
    return settle(df.groupBy(*inputs(prepared), F.col(label).cast("double").alias(label)).agg(F.count("*").alias(COUNT), *own), "fit")


def tasks_of(n: int, df: DataFrame, least: int) -> int:
    """Over how many tasks, at most as many as run at once, n rows are dealt."""
    return max(min(df.sparkSession.sparkContext.defaultParallelism, n // least), 1)


def equal_rows(prepared: PipelineModel, df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(features, label, weight): rows of equal values are one that weighs as they do together, dealt evenly over the tasks.

    A table of one file is one task however many cores there are, and a fit passes over it some thousand times.
    """
    counted = merged(prepared, df, label, weight)
    n, own = counted.count(), F.lit(1.0) if weight is None else F.col(weight)
    rows = counted.select(*inputs(prepared), F.col(label).alias("_label"), (F.col(COUNT) * own).alias("weight"))
    rows = rows.repartition(max(tasks_of(n, df, FIT_ROWS_LEAST), n // FIT_ROWS))
    return prepared.transform(rows).select("features", F.col("_label").alias("label"), "weight")


def fit_linear(prepared: PipelineModel, train: DataFrame, label: str, c: float = 1.0, iterations: int = 1000) -> Trained:
    """Logistic regression whose penalty is 1 / (c * rows), as a summed loss with strength c has it."""
    rows = equal_rows(prepared, train, label)
    n = train.agg(F.sum(number(train))).first()[0]
    model = LogisticRegression(maxIter=iterations, regParam=1.0 / (c * n), standardization=False, weightCol="weight").fit(rows)
    return Trained(prepared, model)


def fit_boosted(
    prepared: PipelineModel, train: DataFrame, val: DataFrame, label: str,
    trees: int = 400, depth: int = 6, step: float = 0.05, seed: int = 42, patience: int = 30, **options,
) -> Trained:
    """Boosted trees with class weights; kept are the rounds up to the least loss on the validation rows.

    The loss counts as least where `patience` further rounds bring no less; no round after them could be kept, so none is
    fitted. The library's own stopping ends at the first small gain, which a small step gives at once. With `options` for
    the library's tree learner the library grows all rounds itself, which takes several jobs for each level of a tree.
    """
    if options:
        return _library_boosted(prepared, train, val, label, trees, depth, step, seed, patience, options)
    train, val = merged(prepared, train, label), merged(prepared, val, label)
    grower_rows = [
        df.select(*inputs(prepared), F.col(label).alias("_label"), F.col(COUNT).cast("double").alias("weight"), F.lit(held).alias("held"))
        for df, held in ((train, False), (val, True))
    ]
    learner = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, weightCol="weight", seed=seed)
    weighed = equal_rows(prepared, class_weights(train, label), label, "weight")
    tasks = tasks_of(train.count(), train, GROW_ROWS)
    rows = prepared.transform(grower_rows[0].unionByName(grower_rows[1]).repartition(tasks)).select("features", F.col("_label").alias("label"), "weight", "held")
    bounds = slot_bounds(weighed, learner)
    grower = Grower(bounds, binary_slots(weighed), positive_weight(train, label), depth)

    def kept(losses: list[float]) -> tuple[int, bool]:
        best = best_rounds(losses, patience)
        return best, len(losses) - best >= patience

    grown = boosted_trees(rows, grower, len(bounds), trees, step, kept, tasks)
    return Trained(prepared, as_model(train.sparkSession, grown, step, depth, seed, len(bounds)))


def _library_boosted(prepared, train, val, label, trees, depth, step, seed, patience, options) -> Trained:
    rows = equal_rows(prepared, class_weights(train, label), label, "weight")
    held = equal_rows(prepared, val, label)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, weightCol="weight", seed=seed, **options).fit(rows)
    losses = model.evaluateEachIteration(held) if held.take(1) else []
    return Trained(prepared, first_rounds(model, best_rounds(losses, patience) if losses else trees))


def best_rounds(losses: list[float], patience: int) -> int:
    """The number of rounds with the least loss before `patience` rounds in a row bring no less."""
    best = 0
    for k, loss in enumerate(losses):
        if loss < losses[best]:
            best = k
        elif k - best >= patience:
            break
    return best + 1


def ensemble(trees: list, weights: list[float], n_features: int, uid: str | None = None) -> GBTClassificationModel:
    """A classifier of given regression trees; the library offers no public way to make one."""
    context = SparkContext._active_spark_context
    kind = context._jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel
    held, shares = context._gateway.new_array(kind, len(trees)), context._gateway.new_array(context._jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        held[k], shares[k] = tree._java_obj, float(weight)
    made = context._jvm.org.apache.spark.ml.classification.GBTClassificationModel(uid or f"boosted_{uuid.uuid4().hex[:12]}", held, shares, n_features, 2)
    return GBTClassificationModel(made)


def first_rounds(model: GBTClassificationModel, rounds: int) -> GBTClassificationModel:
    if rounds >= model.getNumTrees:
        return model
    return ensemble(model.trees[:rounds], list(model.treeWeights)[:rounds], model.numFeatures, model.uid)


def calibrated(trained: Trained, val: DataFrame, label: str) -> Trained:
    """Isotonic calibration on distinct scores as they are: the blocks come from ranges, and the model keeps their ends."""
    rows = merged(trained.prepared, val, label)  # equal rows have one score
    scored = settle(trained.score(rows).select("p_raw", label, COUNT), "val-scores")
    points = block_ends(isotonic_blocks(scored, "p_raw", label, count=COUNT))
    model = IsotonicRegression(featuresCol="p_raw", labelCol="label", weightCol="weight").fit(points)
    return Trained(trained.prepared, trained.classifier, model)
