"""Boosted-tree training, validation, search and scoring with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from threading import Lock

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.functions.metrics import mape, rmse
from gridcast.operators.columns import complete_rows, require_rows
from gridcast.operators.folds import Fold, fraction_rows, holdout_split, walk_forward_folds
from gridcast.operators.ordered import OrderedRows, ordered_rows
from gridcast.schemas import PREDICTION, FeatureSpec

# Stands for a missing input: below every real value, so that a split can set the missing apart.
MISSING = -1.0e6


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters. Validation keeps the best round, looking no further than `patience` rounds past it."""

    iterations: int = 100
    depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 1.0
    bins: int = 128
    seed: int = 42
    patience: int = 50


@dataclass(frozen=True)
class SearchSpace:
    """The ranges searched, learning rate on a log scale."""

    iterations: tuple[int, int] = (500, 4000)
    depth: tuple[int, int] = (4, 11)
    learning_rate: tuple[float, float] = (0.01, 0.2)
    subsample: tuple[float, float] = (0.6, 1.0)
    bins: tuple[int, int] = (32, 255)

    def draw(self, generator: random.Random, seed: int = 42) -> TreeParams:
        low, high = map(math.log, self.learning_rate)
        return TreeParams(
            iterations=generator.randint(*self.iterations),
            depth=generator.randint(*self.depth),
            learning_rate=math.exp(generator.uniform(low, high)),
            subsample=generator.uniform(*self.subsample),
            bins=generator.randint(*self.bins),
            seed=seed,
        )


def training_rows(features: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Rows with a known target; ValueError when there are none."""
    return require_rows(complete_rows(features, [spec.target]), f"rows with a known {spec.target}")


def fit(
    rows: DataFrame,
    inputs: Sequence[str],
    target: str,
    params: TreeParams = TreeParams(),
    categories: Sequence[str] = (),
) -> PipelineModel:
    """Fit boosted trees, all rounds of them.

    `categories` names the inputs that stand for kinds and not for amounts. They are marked as nominal,
    so that a split sets any of their levels apart from the others; levels come from the rows, of which
    there have to be fewer than bins. A missing or unknown one is a level of its own.
    """
    trees = GBTRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol=PREDICTION,
        maxIter=params.iterations,
        maxDepth=params.depth,
        stepSize=params.learning_rate,
        subsamplingRate=params.subsample,
        maxBins=params.bins,
        seed=params.seed,
    )
    assembler = VectorAssembler(inputCols=[f"_in_{c}" for c in inputs], outputCol="features")
    marked = [c for c in inputs if c in categories]
    levels = StringIndexer(
        inputCols=[f"_level_{c}" for c in marked],
        outputCols=[f"_in_{c}" for c in marked],
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    )
    return Pipeline(stages=[*([levels] if marked else []), assembler, trees]).fit(_inputs(rows, inputs, marked))


def best_round(errors: Sequence[float], patience: int) -> int:
    """Number of rounds with the least error, the first of equals, before `patience` rounds without a better one."""
    best = 0
    for i, error in enumerate(errors):
        if error < errors[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_best(
    train_rows: DataFrame,
    test_rows: DataFrame,
    inputs: Sequence[str],
    target: str,
    params: TreeParams,
    categories: Sequence[str] = (),
) -> tuple[PipelineModel, float]:
    """The model with the best number of rounds on the test rows, and its RMSE there.

    One fit and one pass over the test rows, which gives the error after every round; the rounds
    behind the best one are then cut off.
    """
    model = fit(train_rows, inputs, target, params, categories)
    errors = _round_errors(model, test_rows, inputs)
    rounds = best_round(errors, params.patience)
    return first_rounds(model, rounds), math.sqrt(errors[rounds - 1])


def _round_errors(model: PipelineModel, rows: DataFrame, inputs: Sequence[str]) -> list[float]:
    """Mean squared error on the rows after each round."""
    shaped = PipelineModel(model.stages[:-1]).transform(_inputs(rows, inputs, _marked(model)))
    return model.stages[-1].evaluateEachIteration(shaped, "squared")


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The model as it was after that many rounds: boosting adds trees and leaves earlier ones as they are."""
    *before, trees = model.stages
    if rounds >= trees.getNumTrees:
        return model
    spark = SparkSession.getActiveSession()
    java, gateway = trees._java_obj, spark.sparkContext._gateway
    kept = gateway.new_array(gateway.jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i, (tree, weight) in enumerate(zip(java.trees()[:rounds], trees.treeWeights[:rounds], strict=True)):
        kept[i], weights[i] = tree, weight
    cut = GBTRegressionModel(gateway.jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), kept, weights))
    for name in ("featuresCol", "predictionCol"):
        cut.set(cut.getParam(name), trees.getOrDefault(name))
    cut._transfer_params_to_java()
    return PipelineModel([*before, cut])


def _marked(model: PipelineModel) -> list[str]:
    """The inputs that a model takes as categories."""
    first = model.stages[0]
    return [c.removeprefix("_level_") for c in first.getInputCols()] if len(model.stages) == 3 else []


def predict(model: PipelineModel, rows: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """`rows` with the prediction column."""
    scored = model.transform(_inputs(rows, inputs, _marked(model)))
    return scored.select(*rows.columns, PREDICTION)


def score(model: PipelineModel, features: DataFrame, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """Key, time and prediction for every feature row."""
    return predict(model, features, spec.inputs).select(*spec.keys, spec.time, PREDICTION)


def _inputs(rows: DataFrame, inputs: Sequence[str], categories: Sequence[str] = ()) -> DataFrame:
    filled = {f"_in_{c}": F.coalesce(F.col(c).cast("double"), F.lit(MISSING)) for c in inputs if c not in categories}
    return rows.withColumns({**filled, **{f"_level_{c}": F.col(c).cast("string") for c in categories}})


def _order(spec: FeatureSpec) -> list[str]:
    return [spec.time, *spec.keys]


# --- cross-validation ---------------------------------------------------------------------


@dataclass(frozen=True)
class CrossValidation:
    """Long tables: `fold, rmse, mape` and `fold, feature, importance`."""

    metrics: DataFrame
    importance: DataFrame


def _fit_fold(indexed: DataFrame, fold: Fold, spec: FeatureSpec, params: TreeParams):
    """Fit on the fold's training rows, keep the best round on its test rows, score the test rows."""
    role = fold.role(F.col("row"))
    test = indexed.where(role == "test")
    model, _ = fit_best(indexed.where(role == "train"), test, spec.inputs, spec.target, params, spec.categories)
    return model, predict(model, test, spec.inputs)


def _fold_metrics(scored: DataFrame, spec: FeatureSpec) -> tuple[float, float]:
    actual, predicted = F.col(spec.target), F.col(PREDICTION)
    return tuple(scored.agg(rmse(actual, predicted), mape(actual, predicted)).first())


def cross_validate(
    features: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    params: TreeParams = TreeParams(),
    n_splits: int = 5,
    fraction: float = 0.15,
    test_size: int | None = None,
) -> CrossValidation:
    """Walk-forward validation. The driver loops over folds only; each fit is a distributed job."""
    spark = features.sparkSession
    indexed = _indexed(features, spec)
    size = test_size or fraction_rows(indexed.total, fraction)
    metrics, importance = [], []
    try:
        for fold in walk_forward_folds(indexed.total, n_splits, size):
            model, scored = _fit_fold(indexed.df, fold, spec, params)
            metrics.append((fold.fold, *_fold_metrics(scored, spec)))
            weights = model.stages[-1].featureImportances.toArray()
            weights = [*map(float, weights), *[0.0] * (len(spec.inputs) - len(weights))]  # inputs that no tree uses
            importance += [(fold.fold, name, w) for name, w in zip(spec.inputs, weights, strict=True)]
    finally:
        indexed.df.unpersist()
    return CrossValidation(
        spark.createDataFrame(metrics, "fold INT, rmse DOUBLE, mape DOUBLE"),
        spark.createDataFrame(importance, "fold INT, feature STRING, importance DOUBLE"),
    )


def _indexed(features: DataFrame, spec: FeatureSpec) -> OrderedRows:
    rows = training_rows(features, spec).select(*spec.keys, spec.time, spec.target, *spec.inputs)
    indexed = ordered_rows(rows, _order(spec), "row")
    # Written already; what is kept here is the numbering and the columns as trees read them.
    return OrderedRows(indexed.df.persist(StorageLevel.MEMORY_AND_DISK), indexed.total)


def fold_summary(metrics: DataFrame) -> DataFrame:
    """Mean and population deviation of the fold metrics."""
    return metrics.agg(
        *(
            aggregate(metric).alias(f"{name}_{metric}")
            for metric in ("mape", "rmse")
            for name, aggregate in (("mean", F.avg), ("std", F.stddev_pop))
        )
    )


def rank_importance(importance: DataFrame, top: int = 20) -> DataFrame:
    """Features by mean importance over the folds."""
    mean = importance.groupBy("feature").agg(F.avg("importance").alias("mean_importance"))
    return mean.orderBy(F.desc("mean_importance"), "feature").limit(top)


# --- parameter search ---------------------------------------------------------------------


def search(
    features: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    space: SearchSpace = SearchSpace(),
    trials: int = 100,
    n_splits: int = 5,
    test_size: int = 48,
    seed: int = 42,
    parallel: int = 1,
    drop: bool = True,
) -> DataFrame:
    """Trials of seeded random parameters, best first; the objective is the mean fold RMSE.

    A trial whose fit fails scores infinity and the search goes on. Up to `parallel` trials run at a
    time over one persisted matrix. With `drop` a trial ends as soon as its folds so far, the others
    counted as faultless, are worse than the best mean: it cannot win. Then `folds` says how many it had
    and `mean_rmse` is that lower bound; such trials rank after the whole ones. Which trials are dropped
    may depend on what runs side by side, which one is best does not.
    """
    spark = features.sparkSession
    generator = random.Random(seed)
    drawn = [space.draw(generator, seed) for _ in range(trials)]
    indexed = _indexed(features, spec)
    folds = walk_forward_folds(indexed.total, n_splits, test_size)
    race = _Race(drop)

    def run(trial: int) -> tuple:
        mean, done = _objective(indexed.df, folds, spec, drawn[trial], race)
        return trial, mean, done, *asdict(drawn[trial]).values()

    try:
        with ThreadPoolExecutor(parallel) as pool:
            results = list(pool.map(run, range(trials)))
    finally:
        indexed.df.unpersist()
    table = spark.createDataFrame(
        results,
        "trial INT, mean_rmse DOUBLE, folds INT, iterations INT, depth INT, learning_rate DOUBLE, "
        "subsample DOUBLE, bins INT, seed INT, patience INT",
    )
    return table.orderBy(*_ranked())


def _ranked():
    return [F.desc("folds"), "mean_rmse", "trial"]


class _Race:
    """The best mean so far, over trials that run side by side."""

    def __init__(self, drop: bool):
        self.drop, self.best, self.lock = drop, math.inf, Lock()

    def lost(self, bound: float) -> bool:
        return self.drop and bound > self.best

    def ended(self, mean: float) -> None:
        with self.lock:
            self.best = min(self.best, mean)


def _objective(
    indexed: DataFrame, folds: Sequence[Fold], spec: FeatureSpec, params: TreeParams, race: _Race
) -> tuple[float, int]:
    """Mean RMSE and number of folds; a lower bound of the mean where folds are missing."""
    errors: list[float] = []
    for fold in folds:
        bound = sum(errors) / len(folds)
        if race.lost(bound):
            return bound, len(errors)
        try:
            role = fold.role(F.col("row"))
            parts = indexed.where(role == "train"), indexed.where(role == "test")
            errors.append(best_error(*parts, spec, params))
        except Exception:  # any failure of a fit only disqualifies its parameters
            return math.inf, len(errors)
    race.ended(sum(errors) / len(errors))
    return sum(errors) / len(errors), len(errors)


def best_error(train_rows: DataFrame, test_rows: DataFrame, spec: FeatureSpec, params: TreeParams) -> float:
    """RMSE of the best round: the search needs no refit and no prediction."""
    model = fit(train_rows, spec.inputs, spec.target, params, spec.categories)
    errors = _round_errors(model, test_rows, spec.inputs)
    return math.sqrt(errors[best_round(errors, params.patience) - 1])


def best_params(results: DataFrame) -> TreeParams:
    best = results.orderBy(*_ranked()).first().asDict()
    return TreeParams(**{name: best[name] for name in asdict(TreeParams())})


# --- final model --------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainedModel:
    model: PipelineModel
    full_predictions: DataFrame
    holdout: DataFrame


def train(
    features: DataFrame,
    spec: FeatureSpec = FeatureSpec(),
    params: TreeParams = TreeParams(),
    test_size: int = 48,
) -> TrainedModel:
    """Fit on all rows but the last `test_size`, then score every row and the holdout."""
    rows = training_rows(features, spec).select(*spec.keys, spec.time, spec.target, *spec.inputs)
    split = holdout_split(rows, _order(spec), test_size)
    model = fit(split.where("role = 'train'"), spec.inputs, spec.target, params, spec.categories)
    held = predict(model, split.where("role = 'holdout'"), spec.inputs).select(
        *spec.keys, spec.time, F.col(spec.target).alias(f"{spec.target}_actual"), PREDICTION
    )
    return TrainedModel(model, score(model, rows, spec), held)


def holdout_metrics(trained: TrainedModel, results: DataFrame | None = None, spec: FeatureSpec = FeatureSpec()) -> DataFrame:
    """The metrics document: best search error and parameters, holdout RMSE and MAPE."""
    actual, predicted = F.col(f"{spec.target}_actual"), F.col(PREDICTION)
    best_error, params = None, {}
    if results is not None:
        best = results.orderBy(*_ranked()).first()
        best_error, params = best["mean_rmse"], asdict(best_params(results))
    pairs = [F.lit(x) for name, value in params.items() for x in (name, str(value))]
    return trained.holdout.agg(
        F.lit(best_error).cast("double").alias("optuna_best_cv_rmse"),
        rmse(actual, predicted).alias("holdout_rmse_perc"),
        mape(actual, predicted).alias("holdout_mape_perc"),
        F.create_map(*pairs).cast("map<string,string>").alias("best_params"),
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
