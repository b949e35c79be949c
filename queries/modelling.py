"""Model training, validation and scoring. The SQL gives everything but the fitted numbers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridcast.plans import nightly, training
from gridcast.schemas import PREDICTION
from gridcast.session import scratch_path
from gridcast.sources.metrics import cv_document
from gridcast.sources.tables import snapshot_once, write_table
from queries.composites import FEATURES, features
from queries.inputs import SPEC, events, feature_inputs, table
from queries.registry import query, r6

MODEL = training.TreeParams(iterations=15, depth=4, bins=32, patience=5)
SPACE = training.SearchSpace(iterations=(8, 15), depth=(3, 5), bins=(32, 64))

# What a fit predicts is its own; which rows it scores, and that it scores them, SQL can tell.
KNOWN = f"known AS (SELECT event_type, datetime, wind_perc FROM ({FEATURES}) WHERE wind_perc IS NOT NULL)"


def scored(df):
    """Predictions replaced by whether there is a finite one."""
    good = F.col(PREDICTION).isNotNull() & (F.abs(PREDICTION) < float("inf"))
    return df.withColumn("scored", good).drop(PREDICTION)


def finite(column: str):
    return (F.col(column) < float("inf")) & (F.col(column) >= 0)


def stored_features(spark, sf_dir):
    """The feature table, written once since training passes over it many times."""
    path = scratch_path(spark, "features")
    write_table(features(spark, sf_dir), path)
    return spark.read.parquet(path)


@query("train_score", f"WITH {KNOWN} SELECT event_type, datetime, true AS scored FROM known")
def train_score(spark, sf_dir):
    return scored(training.train(stored_features(spark, sf_dir), SPEC, MODEL).full_predictions)


@query(
    "holdout_eval",
    f"""WITH {KNOWN} SELECT event_type, datetime, wind_perc AS wind_perc_actual, true AS scored FROM known
        ORDER BY datetime DESC, event_type DESC LIMIT 48""",
)
def holdout_eval(spark, sf_dir):
    return scored(training.train(stored_features(spark, sf_dir), SPEC, MODEL).holdout)


# A tree of no depth predicts the mean of its training rows: its folds and errors SQL can tell to the digit.
MEAN = training.TreeParams(iterations=1, depth=0)


def folds_sql(size: str) -> str:
    """Walk-forward folds of `size` test rows: errors of the training mean per fold."""
    return f"""{KNOWN}, numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, event_type) - 1 AS r, count(*) OVER () AS n FROM known),
      splits AS (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS fold),
      placed AS (SELECT fold, r, wind_perc, datetime, n - (6 - fold) * ({size}) AS start_, ({size}) AS size FROM numbered, splits),
      means AS (SELECT fold, avg(wind_perc) AS mean_, count(*) AS train_rows FROM placed WHERE r < start_ GROUP BY 1),
      errors AS (SELECT p.fold, any_value(train_rows) AS train_rows, count(*) AS test_rows, min(datetime) AS first, max(datetime) AS last,
          sqrt(avg((mean_ - wind_perc) * (mean_ - wind_perc))) AS rmse,
          avg(abs(mean_ - wind_perc) / greatest(abs(wind_perc), 2.220446049250313e-16)) AS mape
        FROM placed p JOIN means m ON p.fold = m.fold WHERE r >= start_ AND r < start_ + size GROUP BY 1)"""


SHARE = folds_sql("CAST(floor(n * 0.15) AS BIGINT)")


@query(
    "cv_metrics",
    f"""WITH {SHARE} SELECT fold, {r6('rmse')} AS mean_model_rmse, true AS finite FROM errors""",
)
def cv_metrics(spark, sf_dir):
    """Fold by fold the error of the training mean, and whether that of a model is finite."""
    rows = stored_features(spark, sf_dir)
    plain = training.cross_validate(rows, SPEC, MEAN).metrics.select("fold", F.col("rmse").alias("mean_model_rmse"))
    both = training.cross_validate(rows, SPEC, MODEL).metrics.join(plain, "fold")
    return both.select("fold", "mean_model_rmse", (finite("rmse") & finite("mape")).alias("finite"))


@query(
    "cv_document",
    f"""WITH {SHARE}, folds AS (SELECT avg(rmse) AS mean_rmse, stddev_pop(rmse) AS std_rmse, list(rmse ORDER BY fold) AS rmse_list FROM errors)
        SELECT {r6('mean_rmse')} AS mean_rmse_perc, {r6('std_rmse')} AS std_rmse_perc, CAST(len(rmse_list) AS INTEGER) AS folds,
          {r6('rmse_list[1]')} AS first_rmse, {r6('rmse_list[5]')} AS last_rmse FROM folds""",
)
def cv_document_of_means(spark, sf_dir):
    document = cv_document(training.cross_validate(stored_features(spark, sf_dir), SPEC, MEAN).metrics)
    rmse = F.col("folds.rmse_perc")
    return document.select(
        "mean_rmse_perc", "std_rmse_perc", F.size(rmse).alias("folds"), F.get(rmse, 0).alias("first_rmse"), F.get(rmse, 4).alias("last_rmse")
    )


@query(
    "search_objective",
    f"""WITH {folds_sql('48')} SELECT CAST(unnest(range(3)) AS INTEGER) AS trial, {r6('mean_rmse')} AS mean_rmse, 5 AS folds
        FROM (SELECT avg(rmse) AS mean_rmse FROM errors)""",
)
def search_objective(spark, sf_dir):
    """Trials that all come to the training mean: the objective of each is its mean error over five folds of 48 rows."""
    space = training.SearchSpace(iterations=(1, 1), depth=(0, 0), subsample=(1.0, 1.0))
    found = training.search(stored_features(spark, sf_dir), SPEC, space, trials=3, parallel=3)
    return found.select("trial", "mean_rmse", "folds")


@query(
    "early_stop",
    """WITH curve AS (SELECT user_id, avg(value) AS error FROM events GROUP BY 1),
        rounds AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, error FROM curve),
        best AS (SELECT *, min(error) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rounds),
        marked AS (SELECT *, max(CASE WHEN before IS NULL OR error < before THEN i END) OVER (ORDER BY i) AS best_i FROM best),
        patience AS (SELECT CAST(unnest([1, 2, 5, 50, 1000000]) AS INTEGER) AS patience),
        stops AS (SELECT patience, coalesce(min(i) FILTER (i - best_i >= patience), 1000000000) AS stop FROM marked, patience GROUP BY 1)
        SELECT s.patience, CAST(max(best_i) + 1 AS INTEGER) AS rounds FROM stops s JOIN marked m ON m.i <= s.stop GROUP BY 1""",
)
def early_stop(spark, sf_dir):
    """Rounds kept of a curve with one error per user, for several patiences."""
    curve = events(spark, sf_dir).groupBy("user_id").agg(F.avg("value").alias("error")).orderBy("user_id")
    errors = [r["error"] for r in curve.select("error").collect()]  # one number per round
    rounds = [(p, training.best_round(errors, p)) for p in (1, 2, 5, 50, 1_000_000)]
    return spark.createDataFrame(rounds, "patience int, rounds int")


@query(
    "mean_importance",
    f"""SELECT l_returnflag || m AS feature, {r6('avg(w)')} AS mean_importance FROM
          (SELECT l_returnflag, month(l_shipdate) AS m, l_linenumber, sum(l_quantity) / 1000 AS w FROM lineitem GROUP BY 1, 2, 3)
        GROUP BY 1 ORDER BY avg(w) DESC, 1 LIMIT 20""",
)
def mean_importance(spark, sf_dir):
    """The ranking over folds, of weights that SQL knows."""
    items = table(spark, sf_dir, "lineitem")
    feature = F.concat("l_returnflag", F.month("l_shipdate").cast("string")).alias("feature")
    weights = items.groupBy(F.col("l_linenumber").alias("fold"), feature).agg((F.sum("l_quantity") / 1000).cast("double").alias("importance"))
    return training.rank_importance(weights)


@query("importance_rank", f"SELECT unnest({list(SPEC.inputs)!r}) AS feature, true AS whole")
def importance_rank(spark, sf_dir):
    result = training.cross_validate(stored_features(spark, sf_dir), SPEC, MODEL)
    ranked = training.rank_importance(result.importance, top=len(SPEC.inputs))
    whole = F.abs(F.sum("mean_importance").over(Window.partitionBy()) - 1.0) < 1e-6  # one row per input
    return ranked.select("feature", whole.alias("whole"))


@query("param_search", "SELECT unnest(range(2))::INTEGER AS trial, true AS finite, true AS within")
def param_search(spark, sf_dir):
    found = training.search(stored_features(spark, sf_dir), SPEC, SPACE, trials=2)
    within = F.col("iterations").between(*SPACE.iterations) & F.col("depth").between(*SPACE.depth)
    return found.select("trial", finite("mean_rmse").alias("finite"), within.alias("within"))


@query(
    "nightly_run",
    f"""WITH f AS ({FEATURES}) SELECT event_type, datetime, true AS scored FROM f
        WHERE datetime >= TIMESTAMP '2024-01-17' AND datetime < TIMESTAMP '2024-01-22'""",
)
def nightly_run(spark, sf_dir):
    as_of = date(2024, 1, 20)
    generation, weather, holidays = feature_inputs(spark, sf_dir)
    stored = stored_features(spark, sf_dir)
    model = training.train(stored.where(F.col("datetime") < F.lit(as_of)), SPEC, MODEL).model
    tables = nightly.Tables.under(scratch_path(spark, "nightly"))
    snapshot_once(stored.where("datetime < timestamp'2024-01-10'"), tables.snapshot)
    return scored(
        nightly.nightly(spark, as_of, tables, generation, weather, weather, holidays, model, SPEC, ["event_id"])
    )
