"""Model jobs: results depend on a solver, so only their rows are checked."""

from pyspark.sql import functions as F

from ..functions.features import DAY_SECONDS, cycle, epoch_seconds
from ..operators import classify, forecast, ordering, sampling
from ..plans.scratch import written
from .registry import query
from .timeseries import TARGETS, hourly_windows

FEATURES = ["value", "k", "day_sin", "day_cos"]


def labelled_events(t):
    """Numeric features of an event and whether it is an error."""
    day_sin, day_cos = cycle(epoch_seconds(F.col("ts")), DAY_SECONDS)
    return t.events.select(
        "event_id", F.col("value"), F.get_json_object("props", "$.k").cast("double").alias("k"),
        day_sin.alias("day_sin"), day_cos.alias("day_cos"), (F.col("event_type") == "error").cast("int").alias("y"),
    )


def _balanced(t):
    return sampling.undersample_and_split(labelled_events(t), "y", ["event_id"])


@query("logreg_fit_predict")
def logreg_fit_predict(t):
    balanced = written(_balanced(t), "balanced")
    model = classify.fit_logistic(balanced.filter("split = 'train'"), FEATURES, "y", C=0.01)
    return classify.predict(model, balanced.filter("split = 'test'")).select("event_id", "y", "y_pred", "p1")


@query("cv_select")
def cv_select(t):
    train = written(_balanced(t).filter("split = 'train'"), "balanced")
    folds = written(ordering.contiguous_folds(train, ["event_id"], 5), "folds")
    return classify.strength_table(classify.fold_scores(folds, FEATURES, "y"))


@query("strategy_compare")
def strategy_compare(t):
    data = written(sampling.random_split(labelled_events(t), ["event_id"]), "split")
    train, test = data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")
    undersampled = written(sampling.undersample_and_split(train, "y", ["event_id"]), "undersampled")
    points = train.select("event_id", "y", F.array(*FEATURES).alias("v"))
    grown = written(sampling.smote(points, "v", "y", "event_id"), "oversampled")
    # made-up rows come last, as they do when they are appended
    oversampled = grown.select(
        "copy", F.col("key").alias("event_id"), F.col("label").alias("y"),
        *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)])
    return classify.compare_strategies(
        train.withColumn("copy", F.lit(0)), test, FEATURES, "y", ["copy", "event_id"],
        undersampled.withColumn("copy", F.lit(0)), oversampled)


@query("forecast_linear")
def forecast_linear(t):
    windows = written(hourly_windows(t), "windows")
    models = forecast.fit_direct(windows, TARGETS, TARGETS)
    return forecast.compare_candidates({
        "persistence": forecast.persistence(windows, TARGETS),
        "seasonal": forecast.seasonal_persistence(windows, TARGETS),
        "linear": forecast.predict_direct(windows, models, TARGETS, TARGETS),
    }, TARGETS)
