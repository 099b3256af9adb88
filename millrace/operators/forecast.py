"""Multi-step forecasts from sliding windows, judged by mean absolute error."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.names import col
from .metrics import forecast_errors
from .moments import matching_points, moments, regression_points


def persistence(windows: DataFrame, targets: Sequence[str], label_width: int = 5) -> DataFrame:
    """Forecast every step as the last known value."""
    last = F.element_at("inputs", -1)
    step = F.struct(*[last.getField(t).cast("double").alias(t) for t in targets])
    return windows.withColumn("predictions", F.array_repeat(step, label_width))


def seasonal_persistence(
    windows: DataFrame, targets: Sequence[str], label_width: int = 5, input_width: int = 6,
    shift: int = 24, period: int = 24,
) -> DataFrame:
    """Forecast every step as the value one period before it.

    That value must lie in the inputs, as it does for hourly rows and a day ahead.
    """
    first = input_width + shift - label_width - period
    if first < 0 or first + label_width > input_width:
        raise ValueError("the inputs do not hold the values one period before the labels")
    steps = [
        F.struct(*[F.get("inputs", F.lit(first + h)).getField(t).cast("double").alias(t) for t in targets])
        for h in range(label_width)
    ]
    return windows.withColumn("predictions", F.array(*steps))


def _input_cells(columns: Sequence[str]) -> Column:
    return F.flatten(F.transform("inputs", lambda row: F.array(*[row.getField(c).cast("double") for c in columns])))


def flat_inputs(windows: DataFrame, columns: Sequence[str], name: str = "features") -> DataFrame:
    """All input steps of all columns as one feature vector."""
    return windows.withColumn(name, array_to_vector(_input_cells(columns)))


def fit_direct(
    windows: DataFrame, columns: Sequence[str], targets: Sequence[str], label_width: int = 5,
    method: str = "linear", split: str = "split", parallelism: int = 4, rounds: int = 10, least_gain: float = 0.01,
) -> dict[tuple[str, int], object]:
    """One regression per target and step ahead, fitted on the training windows without nulls.

    All linear ones come from one scan: means and covariances of inputs and labels say all that least
    squares needs.  Boosted ones (``gbt``) watch the windows of the ``val`` split: they stop after ``rounds`` trees or
    where a further tree gains less than ``least_gain`` of the error there, and keep the trees up to the best.
    Without such windows all trees are kept.
    """
    items = [(t, h) for t in targets for h in range(label_width)]
    names = [_label(*item) for item in items]
    labels = [F.get("labels", F.lit(h)).getField(t).cast("double") for t, h in items]
    cells = F.concat(_input_cells(columns), F.array(*labels))
    complete = F.forall(cells, lambda x: x.isNotNull() & ~F.isnan(x))
    if method == "linear":
        train = windows.filter(col(split) == "train").filter(complete).select(cells.alias("cells"))
        _, mean, covariance = moments(train)
        rows = regression_points(windows.sparkSession, matching_points(mean, covariance), len(mean) - len(items), names)
        make = lambda name: LinearRegression(featuresCol="features", labelCol=name, predictionCol=f"pred_{name}")
    elif method == "gbt":
        seen = windows.filter(col(split).isin("train", "val")).filter(complete)
        rows = flat_inputs(seen, columns).select(
            "features", (col(split) == "val").alias("watched"), *[y.alias(name) for y, name in zip(labels, names)])
        watch = {} if rows.filter("watched").isEmpty() else {"validationIndicatorCol": "watched", "validationTol": least_gain}
        make = lambda name: GBTRegressor(
            featuresCol="features", labelCol=name, predictionCol=f"pred_{name}", maxIter=rounds, seed=42, **watch)
    else:
        raise ValueError(f"unknown method {method}")
    rows = rows.persist()
    try:
        with ThreadPool(parallelism) as pool:
            return dict(zip(items, pool.map(lambda name: make(name).fit(rows), names)))
    finally:
        rows.unpersist()


def _label(target: str, step: int) -> str:
    return f"{target}_{step}".replace(".", "_")


def predict_direct(windows: DataFrame, models: dict, columns: Sequence[str], targets: Sequence[str]) -> DataFrame:
    scored = flat_inputs(windows, columns)
    for model in models.values():
        scored = model.transform(scored)
    steps = max(h for _, h in models) + 1
    predictions = F.array(*[
        F.struct(*[F.col(f"pred_{_label(t, h)}").alias(t) for t in targets]) for h in range(steps)
    ])
    return scored.select(*[col(c) for c in windows.columns], predictions.alias("predictions"))


def as_pipeline(models: dict) -> PipelineModel:
    """All regressions of one candidate as a single model that can be saved."""
    return PipelineModel([models[item] for item in sorted(models)])


def forecast_rows(predicted: DataFrame, targets: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form ``keep, start_idx, target, horizon, y, y_hat``; horizons count from 1."""
    pairs = F.posexplode(F.arrays_zip("labels", "predictions")).alias("_h", "_pair")
    long = predicted.select(*keep, "start_idx", pairs)
    cells = F.array(*[
        F.struct(
            F.lit(t).alias("target"),
            F.col("_pair.labels").getField(t).cast("double").alias("y"),
            F.col("_pair.predictions").getField(t).alias("y_hat"),
        )
        for t in targets
    ])
    return long.select(*keep, "start_idx", (F.col("_h") + 1).alias("horizon"), F.explode(cells).alias("c")).select(
        *keep, "start_idx", "horizon", "c.*"
    )


def compare_candidates(candidates: dict[str, DataFrame], targets: Sequence[str], split: str = "split") -> DataFrame:
    """Errors of every candidate per split: ``candidate, split, n, mae, mse, selected``.

    The candidate with the least validation error is marked.
    """
    table = None
    for name, predicted in candidates.items():
        rows = forecast_rows(predicted, targets, [split])
        errors = forecast_errors(rows, "y", "y_hat", [split]).select(F.lit(name).alias("candidate"), "*")
        table = errors if table is None else table.unionAll(errors)
    best = table.filter(col(split) == "val").agg(F.min_by("candidate", F.struct("mae", "candidate")).alias("c"))
    return table.withColumn("selected", F.col("candidate") == best.scalar())


def best_candidate(comparison: DataFrame) -> str:
    return comparison.filter("selected").select("candidate").first()[0]


def keep_best(
    candidates: dict[str, DataFrame], fitted: dict[str, dict], windows: DataFrame, columns: Sequence[str],
    targets: Sequence[str], path: str, split: str = "split",
) -> tuple[str, DataFrame]:
    """Name of the candidate with the least validation error and its forecasts.

    A fitted winner is saved under ``path`` and forecasts as it was loaded from there; a
    persistence has nothing to save.
    """
    best = best_candidate(compare_candidates(candidates, targets, split))
    if best not in fitted:
        return best, candidates[best]
    as_pipeline(fitted[best]).write().overwrite().save(path)
    stages = PipelineModel.load(path).stages
    return best, predict_direct(windows, dict(zip(sorted(fitted[best]), stages)), columns, targets)
