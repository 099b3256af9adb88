"""L1 logistic regression, choice of its strength, comparison of strategies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from ..plans.names import col
from ..plans.scratch import written
from ..session import ship_package
from .batched import Problem, fit_many, hits
from .metrics import THRESHOLDS, binary_metrics, classification_report, confusion_counts, threshold_sweep
from .ordering import contiguous_folds

# Fixed values.
STRENGTHS = (0.01, 0.1, 1.0, 10.0, 100.0)
MAX_ITER = 5000
TOLERANCE = 1e-4
CHOSEN_THRESHOLD = 0.6


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


def _estimator(label: str, C: float, n: int, tol: float, max_iter: int) -> LogisticRegression:
    """Loss summed and weighted by ``C`` is loss averaged with strength ``1 / (C n)``.

    Features are taken as they are; the intercept is free of the penalty.
    """
    return LogisticRegression(
        featuresCol="features", labelCol=label, elasticNetParam=1.0, regParam=1.0 / (C * n),
        standardization=False, maxIter=max_iter, tol=tol,
    )


def fit_logistic(
    df: DataFrame, features: Sequence[str], label: str, C: float = 1.0,
    tol: float = TOLERANCE, max_iter: int = MAX_ITER,
) -> PipelineModel:
    """Fit on the whole table; the model carries the feature assembly."""
    data = df.select(*[col(c) for c in features], col(label).cast("double").alias(label))
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    model = _estimator(label, C, data.count(), tol, max_iter).fit(assembler.transform(data))
    return PipelineModel([assembler, model])


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``y_pred`` (0 or 1) and ``p1``, the probability of class 1."""
    if model is None:
        raise ValueError("fit a model first")
    scored = model.transform(df)
    return scored.withColumns({
        "y_pred": F.col("prediction").cast("int"),
        "p1": F.get(vector_to_array("probability"), F.lit(1)),
    }).drop("features", "rawPrediction", "probability", "prediction")


def model_params(model: PipelineModel) -> dict:
    """Settings, coefficients and intercept of a fitted model."""
    fitted = model.stages[-1]
    params = {p.name: fitted.getOrDefault(p) for p in fitted.params if fitted.hasDefault(p) or fitted.isSet(p)}
    return {**params, "coefficients": fitted.coefficients.toArray().tolist(), "intercept": fitted.intercept}


def fold_scores(
    df: DataFrame, features: Sequence[str], label: str, fold: str = "fold", strengths: Sequence[float] = STRENGTHS,
    balance: Callable[[DataFrame], DataFrame] | None = None, tol: float = TOLERANCE, max_iter: int = MAX_ITER,
) -> DataFrame:
    """Recall of every strength on every fold: ``C, fold, recall``.

    All folds and strengths are fitted together (``batched``), a scan of the rows per Newton step of all of
    them, and scored in one more.  ``balance`` is applied to the training folds only, so that no drawn
    or made-up row reaches the fold it is judged on.
    """
    spark = ship_package(df.sparkSession)

    def ready(rows: DataFrame, part) -> DataFrame:
        return rows.select(
            F.array(*[col(c).cast("double") for c in features]).alias("features"), col(label).cast("double").alias("y"),
            part.cast("int").alias("part"))

    rows = written(ready(df, col(fold)), "cv-rows").persist()
    try:
        folds = sorted(r["part"] for r in rows.select("part").distinct().collect())  # k numbers
        problems = [Problem(float(C), f) for f in folds for C in strengths]
        if balance is None:
            weights = fit_many(rows, len(features), problems, tol=tol * tol, max_iter=max_iter)
        else:
            drawn = [ready(balance(df.filter(col(fold) != f)), F.lit(f)) for f in folds]
            train = written(reduce(DataFrame.unionAll, drawn), "cv-balanced").persist()
            try:
                weights = fit_many(train, len(features), problems, own=True, tol=tol * tol, max_iter=max_iter)
            finally:
                train.unpersist()
        found = hits(rows, weights, problems)
    finally:
        rows.unpersist()
    scores = [(p.C, p.part, float(tp / (tp + fn)) if tp + fn else 0.0) for p, (tp, fn) in zip(problems, found)]
    return spark.createDataFrame(scores, "C double, fold int, recall double")


def strength_table(scores: DataFrame) -> DataFrame:
    """Mean recall per strength; ``selected`` marks the best, the smallest strength on ties."""
    means = scores.groupBy("C").agg(F.avg("recall").alias("mean_recall"))
    best = means.agg(F.max(F.struct("mean_recall", -F.col("C"))).alias("b")).select("b.*").toDF("r", "c")
    marker = best.select((-F.col("c")).alias("C")).scalar()
    return means.withColumn("selected", F.col("C") == marker)


def select_strength(
    df: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str], k: int = 5, **options
) -> float:
    """Best strength by mean recall over ``k`` contiguous folds."""
    folded = contiguous_folds(df, order_by, k)
    table = strength_table(fold_scores(folded, features, label, **options))
    return table.filter("selected").first()["C"]


def model_sweep(model: PipelineModel, df: DataFrame, label: str, thresholds: Sequence[float] = THRESHOLDS) -> DataFrame:
    """Counts and rates of a fitted model at every threshold on the probability of class 1."""
    return threshold_sweep(predict(model, df), label, "p1", thresholds)


def long_metrics(scored: DataFrame, strategy: str, y_true: str, y_pred: str = "y_pred") -> DataFrame:
    """``strategy, metric, value`` of one set of predictions, confusion counts included."""
    names = ["accuracy", "precision", "recall", "f1"]
    rates = binary_metrics(scored, y_true, y_pred)
    counts = scored.agg(*[c.cast("double").alias(n) for n, c in confusion_counts(y_true, y_pred).items()])

    def rows(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
        return frame.unpivot([], [col(c) for c in columns], "metric", "value")

    both = rows(rates, names).unionAll(rows(counts, ["tp", "fp", "fn", "tn"]))
    return both.select(F.lit(strategy).alias("strategy"), "metric", "value")


@dataclass(frozen=True)
class Strategies:
    """Strategies judged side by side.

    ``metrics``: ``strategy, metric, value``; ``scores``: ``strategy, C, fold, recall`` of the search; ``choices``:
    ``strategy, C, mean_recall, selected``; ``reports``: the report per class of every strategy.
    """

    metrics: DataFrame
    scores: DataFrame
    choices: DataFrame
    reports: DataFrame


def judge_strategies(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, order_by: Sequence[str],
    undersampled: DataFrame, oversampled: DataFrame, threshold: float = CHOSEN_THRESHOLD, k: int = 5,
    tol: float = TOLERANCE, max_iter: int = MAX_ITER, **options
) -> Strategies:
    """Judge undersampling, plain training, a raised threshold and oversampling on one test table.

    ``undersampled`` has a ``split`` column; its test part is judged as well.
    """
    searched: dict[str, DataFrame] = {}

    def tuned(strategy: str, rows: DataFrame) -> PipelineModel:
        scores = fold_scores(contiguous_folds(rows, order_by, k), features, label, tol=tol, max_iter=max_iter, **options)
        searched[strategy] = scores
        C = strength_table(scores).filter("selected").first()["C"]
        return fit_logistic(rows, features, label, C, tol, max_iter)

    under = tuned("undersample", undersampled.filter("split = 'train'"))
    plain = tuned("no_balancing", train)
    over = tuned("smote", oversampled)

    on_test = predict(under, test)
    judged = {
        "undersample_balanced_test": predict(under, undersampled.filter("split = 'test'")),
        "undersample": on_test,
        "no_balancing": predict(plain, test),
        "undersample_threshold": on_test.withColumn("y_pred", (F.col("p1") > threshold).cast("int")),
        "smote": predict(over, test),
    }

    def together(parts: dict[str, DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, [
            rows.select(F.lit(name).alias("strategy"), *[col(c) for c in rows.columns if c != "strategy"])
            for name, rows in parts.items()])

    return Strategies(
        together({name: long_metrics(rows, name, label) for name, rows in judged.items()}),
        together(searched),
        together({name: strength_table(scores) for name, scores in searched.items()}),
        together({name: classification_report(rows, label, "y_pred") for name, rows in judged.items()}))


def compare_strategies(*args, **options) -> DataFrame:
    """The ``metrics`` of ``judge_strategies``."""
    return judge_strategies(*args, **options).metrics
