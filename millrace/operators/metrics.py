"""Evaluation tables from predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.names import col

THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)  # fixed values


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_counts(y_true: str, y_pred: str, positive=1) -> dict[str, Column]:
    """Aggregates tp, fp, fn and tn; rows without label or prediction count nowhere."""
    t, p = col(y_true) == F.lit(positive), col(y_pred) == F.lit(positive)
    return {
        "tp": F.count_if(t & p), "fp": F.count_if(~t & p), "fn": F.count_if(t & ~p), "tn": F.count_if(~t & ~p),
    }


def confusion_matrix(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """The full 2x2 grid ``y_true, y_pred, n``, empty cells included."""
    counts = df.agg(*[c.alias(n) for n, c in confusion_counts(y_true, y_pred).items()])
    cells = [
        F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(n).alias("n"))
        for n, t, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
    ]
    return counts.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
    }


_COUNTS = ("tp", "fp", "fn", "tn")


def binary_metrics(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class."""
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in confusion_counts(y_true, y_pred).items()])
    found = rates(*[F.col(n) for n in _COUNTS])
    return counts.select(*keys, *[c.alias(n) for n, c in found.items()])


def classification_report(df: DataFrame, y_true: str, y_pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted rows."""
    pairs = (
        df.filter(col(y_true).isNotNull() & col(y_pred).isNotNull())
        .groupBy(col(y_true).cast("string").alias("t"), col(y_pred).cast("string").alias("p"))
        .agg(F.count("*").alias("n"))
    )
    # every pair counts for its true class and for its predicted one
    sides = F.array(
        F.struct(F.col("t").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("cls"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hit")),
    )
    per_class = (
        pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("cls")
        .agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
        .withColumn("precision", ratio(F.col("hit"), F.col("predicted")))
        .withColumn("recall", ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", ratio(2 * F.col("hit"), F.col("predicted") + F.col("support")))
    )
    total = F.sum("support")

    def weighted(name: str) -> Column:
        return ratio(F.sum(F.col(name) * F.col("support")), total)

    accuracy = ratio(F.sum("hit"), total)
    averages = per_class.agg(
        accuracy.alias("acc"), total.alias("total"),
        *[F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")],
        *[weighted(m).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")],
    )

    def row(name: str, p: Column, r: Column, f: Column) -> Column:
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        F.col("total").alias("support"))

    empty = F.lit(None).cast("double")
    summary = averages.select(F.explode(F.array(
        row("accuracy", empty, empty, F.col("acc")),
        *[row(f"{kind} avg", *[F.col(f"{kind}_{m}") for m in ("precision", "recall", "f1")])
          for kind in ("macro", "weighted")],
    )).alias("r")).select("r.*")
    return per_class.select(F.col("cls").alias("class"), "precision", "recall", "f1", "support").unionAll(summary)


def threshold_sweep(
    df: DataFrame, y_true: str, score: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Confusion counts and recall of ``score > t`` for every threshold.

    Each row is only placed between two thresholds; the counts of all thresholds are
    sums over these few classes, so rows are not repeated.
    """
    cuts = sorted(thresholds)
    passed = F.when(col(score).isNotNull(), F.lit(0))
    passed = passed + sum(((col(score) > F.lit(t)).cast("int") for t in cuts), F.lit(0))
    classes = (
        df.filter(col(y_true).isNotNull() & col(score).isNotNull())
        .groupBy((col(y_true) == 1).alias("t"), passed.alias("passed")).agg(F.count("*").alias("n"))
    )
    levels = F.array(*[
        F.struct(F.lit(t).cast("double").alias("threshold"), (F.col("passed") > i).alias("p"))
        for i, t in enumerate(cuts)
    ])
    spread = classes.select("t", "n", F.explode(levels).alias("l")).select("t", "n", "l.*")

    def count(t: bool, p: bool) -> Column:
        hit = (F.col("t") == F.lit(t)) & (F.col("p") == F.lit(p))
        return F.sum(F.when(hit, F.col("n")).otherwise(0))

    counts = spread.groupBy("threshold").agg(
        count(True, True).alias("tp"), count(False, True).alias("fp"),
        count(True, False).alias("fn"), count(False, False).alias("tn"),
    )
    return counts.withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def apply_threshold(df: DataFrame, score: str, threshold: float, name: str = "y_pred") -> DataFrame:
    """Predict 1 where the score is above the threshold."""
    return df.withColumn(name, (col(score) > F.lit(threshold)).cast("int"))


def forecast_errors(df: DataFrame, y_true: str, y_pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute and squared error, over everything or per key."""
    gap = col(y_true) - col(y_pred)
    return df.groupBy(*keys).agg(
        F.count(gap).alias("n"), F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse")
    )
