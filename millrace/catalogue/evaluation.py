"""Evaluation tables of a fixed score on events."""

from pyspark.sql import functions as F

from ..functions.features import logistic
from ..operators import metrics
from ..plans.names import clean_zero
from .registry import query

_S = """s AS (SELECT CAST(event_type = 'error' AS INTEGER) AS y_true,
                     1 / (1 + exp(-((value - 50) / 25::DOUBLE))) AS p1 FROM events),
    d AS (SELECT *, CAST(p1 > 0.5 AS INTEGER) AS y_pred FROM s)"""


def scored(t):
    return t.events.select(
        (F.col("event_type") == "error").cast("int").alias("y_true"),
        logistic((F.col("value") - 50) / 25).alias("p1"),
    )


def _predicted(t):
    return metrics.apply_threshold(scored(t), "p1", 0.5)


def _rounded(df, *names):
    return df.withColumns({n: clean_zero(F.col(n)) for n in names})


def _rates(condition: str = "y_pred = 1") -> str:
    return f"""
        count(*) FILTER (WHERE y_true = 1 AND {condition}) AS tp, count(*) FILTER (WHERE y_true = 0 AND {condition}) AS fp,
        count(*) FILTER (WHERE y_true = 1 AND NOT ({condition})) AS fn,
        count(*) FILTER (WHERE y_true = 0 AND NOT ({condition})) AS tn"""


def _div(a: str, b: str) -> str:
    return f"round(coalesce(({a}) / nullif(CAST({b} AS DOUBLE), 0), 0), 6) + 0.0"


_METRICS = f"""{_div("tp + tn", "tp + fp + fn + tn")} AS accuracy, {_div("tp", "tp + fp")} AS precision,
    {_div("tp", "tp + fn")} AS recall, {_div("2 * tp", "2 * tp + fp + fn")} AS f1"""


@query("confusion_matrix", f"""
    WITH {_S}, g AS (SELECT y_true, y_pred FROM (SELECT unnest([0, 1]) AS y_true), (SELECT unnest([0, 1]) AS y_pred))
    SELECT y_true, y_pred, count(d.p1) AS n FROM g LEFT JOIN d USING (y_true, y_pred) GROUP BY y_true, y_pred""")
def confusion_matrix(t):
    return metrics.confusion_matrix(_predicted(t), "y_true", "y_pred")


@query("binary_metrics", f"WITH {_S}, c AS (SELECT {_rates()} FROM d) SELECT {_METRICS} FROM c")
def binary_metrics(t):
    return _rounded(metrics.binary_metrics(_predicted(t), "y_true", "y_pred"), "accuracy", "precision", "recall", "f1")


@query("classification_report", f"""
    WITH {_S},
    per AS (
        SELECT k AS class,
               {_div("count(*) FILTER (WHERE y_true = k AND y_pred = k)", "count(*) FILTER (WHERE y_pred = k)")} AS precision,
               {_div("count(*) FILTER (WHERE y_true = k AND y_pred = k)", "count(*) FILTER (WHERE y_true = k)")} AS recall,
               {_div("2 * count(*) FILTER (WHERE y_true = k AND y_pred = k)",
                     "count(*) FILTER (WHERE y_true = k) + count(*) FILTER (WHERE y_pred = k)")} AS f1,
               2 * count(*) FILTER (WHERE y_true = k AND y_pred = k) AS hits2,
               count(*) FILTER (WHERE y_true = k) AS support, count(*) FILTER (WHERE y_pred = k) AS predicted
        FROM d CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY k),
    exact AS (SELECT *, hits2 / 2 / nullif(CAST(predicted AS DOUBLE), 0) AS p, hits2 / 2 / nullif(CAST(support AS DOUBLE), 0) AS r,
                     hits2 / nullif(CAST(predicted + support AS DOUBLE), 0) AS f FROM per)
    SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM per
    UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits2) / 2 / CAST(sum(support) AS DOUBLE), 6) + 0.0,
                     CAST(sum(support) AS BIGINT) FROM exact
    UNION ALL SELECT 'macro avg', round(avg(coalesce(p, 0)), 6) + 0.0, round(avg(coalesce(r, 0)), 6) + 0.0,
                     round(avg(coalesce(f, 0)), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM exact
    UNION ALL SELECT 'weighted avg', round(sum(coalesce(p, 0) * support) / sum(support), 6) + 0.0,
                     round(sum(coalesce(r, 0) * support) / sum(support), 6) + 0.0,
                     round(sum(coalesce(f, 0) * support) / sum(support), 6) + 0.0, CAST(sum(support) AS BIGINT) FROM exact""")
def classification_report(t):
    return _rounded(metrics.classification_report(_predicted(t), "y_true", "y_pred"), "precision", "recall", "f1")


@query("threshold_sweep", f"""
    WITH {_S}, th AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold),
    c AS (SELECT threshold, {_rates("p1 > threshold")} FROM d CROSS JOIN th GROUP BY threshold)
    SELECT threshold, tp, fp, fn, tn, {_div("tp", "tp + fn")} AS recall FROM c""")
def threshold_sweep(t):
    return _rounded(metrics.threshold_sweep(scored(t), "y_true", "p1"), "recall")


@query("threshold_apply", f"WITH {_S}, c AS (SELECT {_rates('p1 > 0.6')} FROM d) SELECT {_METRICS} FROM c")
def threshold_apply(t):
    raised = metrics.apply_threshold(scored(t), "p1", 0.6)
    return _rounded(metrics.binary_metrics(raised, "y_true", "y_pred"), "accuracy", "precision", "recall", "f1")
