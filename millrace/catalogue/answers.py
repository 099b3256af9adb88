"""Model jobs and round trips whose answers SQL can state.

One-hot features and a very weak penalty make the fitted probability of an event type the
share of ones in it; one lag makes the regression a straight line; and what is written and
read back must be what went in.
"""

from pyspark.sql import functions as F

from ..operators import anomaly, classify, forecast, ordering, sampling, timeseries
from ..plans.names import clean_zero
from ..plans.ranking import row_index
from ..plans.scratch import new_path, written
from ..sources import files
from .models import FEATURES, labelled_events
from .registry import ORACLES, query
from .outliers import outlier_report_zscore
from .timeseries import event_windows

TYPES = ["click", "error", "purchase", "signup", "view"]
_Y = "CAST((event_type IN ('click', 'view')) <> (event_id % 5 = 0) AS INTEGER)"
_WEAK = {"tol": 1e-10, "max_iter": 500}


def _typed(t):
    kinds = {f"is_{k}": (F.col("event_type") == k).cast("double") for k in TYPES}
    likely = F.col("event_type").isin("click", "view")
    return t.events.select("event_id", "event_type", (likely != (F.col("event_id") % 5 == 0)).cast("int").alias("y")).withColumns(kinds)


_ONE_HOT = [f"is_{k}" for k in TYPES]
_SHARES = f"""
    SELECT event_type, round(avg({_Y}), 3) + 0.0 AS p1, count(*) AS n FROM events GROUP BY event_type"""


def _shares(scored):
    return scored.groupBy("event_type").agg(clean_zero(F.avg("p1"), 3).alias("p1"), F.count("*").alias("n"))


@query("logreg_shares", _SHARES)
def logreg_shares(t):
    rows = _typed(t)
    return _shares(classify.predict(classify.fit_logistic(rows, _ONE_HOT, "y", C=1e6, **_WEAK), rows))


@query("model_roundtrip", _SHARES)
def model_roundtrip(t):
    rows, path = _typed(t), new_path(t.spark, "model")
    files.save_model(classify.fit_logistic(rows, _ONE_HOT, "y", C=1e6, **_WEAK), path)
    return _shares(classify.predict(files.load_model(path), rows))


_SWEEP = [0.1, 0.3, 0.5, 0.7, 0.9]


@query("model_threshold_sweep", f"""
    WITH e AS (SELECT *, {_Y} AS y FROM events),
    s AS (SELECT event_type, round(avg(y), 3) AS p1 FROM e GROUP BY event_type),
    r AS (SELECT y, p1, threshold FROM e JOIN s USING (event_type), (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold))
    SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (WHERE p1 > threshold AND y = 1) AS tp,
           count(*) FILTER (WHERE p1 > threshold AND y = 0) AS fp FROM r GROUP BY threshold""")
def model_threshold_sweep(t):
    """The sweep over thresholds of a model that was just fitted."""
    rows = _typed(t)
    model = classify.fit_logistic(rows, _ONE_HOT, "y", C=1e6, **_WEAK)
    return classify.model_sweep(model, rows, "y", _SWEEP).select("threshold", "tp", "fp")


@query("cv_shares", f"""
    WITH e AS (SELECT *, {_Y} AS y, ntile(5) OVER (ORDER BY event_id) - 1 AS fold FROM events),
    f AS (SELECT DISTINCT fold FROM e),
    s AS (SELECT f.fold, event_type, avg(y) AS p1 FROM e JOIN f ON e.fold <> f.fold GROUP BY f.fold, event_type)
    SELECT C, CAST(e.fold AS INTEGER) AS fold,
           round(count(*) FILTER (WHERE y = 1 AND p1 > 0.5) / count(*) FILTER (WHERE y = 1), 6) + 0.0 AS recall
    FROM e JOIN s USING (fold, event_type), (SELECT unnest([10000.0::DOUBLE, 1000000.0::DOUBLE]) AS C)
    GROUP BY C, e.fold""")
def cv_shares(t):
    folds = ordering.contiguous_folds(_typed(t).drop("event_type"), ["event_id"], 5)
    scores = classify.fold_scores(folds, _ONE_HOT, "y", strengths=(1e4, 1e6), **_WEAK)
    return scores.withColumn("recall", clean_zero(F.col("recall")))


@query("cv_choice", f"""
    WITH e AS (SELECT *, {_Y} AS y, ntile(5) OVER (ORDER BY event_id) - 1 AS fold FROM events),
    f AS (SELECT DISTINCT fold FROM e),
    s AS (SELECT f.fold, event_type, avg(y) AS p1 FROM e JOIN f ON e.fold <> f.fold GROUP BY f.fold, event_type),
    o AS (SELECT f.fold, avg(y) AS overall FROM e JOIN f ON e.fold <> f.fold GROUP BY f.fold),
    r AS (
        SELECT C, e.fold,
               count(*) FILTER (WHERE y = 1 AND CASE WHEN C < 1 THEN overall ELSE p1 END > 0.5) / count(*) FILTER (WHERE y = 1) AS recall
        FROM e JOIN s USING (fold, event_type) JOIN o USING (fold),
             (SELECT unnest([0.000000001::DOUBLE, 10000.0::DOUBLE, 1000000.0::DOUBLE]) AS C)
        GROUP BY C, e.fold),
    m AS (SELECT C, avg(recall) AS mean_recall FROM r GROUP BY C)
    SELECT C, round(mean_recall, 6) + 0.0 AS mean_recall,
           C = (SELECT min(C) FROM m WHERE mean_recall > (SELECT max(mean_recall) FROM m) - 1e-9) AS selected FROM m""")
def cv_choice(t):
    """Mean recall per strength and the choice: a penalty that leaves no coefficient, and two that leave all."""
    folds = ordering.contiguous_folds(_typed(t).drop("event_type"), ["event_id"], 5)
    table = classify.strength_table(classify.fold_scores(folds, _ONE_HOT, "y", strengths=(1e-9, 1e4, 1e6), **_WEAK))
    return table.withColumn("mean_recall", clean_zero(F.col("mean_recall")))


@query("forecast_one_lag", """
    WITH idx AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS i FROM events),
    w AS (SELECT i, value AS x, lead(value) OVER (ORDER BY i) AS y FROM idx)
    SELECT round(regr_slope(y, x), 6) + 0.0 AS slope, round(regr_intercept(y, x), 4) + 0.0 AS intercept,
           count(*) AS n FROM w WHERE y IS NOT NULL AND i % 3 <> 0""")
def forecast_one_lag(t):
    indexed = row_index(t.events.select("event_id", "ts", "value"), ["ts", "event_id"])
    windows = timeseries.sliding_windows(indexed, ["value"], input_width=1, label_width=1, shift=1)
    windows = written(windows.withColumn("split", F.when(F.col("start_idx") % 3 == 0, "val").otherwise("train")), "lags")
    model = forecast.fit_direct(windows, ["value"], ["value"], label_width=1)["value", 0]
    line = t.spark.createDataFrame([(float(model.coefficients[0]), float(model.intercept))], "slope double, intercept double")
    n = windows.filter("split = 'train'").agg(F.count("*").alias("n"))
    return line.crossJoin(n).select(  # one row each
        clean_zero(F.col("slope")).alias("slope"), clean_zero(F.col("intercept"), 4).alias("intercept"), "n")


@query("forecast_saved_best", """
    SELECT 'same' AS predictions, count(*) AS n FROM (
        SELECT row_number() OVER (ORDER BY ts, event_id) AS i FROM events) WHERE i <= (SELECT count(*) FROM events) - 29""")
def forecast_saved_best(t):
    """The best of the fitted candidates on the validation split is saved, loaded, and forecasts the same."""
    windows = event_windows(t)
    cut = F.when(F.col("start_idx") % 10 < 7, "train").when(F.col("start_idx") % 10 < 9, "val").otherwise("test")
    windows = written(windows.withColumn("split", cut), "forecast-windows")
    fitted = {m: forecast.fit_direct(windows, ["value"], ["value"], label_width=1, method=m) for m in ("linear", "gbt")}
    windows = written(windows.withColumn("labels", F.slice("labels", 1, 1)), "forecast-windows")
    scored = {m: forecast.predict_direct(windows, models, ["value"], ["value"]) for m, models in fitted.items()}
    best, predicted = forecast.keep_best(scored, fitted, windows, ["value"], ["value"], new_path(t.spark, "best"))
    before = scored[best].select("start_idx", F.col("predictions").alias("a"))
    both = before.join(predicted.select("start_idx", F.col("predictions").alias("b")), "start_idx")
    return both.groupBy(F.when(F.col("a") == F.col("b"), "same").otherwise("other").alias("predictions")).agg(
        F.count("*").alias("n"))


@query("isolation_forest_shape", """
    SELECT count(*) AS n, count(*) AS scored, CAST(0 AS BIGINT) AS outside, true AS few_flagged, true AS order_free
    FROM events""")
def isolation_forest_shape(t):
    rows = t.events.select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    one = anomaly.isolation_outliers(rows, "event_id", ["value", "k"])
    two = anomaly.isolation_outliers(rows.orderBy(F.desc("value")).repartition(5), "event_id", ["value", "k"])
    both = one.select("event_id", "score", "is_outlier").join(
        two.select("event_id", F.col("score").alias("again")), "event_id")
    return both.agg(
        F.count("*").alias("n"), F.count("score").alias("scored"),
        F.count_if((F.col("score") <= 0) | (F.col("score") >= 1)).alias("outside"),
        (F.count_if("is_outlier") <= F.count("*") * 0.025).alias("few_flagged"),
        F.bool_and(F.col("score") == F.col("again")).alias("order_free"))


_SPLIT = """e AS (SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS y FROM events),
    s AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id)
                    <= ceil((SELECT count(*) FROM e) * 0.3::DOUBLE) AS test FROM e)"""


@query("strategy_counts", f"""
    WITH {_SPLIT}
    SELECT strategy, count(*) FILTER (WHERE y = 1) AS positives, count(*) FILTER (WHERE y = 0) AS negatives
    FROM s, (SELECT unnest(['undersample', 'no_balancing', 'undersample_threshold', 'smote']) AS strategy)
    WHERE test GROUP BY strategy""")
def strategy_counts(t):
    """Every strategy is judged on all rows of the one test table."""
    data = written(sampling.random_split(labelled_events(t), ["event_id"]), "split")
    train, test = data.filter("split = 'train'").drop("split"), data.filter("split = 'test'").drop("split")
    under = written(sampling.undersample_and_split(train, "y", ["event_id"]), "undersampled")
    grown = written(sampling.smote(train.select("event_id", "y", F.array(*FEATURES).alias("v")), "v", "y", "event_id"), "grown")
    over = grown.select("copy", F.col("key").alias("event_id"), F.col("label").alias("y"),
                        *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)])
    table = classify.compare_strategies(
        train.withColumn("copy", F.lit(0)), test, FEATURES, "y", ["copy", "event_id"], under.withColumn("copy", F.lit(0)), over,
        strengths=(1.0,), tol=1e-3, max_iter=20)
    counts = table.filter("strategy <> 'undersample_balanced_test'").groupBy("strategy").pivot(
        "metric", ["tp", "fp", "fn", "tn"]).agg(F.first("value"))
    return counts.select(
        "strategy", (F.col("tp") + F.col("fn")).cast("bigint").alias("positives"),
        (F.col("fp") + F.col("tn")).cast("bigint").alias("negatives"))


@query("csv_written", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def csv_written(t):
    path = new_path(t.spark, "orders-csv")
    files.write_csv(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return files.read_csv(t.spark, path, t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").schema)


@query("report_roundtrip", ORACLES["outlier_report_zscore"])
def report_roundtrip(t):
    path = new_path(t.spark, "report")
    files.write_report(outlier_report_zscore(t), path)
    return t.spark.read.parquet(path)


@query("window_layout", """
    SELECT 30 AS total, unnest(range(0, 6)) AS position, 'input' AS kind, (SELECT count(*) FROM events) - 29 AS windows
    UNION ALL SELECT 30, unnest(range(25, 30)), 'label', (SELECT count(*) FROM events) - 29""")
def window_layout(t):
    """Positions of inputs and labels in a window, next to the number of windows of the events."""
    events = t.events.agg((F.count("*") - 29).alias("windows"))
    layout = timeseries.window_layout(t.events)
    parts = [layout.select("total", F.explode(F.col(c).cast("array<bigint>")).alias("position"), F.lit(kind).alias("kind"))
             for c, kind in (("input_idx", "input"), ("label_idx", "label"))]
    return parts[0].unionAll(parts[1]).withColumn("windows", events.scalar())


@query("example_batch", """
    WITH idx AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) - 1 AS start_idx FROM events)
    SELECT start_idx, round(value, 6) + 0.0 AS first_value FROM idx WHERE start_idx < 32""")
def example_batch(t):
    batch = timeseries.example_windows(event_windows(t), 32)
    return batch.select("start_idx", clean_zero(F.get("inputs", F.lit(0)).getField("value")).alias("first_value"))


@query("shuffle_order", """
    SELECT event_id, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS place FROM events""")
def shuffle_order(t):
    keyed = sampling.shuffle_key(t.events.select("event_id"), ["event_id"])
    return row_index(keyed, ["shuffle_key", "event_id"]).select("event_id", (F.col("row_idx") + 1).alias("place"))
