import datetime as dt
import math
from decimal import Decimal

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from millrace.operators import forecast, ordering, timeseries
from millrace.plans.ranking import row_index


def numbers(spark, n, partitions=4):
    return spark.range(n).select((n - 1 - F.col("id")).alias("k"), (F.col("id") % 3).alias("tie")).repartition(partitions)


@pytest.mark.parametrize("partitions", [1, 7])
def test_row_index_is_the_position(spark, partitions):
    indexed = row_index(numbers(spark, 100, partitions), ["tie", "k"])
    expected = sorted(((99 - i) % 3, i) for i in range(100))
    assert [(r.tie, r.k) for r in indexed.orderBy("row_idx").collect()] == expected
    assert [r[0] for r in indexed.select("row_idx").orderBy("row_idx").collect()] == list(range(100))


def test_row_index_of_empty_table(spark):
    assert row_index(numbers(spark, 0), ["k"]).count() == 0


def executed_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_single_task_over_rows(spark):
    """Only the starts of the partitions, one row each, meet in one task."""
    indexed = row_index(numbers(spark, 100), ["k"])
    for df in (indexed, timeseries.sliding_windows(indexed, ["k"])):
        lines = executed_plan(df).splitlines()
        single = [i for i, line in enumerate(lines) if "SinglePartition" in line]
        assert all("HashAggregate" in lines[i + 1] and "_part" in lines[i + 1] for i in single)


def test_systematic_sample(spark):
    sample = ordering.systematic_sample(numbers(spark, 30), ["k"], 5, 6)
    assert sorted(r.k for r in sample.collect()) == [5, 11, 17, 23, 29]


@pytest.mark.parametrize("n,first,second", [(10, 7, 9), (11, 7, 9), (30, 21, 26), (100, 70, 89)])
def test_chronological_cuts(spark, n, first, second):
    split = ordering.chronological_split(numbers(spark, n), ["k"])
    assert first == int(n * 0.7) and second == int(n * (0.7 + 0.2))
    found = {r.k: r.split for r in split.collect()}
    assert found == {k: "train" if k < first else "val" if k < second else "test" for k in range(n)}


def test_keys_at_positions(spark, monkeypatch):
    from millrace.plans import ranking

    monkeypatch.setattr(ranking, "RANKED_ROWS", 7)
    monkeypatch.setattr(ranking, "CUT_BUCKETS", 3)
    rows = [(i * i * 10**12 + 2**53, i % 3, i) for i in range(50)] + [(5, i // 20, 100 + i) for i in range(60)]
    rows += [(None, 1, 200 + i) for i in range(20)] + [(5, None, 300 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "a bigint, b int, c bigint").repartition(4)
    ordered = [tuple(r) for r in df.orderBy("a", "b", "c").collect()]
    wanted = [0, 1, 19, 20, 25, 33, 60, 89, 90, 100, 139, 140, 1000]
    assert ranking.keys_at(df, ["a", "b", "c"], wanted) == [ordered[p] if p < len(ordered) else None for p in wanted]
    cut = ranking.before_key(df, ["a", "b", "c"], ordered[33])
    assert df.filter(cut).count() == 33


@pytest.mark.parametrize("kind,values", [
    ("double", [float("-inf"), float("inf"), float("nan"), None, 0.0, -1.5, 1e308, 5e-324] + [i / 7 for i in range(60)]),
    ("string", [None, "", "a", "B", "é", "\U0001f600", "\uffff", "zz"] + [f"k{i * 37 % 101}" for i in range(60)]),
    ("decimal(38,2)", [None] + [Decimal(2**53 + i) + Decimal("0.01") for i in range(40)] + [Decimal(-10) ** 30]),
    ("date", [None] + [dt.date(1, 1, 1), dt.date(9999, 12, 31)] + [dt.date(2020, 1, 1) + dt.timedelta(i) for i in range(40)]),
    ("binary", [None, b"", b"\x00", b"\xff\xff"] + [bytes([i, 255 - i]) for i in range(40)]),
    ("boolean", [None, True, False] * 15),
])
def test_keys_of_any_type(spark, monkeypatch, kind, values):
    """Cuts end and are right for infinities, NaN, text, long decimals and keys that many rows share."""
    from millrace.plans import ranking

    monkeypatch.setattr(ranking, "RANKED_ROWS", 5)
    monkeypatch.setattr(ranking, "SAMPLED_ROWS", 5 if kind == "double" else 40)
    rows = [(v, i) for i, v in enumerate(values + values[:4] * 20)]
    df = spark.createDataFrame(rows, f"`the key` {kind}, id int").repartition(3)
    order = ["the key", "id"]
    ordered = [tuple(r) for r in df.orderBy(*[F.col(f"`{c}`") for c in order]).collect()]
    wanted = [7, len(rows) // 2, len(rows) - 1, len(rows)]
    found = ranking.keys_at(df, order, wanted)
    assert [repr(k) for k in found] == [repr(ordered[p]) if p < len(rows) else "None" for p in wanted]
    split = ordering.chronological_split(df, order)
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    n = len(rows)
    assert counts == {"train": math.floor(n * 0.7), "val": math.floor(n * 0.9) - math.floor(n * 0.7), "test": n - math.floor(n * 0.9)}
    # one key of all rows: the cut is that key
    assert ranking.keys_at(df.select(F.lit(None).cast(kind).alias("x")), ["x"], [60]) == [(None,)]


def test_cuts_shuffle_no_rows(spark):
    split = ordering.chronological_split(spark.range(50), ["id"])
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n,sizes", [(11, [3, 2, 2, 2, 2]), (10, [2] * 5), (4, [1, 1, 1, 1])])
def test_fold_sizes(spark, n, sizes):
    folds = ordering.contiguous_folds(numbers(spark, n), ["k"], 5).orderBy("k").collect()
    assert [r.fold for r in folds] == [i for i, size in enumerate(sizes) for _ in range(size)]


@pytest.fixture(scope="module")
def ramp(spark):
    return row_index(spark.range(40).select("id", F.col("id").cast("double").alias("T")), ["id"])


@pytest.mark.parametrize("chunk_rows", [30, 31, 1000])
def test_windows_of_a_ramp(ramp, chunk_rows):
    windows = timeseries.sliding_windows(ramp, ["id", "T"], ["T"], chunk_rows=chunk_rows).orderBy("start_idx").collect()
    assert [w.start_idx for w in windows] == list(range(11))
    assert [[c.T for c in w.inputs] for w in windows] == [[float(s + i) for i in range(6)] for s in range(11)]
    assert [[c.T for c in w.labels] for w in windows] == [[float(s + i) for i in range(25, 30)] for s in range(11)]


def test_windows_do_not_cross_splits(spark):
    df = spark.range(70).select("id", F.when(F.col("id") < 33, "a").otherwise("b").alias("s"))
    windows = timeseries.sliding_windows(row_index(df, ["id"]), ["id"], within=["s"], chunk_rows=40)
    starts = rows_of(windows, "s", "start_idx")
    assert starts == [("a", i) for i in range(4)] + [("b", i) for i in range(33, 41)]


def test_window_layout_and_series(spark, ramp):
    layout = timeseries.window_layout(ramp).first()
    assert (layout.total, layout.input_idx, layout.label_idx) == (30, [0, 1, 2, 3, 4, 5], [25, 26, 27, 28, 29])
    windows = forecast.persistence(timeseries.sliding_windows(ramp, ["T"]), ["T"])
    series = timeseries.window_series(windows.filter("start_idx = 2"), "T", predictions="predictions")
    assert rows_of(series.filter("kind <> 'input'"), "kind", "step", "value") == (
        [("label", 25 + i, 27.0 + i) for i in range(5)] + [("prediction", 25 + i, 7.0) for i in range(5)])
    assert series.filter("kind = 'input'").count() == 6
    assert timeseries.example_windows(windows, 3).count() == 3


def test_forecasts_of_a_ramp(ramp):
    windows = timeseries.sliding_windows(ramp, ["T"]).withColumn("split", F.lit("train"))
    seasonal = forecast.forecast_rows(forecast.seasonal_persistence(windows, ["T"]), ["T"])
    assert {(r.horizon, r.y - r.y_hat) for r in seasonal.collect()} == {(h, 24.0) for h in range(1, 6)}
    last = forecast.forecast_rows(forecast.persistence(windows, ["T"]), ["T"])
    assert {(r.horizon, r.y - r.y_hat) for r in last.collect()} == {(h, 19.0 + h) for h in range(1, 6)}
    with pytest.raises(ValueError):
        forecast.seasonal_persistence(windows, ["T"], period=3)


def test_linear_candidate_wins_on_a_ramp(spark, tmp_path):
    df = spark.range(120).select("id", F.col("id").cast("double").alias("T"))
    split = ordering.split_by_position(row_index(df, ["id"]), 0.4, 0.3)
    windows = timeseries.sliding_windows(split, ["T"], within=["split"]).cache()
    models = forecast.fit_direct(windows, ["T"], ["T"])
    linear = forecast.predict_direct(windows, models, ["T"], ["T"])
    table = forecast.compare_candidates({"last": forecast.persistence(windows, ["T"]), "linear": linear}, ["T"])
    assert forecast.best_candidate(table) == "linear"
    assert table.filter("candidate = 'linear'").agg(F.max("mae")).first()[0] < 1e-6
    from millrace.sources.files import load_model, save_model

    save_model(forecast.as_pipeline(models), str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m")).transform(forecast.flat_inputs(windows, ["T"]))
    first = again.orderBy("start_idx").first()
    assert abs(first["pred_T_0"] - first["labels"][0]["T"]) < 1e-6


def test_boosted_candidate_predicts(ramp):
    windows = timeseries.sliding_windows(ramp, ["T"]).withColumn("split", F.lit("train"))
    models = forecast.fit_direct(windows, ["T"], ["T"], label_width=1, method="gbt")
    first = forecast.predict_direct(windows, models, ["T"], ["T"]).orderBy("start_idx").first()
    assert len(first.predictions) == 1 and abs(first.predictions[0].T - 25.0) < 1.5
    with pytest.raises(ValueError):
        forecast.fit_direct(windows, ["T"], ["T"], method="other")


def test_linear_fits_equal_single_fits(spark):
    """All targets and steps from one matrix, as each regression for itself; incomplete windows take no part."""
    import numpy as np
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(5)
    a = 20 + np.cumsum(rng.normal(size=400))
    b = 1e-3 * rng.normal(size=400) + 1e-4 * a
    rows = [(i, float(x), None if i == 77 else float(y)) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "id bigint, a double, b double")
    windows = timeseries.sliding_windows(row_index(df, ["id"]), ["a", "b"]).withColumn("split", F.lit("train")).cache()
    models = forecast.fit_direct(windows, ["a", "b"], ["a", "b"])
    assert sorted(models) == [(t, h) for t in "ab" for h in range(5)]
    bad = "exists(inputs, x -> x.b IS NULL) OR exists(labels, x -> x.b IS NULL)"
    flat = forecast.flat_inputs(windows.filter(f"NOT ({bad})"), ["a", "b"]).cache()
    assert flat.count() < windows.count()
    for (t, h), model in models.items():
        y = flat.select("features", F.get("labels", F.lit(h)).getField(t).alias("y"))
        single = LinearRegression(labelCol="y").fit(y)
        one, other = (m.transform(y).select(F.col(m.getPredictionCol())).toPandas().to_numpy() for m in (model, single))
        assert np.abs(one - other).max() < 1e-8 * y.toPandas()["y"].std()
    with pytest.raises(ValueError):
        forecast.fit_direct(windows.filter("false"), ["a"], ["a"])


def test_boosting_stops_on_the_validation_split(spark):
    """Labels that inputs say nothing about: further trees do not help on windows that were not seen."""
    import random

    rng = random.Random(11)
    df = spark.createDataFrame([(i, rng.random()) for i in range(600)], "id bigint, v double")
    windows = timeseries.sliding_windows(row_index(df, ["id"]), ["v"]).withColumn(
        "split", F.when(F.col("start_idx") < 350, "train").otherwise("val")).cache()
    watched = forecast.fit_direct(windows, ["v"], ["v"], label_width=1, method="gbt", rounds=8)["v", 0]
    blind = forecast.fit_direct(windows.filter("split = 'train'"), ["v"], ["v"], label_width=1, method="gbt", rounds=8)["v", 0]
    assert watched.getNumTrees < 8 and blind.getNumTrees == 8


GAPS = [
    (1, "2024-03-01 22:15:00", None), (2, "2024-03-01 22:40:00", 4.0), (3, "2024-03-01 22:50:00", None),
    (4, "2024-03-02 01:05:00", 6.0), (5, "2024-03-03 23:59:59", 1.0), (6, "2024-03-04 00:00:00", 9.0),
]


@pytest.fixture
def gaps(table):
    return table(GAPS, "id int, ts string, v double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@pytest.mark.parametrize("how,first,empty", [
    ("mean", 4.0, None), ("sum", 4.0, 0.0), ("max", 4.0, None), ("min", 4.0, None), ("first", 4.0, None), ("last", 4.0, None),
])
def test_hours_with_gaps(gaps, how, first, empty):
    hours = timeseries.resample(gaps, "ts", ["v"], "H", how).orderBy("ts").collect()
    assert len(hours) == 51 and hours[0].ts == dt.datetime(2024, 3, 1, 22)
    assert [h.v for h in hours[:5]] == [first, empty, empty, 6.0, empty]


def test_weeks_end_on_sunday(gaps):
    weeks = timeseries.resample(gaps, "ts", ["v"], "W", "max").orderBy("ts").collect()
    assert [(w.ts, w.v) for w in weeks] == [(dt.datetime(2024, 3, 3), 6.0), (dt.datetime(2024, 3, 10), 9.0)]


def test_resample_by_key_and_bad_arguments(gaps):
    keyed = timeseries.resample(gaps.withColumn("k", F.col("id") % 2), "ts", ["v"], "D", "sum", keys=["k"])
    assert rows_of(keyed.groupBy("k").agg(F.count("*"), F.sum("v"))) == [(0, 4, 19.0), (1, 3, 1.0)]
    with pytest.raises(ValueError):
        timeseries.resample(gaps, "nope", ["v"])
    with pytest.raises(ValueError):
        timeseries.resample(gaps, "ts", ["v"], "H", "median")


def test_cycles_and_wind(table):
    df = table([("2024-01-01 06:00:00", 2.0, 3.0, 90.0)], "`Date Time` string, wv double, `max. wv` double, wd double")
    df = df.withColumn("Date Time", F.col("Date Time").cast("timestamp_ntz"))
    row = timeseries.wind_vectors(timeseries.cyclic_time(df, "Date Time")).first()
    seconds = dt.datetime(2024, 1, 1, 6, tzinfo=dt.timezone.utc).timestamp()
    year = 365.2425 * 86400
    assert set(row.asDict()) == {"Day sin", "Day cos", "Year sin", "Year cos", "Wx", "Wy", "max Wx", "max Wy"}
    for name, value in (("Day sin", 1.0), ("Day cos", 0.0), ("Year sin", math.sin(seconds * 2 * math.pi / year)),
                        ("Wx", 0.0), ("Wy", 2.0), ("max Wy", 3.0)):
        assert abs(row[name] - value) < 1e-9
