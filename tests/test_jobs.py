"""The two jobs end to end on small made tables."""

import datetime as dt

import numpy as np
import pytest

from millrace import jobs


@pytest.fixture(scope="module")
def weather(spark):
    rng = np.random.default_rng(2)
    start, rows = dt.datetime(2024, 1, 1), []
    for i in range(6 * 200):
        ts = (start + dt.timedelta(minutes=10 * i)).strftime("%d.%m.%Y %H:%M:%S")
        wind = -9999.0 if i == 77 else float(rng.uniform(0, 10))
        text = "bad" if i == 11 else f"{10 + 5 * np.sin(i / 23):.2f}C"
        rows.append((ts, text, 1000.0 + float(rng.normal()), None if i == 5 else float(rng.normal()), wind, wind + 1.0,
                     float(rng.uniform(0, 360))))
    rows += rows[:3]
    schema = "`Date Time` string, T string, p double, rh double, wv double, `max. wv` double, wd double"
    return spark.createDataFrame(rows, schema).repartition(5)


def test_weather_becomes_scaled_windows(spark, weather):
    prepared = jobs.prepare_weather(weather).cache()
    rows = prepared.orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(200))
    assert [sum(r.split == s for r in rows) for s in ("train", "val", "test")] == [140, int(200 * (0.7 + 0.2)) - 140, 20 + (
        180 - int(200 * (0.7 + 0.2)))]
    assert set(prepared.columns) == {
        "T", "p", "rh", "row_idx", "split", "Day sin", "Day cos", "Year sin", "Year cos", "Wx", "Wy", "max Wx", "max Wy"}
    train = np.array([[r.rh, r["Wx"], r["Day sin"]] for r in rows if r.split == "train"])
    assert np.allclose(train.mean(axis=0), 0) and np.allclose(train.std(axis=0, ddof=1), 1)
    assert abs(rows[0]["T"] - round(10 + 5 * np.sin(5 / 23), 2)) < 1e-9
    windows = jobs.weather_windows(prepared)
    assert windows.filter("split = 'train'").count() == 140 - 29
    assert windows.filter("split = 'test'").count() == 0
    first = windows.filter("start_idx = 0").first()
    assert len(first.inputs[0]) == 11 and set(first.labels[0].asDict()) == {"T", "p"}


def test_transactions_to_strategy_table(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        y = int(i % 8 == 0)
        rows.append((float(i), float(rng.exponential(50)), float(rng.normal() + 3 * y), y))
    rows += rows[:5] + [(1e3, 1e6, 0.0, 0)]
    raw = spark.createDataFrame(rows, "`时间` double, `交易金额` double, v1 double, `类别` int")
    prepared = jobs.prepare_transactions(raw).cache()
    assert prepared.columns == ["v1", "类别", "row_id", "split", "标准化交易金额"]
    n = prepared.count()
    assert 380 < n <= 400 and prepared.filter("split = 'test'").count() == int(np.ceil(n * 0.3))
    table = jobs.compare_transaction_models(prepared, k=2, strengths=(1.0,), max_iter=10)
    found = {(r.strategy, r.metric): r.value for r in table.collect()}
    assert len(found) == 40
    assert found["smote", "recall"] > 0.7 and found["undersample", "recall"] > 0.7
    assert found["undersample_threshold", "fp"] <= found["undersample", "fp"]
