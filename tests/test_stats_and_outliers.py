import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from millrace.operators import anomaly, outliers, stats
from millrace.plans.quantile import quantiles

AMOUNTS = [(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, 4.0, 4.0, 5.0, 6.0, None, 40.0, -40.0, 13.25])]


@pytest.mark.parametrize("kind,limit,accuracy", [
    ("spread", 1_000_000, 10_000), ("spread", 10, 50), ("hot", 3, 10), ("two", 10, 50)])
def test_quantiles_equal_interpolated_ones(spark, limit, accuracy, kind):
    rng = np.random.default_rng(3)
    values = {
        "spread": rng.normal(size=1000),
        "hot": np.where(rng.random(1000) < 0.4, 1.5, rng.exponential(size=1000)),
        "two": np.where(rng.random(1000) < 0.5, 1.0, 2.0),
    }[kind]
    probs = [0.0, 0.25, 0.975]
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)] + [(None, None)], "x double, `i.d` int")
    row = quantiles(df.repartition(5), ["x", "i.d"], probs, limit, accuracy).first()
    assert np.allclose(row[0], np.quantile(values, probs), rtol=1e-12)
    assert np.allclose(row[1], np.quantile(np.arange(1000), probs), rtol=1e-12)


@pytest.mark.parametrize("limit,accuracy", [(1_000_000, 10_000), (5, 10)])
def test_quantiles_with_infinities(spark, limit, accuracy):
    values = [float("-inf")] * 3 + [float(i) for i in range(200)] + [float("inf")] * 40 + [float("nan")] * 10
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    row = quantiles(df, ["x"], [0.0, 0.005, 0.5, 0.9, 1.0], limit, accuracy).first()[0]
    assert row[:4] == [float("-inf"), float("-inf"), 123.0, float("inf")] and row[4] != row[4]


def test_quantiles_read_a_table_twice(spark, tmp_path):
    """Counts and brackets, then ranks: two scans for all columns, and constants after that."""
    path = str(tmp_path / "t")
    spark.range(50_000).selectExpr("id AS a", "id % 97 AS b", "hash(id) AS c").write.parquet(path)
    df, store = spark.read.parquet(path), spark.sparkContext._jsc.sc().statusStore()
    seen = store.jobsList(None).size()
    row = quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.75])
    jobs = [store.jobsList(None).apply(i) for i in range(store.jobsList(None).size() - seen)]
    stages = {j.stageIds().apply(k) for j in jobs for k in range(j.stageIds().size())}
    read = sum(s.inputRecords() for s in (store.lastStageAttempt(i) for i in stages))
    assert read == 2 * 50_000
    assert row.first()["a"] == [12499.75, 24999.5, 37499.25] and "Scan parquet" not in row._jdf.queryExecution().toString()


def test_quantiles_without_values(table):
    df = table([(None, 1.0), (None, 2.0), (None, 4.0)], "x double, y double")
    for limit in (100, 1):
        row = quantiles(df, ["x", "y"], [0.5], limit, 10).first()
        assert row["x"] is None and row["y"] == [2.0]


def test_moments_of_constant_and_single(table):
    df = table([(5.0, 1.0), (5.0, None)], "c double, one double")
    found = {r["column"]: r for r in stats.moments(df).collect()}
    assert found["c"]["std_pop"] == 0.0 and found["c"]["std_samp"] == 0.0
    assert found["one"]["std_samp"] is None and found["one"]["std_pop"] == 0.0 and found["one"]["n"] == 1


@pytest.mark.parametrize("values,enough", [
    ([1, 1, 2, 3], False), ([1, 2, 3, 4], True), ([1, 2, 3, None], True), ([1, 2, None, None], False),
    ([None, None], False), ([7, 7, 7], False), ([1, 2, 3, 4, 5, None], True), ([1, None, 1], False),
])
def test_four_distinct_counts_null(table, values, enough):
    df = table([(v,) for v in values], "x int")
    assert stats.distinct_guard(df).first()["enough"] is enough


def test_class_counts_skip_null_and_sort(table):
    df = table([("a",), ("a",), ("b",), (None,)], "y string")
    assert [tuple(r) for r in stats.class_counts(df, "y").collect()] == [("b", 1), ("a", 2)]


def test_histogram_closes_last_bin(table):
    df = table([(float(i), 1.0) for i in range(101)] + [(None, 1.0)], "x double, y double")
    found = {(r.bx, r.by): r.n for r in stats.histogram_2d(df, "x", "y").collect()}
    expected, *_ = np.histogram2d(np.arange(101.0), np.ones(101), bins=50)
    assert found == {(i, j): n for (i, j), n in np.ndenumerate(expected) if n}


def test_zscore_report_by_row(table):
    rows = [(i, float(i % 5), float(i % 7)) for i in range(60)] + [(60, 100.0, 3.0), (61, 100.0, 90.0), (62, None, 90.0)]
    report = outliers.zscore_report(table(rows, "id bigint, a double, b double"), "id")
    assert rows_of(report, "original_index", "extreme_tag", "abnormal_count") == [
        (60, ["a"], 1), (61, ["a", "b"], 2), (62, ["b"], 1)]


def test_constant_column_has_no_outlier(table):
    df = table([(i, 3.0) for i in range(10)], "id bigint, c double")
    assert outliers.zscore_report(df, "id").count() == 0
    assert outliers.iqr_report(df, "id").count() == 0


def test_merged_report(table):
    rows = [(i, float(i % 5), 1.0) for i in range(60)] + [(70, 99.0, 1.0), (65, 99.0, 1.0), (80, 99.0, None)]
    report = outliers.zscore_report(table(rows, "id bigint, a double, b double"), "id")
    merged = outliers.merge_report(report, repeat_tags=True)
    assert rows_of(merged, "a", "extreme_tag", "abnormal_count", "original_index", "copies") == [
        (99.0, ["a", "a"], 2, 65, 2)]
    assert outliers.merge_report(report, keep_null_keys=True).count() == 2


def test_iqr_needs_four_values(table):
    df = table([(i, v) for i, v in enumerate([1.0, 1.0, 1.0, 2.0, 50.0, 1.0, 1.0, 1.0, 1.0, 1.0])], "id bigint, x double")
    assert outliers.iqr_report(df, "id").count() == 0
    assert outliers.remove_iqr(df, "x").count() == 10
    more = df.union(df.sparkSession.createDataFrame([(10, 3.0), (11, None)], df.schema))
    # five values with null: fences hold now, and rows without a value go
    known = [1.0] * 8 + [2.0, 50.0, 3.0]
    q1, q3 = np.quantile(known, [0.25, 0.75])
    expected = [v for v in known if q1 - 1.5 * (q3 - q1) <= v <= q3 + 1.5 * (q3 - q1)]
    assert sorted(r.x for r in outliers.remove_iqr(more, "x").collect()) == sorted(expected)


def test_fence_values_are_kept_by_strict_bounds(table):
    values = [0.0, 1.0, 2.0, 3.0, 4.0, 7.0, -3.0]  # q1 0.5, q3 3.5: fences -4 and 8
    df = table([(i, v) for i, v in enumerate(values + [8.0, -4.0])], "id bigint, x double")
    q = np.quantile(values + [8.0, -4.0], [0.25, 0.75])
    low, high = q[0] - 1.5 * (q[1] - q[0]), q[1] + 1.5 * (q[1] - q[0])
    kept = {r.x for r in outliers.remove_iqr(df, "x").collect()}
    assert kept == {v for v in values + [8.0, -4.0] if low <= v <= high}


def test_amount_filter_is_inclusive_and_skips_nulls(table):
    # quartiles of the known values: 2 and 5.5, so the limits are -8.5 and 16
    values = [v for _, v in AMOUNTS if v is not None]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    top = q3 + 3 * (q3 - q1)
    assert top not in values
    df = table(AMOUNTS + [(12, None)], "id bigint, x double")
    kept = {r.id for r in outliers.clean_amounts(df, "x").collect()}
    assert kept == {i for i, v in AMOUNTS if v is None or q1 - 3 * (q3 - q1) < v < top} | {12}
    on_limit = table([(i, float(v)) for i, v in enumerate([0, 1, 2, 3, 4, 4, 4, 4])], "id bigint, x double")
    q1, q3 = np.quantile([0, 1, 2, 3, 4, 4, 4, 4], [0.25, 0.75])
    assert outliers.clean_amounts(on_limit, "x", reach=(4 - q3) / (q3 - q1)).filter("x = 4").count() == 0


def test_remove_zscore_drops_nulls(table):
    df = table([(i, float(i % 5)) for i in range(60)] + [(60, 100.0), (61, None)], "id bigint, x double")
    assert outliers.remove_zscore(df, "x").count() == 60


def test_isolation_forest_finds_planted_points(table):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(292, 2)))]
    rows += [(292 + i, 9.0 + i, -9.0 - i) for i in range(8)]
    df = table(rows + [(999, None, 1.0)], "id bigint, a double, b double")
    found = anomaly.isolation_outliers(df, "id", ["a", "b"], contamination=8 / 300).collect()
    assert {r.id for r in found if r.is_outlier} == set(range(292, 300))
    assert [r.score for r in found if r.id == 999] == [None]
    again = anomaly.isolation_outliers(df.repartition(5), "id", ["a", "b"], contamination=8 / 300)
    assert {(r.id, r.score) for r in again.collect()} == {(r.id, r.score) for r in found}


def test_expected_depth():
    assert anomaly.expected_depth([0, 1, 2]).tolist() == [0.0, 0.0, 1.0]
    assert abs(float(anomaly.expected_depth(256)) - 10.2448) < 1e-3


def test_statistics_need_one_scan(spark):
    df = spark.range(10).select("id", F.rand(1).alias("a"), F.rand(2).alias("b"))
    plan = outliers.zscore_stats(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range") == 1


def test_limits_reach_the_scan(spark, tmp_path):
    """Fences are constants of the plan, so the Parquet reader can skip row groups."""
    path = str(tmp_path / "t")
    spark.range(100).select("id", F.col("id").cast("double").alias("x")).write.parquet(path)
    plan = outliers.remove_iqr(spark.read.parquet(path), "x")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x," in plan and "LessThanOrEqual(x," in plan


def test_density_follows_the_exact_kernel(spark):
    """Close to the sum over all rows, one in area; constant, empty and infinite columns have no curve."""
    rng = np.random.default_rng(7)
    values = np.concatenate([rng.normal(size=700), rng.normal(6, 0.5, size=300)])
    rows = [(float(v), 1.0, None, float("inf") if i else 0.0, 1.0 if i == 3 else None) for i, v in enumerate(values)] + [(None, 1.0, None, 2.0, None)]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d double, e double, one double").repartition(4)
    found = stats.density(df, points=512).orderBy("point").collect()
    assert {r["column"] for r in found} == {"a.b"} and [r["point"] for r in found] == list(range(512))
    h = values.std(ddof=1) * 1000 ** -0.2
    x = np.array([r["x"] for r in found])
    exact = np.exp(-0.5 * ((x[:, None] - values[None, :]) / h) ** 2).sum(axis=1) / (1000 * h * np.sqrt(2 * np.pi))
    got = np.array([r["density"] for r in found])
    assert np.abs(got - exact).max() < 1e-3 * exact.max()
    assert abs(got.sum() * (x[1] - x[0]) - 1) < 1e-3
    assert stats.density(df.limit(0)).collect() == []
