import numpy as np
import pytest
from conftest import rows_of

from millrace.operators import classify, metrics, sampling
from millrace.sources.files import load_model, save_model


def test_metrics_without_positives(table):
    df = table([(0, 0), (0, 0)], "y int, p int")
    assert rows_of(metrics.binary_metrics(df, "y", "p")) == [(1.0, 0.0, 0.0, 0.0)]
    assert rows_of(metrics.confusion_matrix(df, "y", "p")) == [(0, 0, 2), (0, 1, 0), (1, 0, 0), (1, 1, 0)]


def test_metrics_by_hand(table):
    df = table([(1, 1)] * 3 + [(1, 0)] + [(0, 1)] * 2 + [(0, 0)] * 4, "y int, p int")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert np.allclose([row.accuracy, row.precision, row.recall, row.f1], [0.7, 0.6, 0.75, 2 / 3])
    report = {r["class"]: r for r in metrics.classification_report(df, "y", "p").collect()}
    assert report["1"].support == 4 and abs(report["0"].precision - 0.8) < 1e-12
    assert abs(report["accuracy"].f1 - 0.7) < 1e-12 and report["accuracy"].precision is None
    assert abs(report["macro avg"].precision - 0.7) < 1e-12
    assert abs(report["weighted avg"].recall - 0.7) < 1e-12


def test_threshold_is_strict(table):
    df = table([(1, 0.1), (1, 0.5), (0, 0.5), (0, 0.6), (1, 0.95), (0, 0.0), (1, None)], "y int, p double")
    sweep = {round(r.threshold, 1): (r.tp, r.fp, r.fn, r.tn) for r in metrics.threshold_sweep(df, "y", "p").collect()}
    for t, found in sweep.items():
        known = [(y, p > t) for y, p in [(1, 0.1), (1, 0.5), (0, 0.5), (0, 0.6), (1, 0.95), (0, 0.0)]]
        assert found == tuple(known.count(c) for c in ((1, True), (0, True), (1, False), (0, False)))
    assert len(sweep) == 9
    assert [r.y_pred for r in metrics.apply_threshold(df.limit(2).orderBy("p"), "p", 0.1).collect()] == [0, 1]


def test_forecast_errors(table):
    df = table([("a", 1.0, 2.0), ("a", 1.0, 4.0), ("b", 0.0, 0.0)], "k string, y double, f double")
    assert rows_of(metrics.forecast_errors(df, "y", "f", ["k"])) == [("a", 2, 2.0, 5.0), ("b", 1, 0.0, 0.0)]


@pytest.fixture(scope="module")
def separable(spark):
    rows = [(i, float(i % 20) / 10 + (3.0 if i % 2 else 0.0), float((i * 7) % 11), i % 2) for i in range(40)]
    return spark.createDataFrame(rows, "id bigint, x double, noise double, y int").cache()


def test_model_on_separable_rows(separable, tmp_path):
    model = classify.fit_logistic(separable, ["x", "noise"], "y", C=100.0)
    scored = classify.predict(model, separable)
    assert metrics.binary_metrics(scored, "y", "y_pred").first().recall == 1.0
    assert scored.filter("(p1 > 0.5) <> (y_pred = 1)").count() == 0
    save_model(model, str(tmp_path / "model"))
    again = classify.predict(load_model(str(tmp_path / "model")), separable)
    assert rows_of(again, "id", "p1") == rows_of(scored, "id", "p1")
    with pytest.raises(ValueError):
        classify.predict(None, separable)


def test_small_strength_leaves_fewer_coefficients(separable):
    used = []
    for C in (0.01, 100.0):
        params = classify.model_params(classify.fit_logistic(separable, ["x", "noise"], "y", C=C))
        assert abs(params["regParam"] - 1 / (C * 40)) < 1e-12
        used.append(sum(abs(c) > 1e-9 for c in params["coefficients"]))
    assert used[0] < used[1]


def test_strength_is_chosen_by_mean_recall(separable, table):
    scores = table([(0.1, 0, 0.5), (0.1, 1, 0.7), (1.0, 0, 0.6), (1.0, 1, 0.6), (10.0, 0, 0.1), (10.0, 1, 0.2)],
                   "C double, fold int, recall double")
    assert classify.strength_table(scores).filter("selected").first()["C"] in (0.1, 1.0)
    tie = scores.filter("C >= 1").replace(0.1, 0.6, ["recall"]).replace(0.2, 0.6, ["recall"])
    assert classify.strength_table(tie).filter("selected").first()["C"] == 1.0
    options = {"strengths": (0.01, 10.0), "max_iter": 50,
               "balance": lambda df: sampling.undersample(df, "y", ["id"])}
    assert classify.select_strength(separable, ["x", "noise"], "y", ["id"], k=2, **options) == 10.0


def overlapping(spark, n=900):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        x = rng.normal(size=4) + y * np.array([1.0, -0.5, 0.0, 0.0])
        rows.append((i, *[float(v) for v in x * np.array([1.0, 30.0, 0.1, 1.0]) + np.array([0, 5, 0, 0])], y, i % 3))
    return spark.createDataFrame(rows, "id bigint, a double, b double, c double, d double, y int, fold int").repartition(4)


def test_batched_fits_equal_single_ones(spark):
    """Every fold and strength at once gives the coefficients, and the recalls, of one fit each."""
    from pyspark.sql import functions as F

    from millrace.operators.batched import Problem, fit_many

    names, df = ["a", "b", "c", "d"], overlapping(spark).cache()
    rows = df.select(F.array(*names).alias("features"), F.col("y").cast("double").alias("y"), F.col("fold").alias("part"))
    problems = [Problem(C, f) for C in (0.01, 0.3, 10.0) for f in (0, 2, None)]
    weights = fit_many(rows, 4, problems, tol=1e-13)
    recalls = {(r.C, r.fold): r.recall for r in classify.fold_scores(df, names, "y", strengths=(0.01, 0.3, 10.0)).collect()}
    for p, found in zip(problems, weights):
        train = df if p.part is None else df.filter(f"fold <> {p.part}")
        model = classify.fit_logistic(train, names, "y", C=p.C, tol=1e-12, max_iter=1000)
        params = classify.model_params(model)
        single = np.array([*params["coefficients"], params["intercept"]])
        assert np.allclose(found, single, atol=2e-4 * max(1, np.abs(single).max())), (p, found, single)
        if p.part is not None:
            scored = classify.predict(model, df.filter(f"fold = {p.part}"))
            assert abs(recalls[p.C, p.part] - metrics.binary_metrics(scored, "y", "y_pred").first().recall) < 0.02
    assert (np.abs(weights[0][:4]) < 1e-12).any() and (np.abs(weights[-1][:4]) > 0).all()


def test_scans_do_not_grow_with_folds_and_strengths(spark, monkeypatch):
    from millrace.operators import batched

    df, scans = overlapping(spark).cache(), []
    plain = batched._summed
    monkeypatch.setattr(batched, "_summed", lambda rows, run, shape: scans.append(shape[0]) or plain(rows, run, shape))
    for strengths in ((1.0,), (0.1, 0.3, 1.0, 3.0, 10.0)):
        classify.fold_scores(df, ["a", "b", "c", "d"], "y", strengths=strengths).collect()
    # a scan per Newton step of all regressions, and one for the scores
    assert max(scans) == 15 and len(scans) <= 30
    with pytest.raises(ValueError):
        classify.fold_scores(df.withColumn("a", df.a * float("nan")), ["a"], "y").collect()


def test_choices_and_reports_of_strategies(separable):
    undersampled = sampling.undersample_and_split(separable, "y", ["id"])
    judged = classify.judge_strategies(
        separable, separable, ["x", "noise"], "y", ["id"], undersampled, separable, k=2, strengths=(0.01, 10.0), max_iter=30)
    chosen = {r.strategy: r.C for r in judged.choices.filter("selected").collect()}
    assert set(chosen) == {"undersample", "no_balancing", "smote"} and chosen["no_balancing"] == 10.0
    assert judged.scores.count() == 12
    support = {(r["strategy"], r["class"]): r["support"] for r in judged.reports.collect()}
    assert support["smote", "1"] == 20 and support["undersample_threshold", "0"] == 20


def test_strategies_side_by_side(spark, separable):
    undersampled = sampling.undersample_and_split(separable, "y", ["id"])
    table = classify.compare_strategies(
        separable, separable, ["x", "noise"], "y", ["id"], undersampled, separable, k=2,
        strengths=(1.0,), max_iter=10)
    found = {(r.strategy, r.metric): r.value for r in table.collect()}
    assert len(found) == 40 and found["no_balancing", "recall"] == 1.0
