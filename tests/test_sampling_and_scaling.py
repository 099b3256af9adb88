import math

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from millrace.operators import neighbours, sampling, scaling
from millrace.operators.neighbours import nearest_neighbours
from millrace.plans.hashed import flag_lowest


def keyed(spark, n, partitions=4):
    return spark.range(n).select("id", (F.col("id") % 10 == 0).cast("int").alias("y")).repartition(partitions)


@pytest.mark.parametrize("n", [1, 7, 10, 101])
def test_split_has_exact_size_and_does_not_depend_on_partitions(spark, n):
    one, many = (sampling.random_split(keyed(spark, n, p), ["id"]) for p in (1, 7))
    assert rows_of(one, "id", "split") == rows_of(many, "id", "split")
    assert one.filter("split = 'test'").count() == math.ceil(n * 0.3)


@pytest.mark.parametrize("quota,expected", [(0, 0), (5, 5), (99, 20)])
def test_quota_is_kept_at_the_ends(spark, quota, expected):
    assert flag_lowest(spark.range(20), ["id"], 1, lambda n, _: F.lit(quota), "f").filter("f").count() == expected


def test_hash_split_is_near_its_share(spark):
    n = sampling.random_split_by_hash(spark.range(5000), ["id"]).filter("split = 'test'").count()
    assert abs(n / 5000 - 0.3) < 0.03


def test_undersampled_classes_are_equal(spark):
    balanced = sampling.undersample_and_split(keyed(spark, 200), "y", ["id"])
    assert rows_of(balanced.groupBy("y").count()) == [(0, 20), (1, 20)]
    assert balanced.select("id").distinct().count() == 40
    assert balanced.filter("split = 'test'").count() == 12


@pytest.mark.parametrize("block_rows", [16, 4096])
def test_neighbours_equal_brute_force(spark, block_rows):
    """Two groups, one with a third of its points in one place."""
    rng = np.random.default_rng(0)
    n = 240
    v = rng.normal(size=(n, 3))
    v[:70], v[100:110] = v[0], v[100]
    group, ids = (np.arange(n) >= 200).astype(int), rng.permutation(n)
    rows = [(int(ids[i]), int(group[i]), [float(x) for x in v[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, g int, v array<double>").repartition(3)
    found = nearest_neighbours(df, "id", "v", 4, group="g", block_rows=block_rows)
    expected = []
    for i in range(n):
        near = sorted((round(float(np.linalg.norm(v[i] - v[j])), 9), int(ids[j]))
                      for j in range(n) if j != i and group[j] == group[i])
        expected += [(int(group[i]), int(ids[i]), r + 1, k) for r, (_, k) in enumerate(near[:4])]
    assert rows_of(found, "g", "key", "rank", "neighbour") == sorted(expected, key=repr)


def test_small_blocks_do_not_multiply_the_routes(spark, monkeypatch):
    """Vectors that no cell separates go to each tile once, not to each block."""
    rng = np.random.default_rng(1)
    n, k, tile = 300, 3, 100
    v = rng.normal(size=(n, 24))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "id bigint, v array<double>").repartition(3)
    routed = []

    def counted(*args):
        routed.append(route(*args))
        return routed[-1]

    route = neighbours._route
    monkeypatch.setattr(neighbours, "_route", counted)
    monkeypatch.setattr(neighbours, "TILE_ROWS", tile, raising=False)
    found = nearest_neighbours(df, "id", "v", k, block_rows=8)
    gaps = np.linalg.norm(v[:, None] - v[None], axis=2)
    expected = [(i, r + 1, int(j)) for i in range(n) for r, j in enumerate([j for j in np.argsort(gaps[i]) if j != i][:k])]
    assert rows_of(found, "key", "rank", "neighbour") == sorted(expected, key=repr)
    # greedy filling leaves tiles at least half full, but for the last
    assert routed[0].count() <= n * (2 * n / tile + 1)


def test_probes_meet_the_own_block_and_the_nearest_cells_only(spark, monkeypatch):
    rng = np.random.default_rng(2)
    n, k = 200, 3
    v = rng.normal(size=(n, 12))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "id bigint, v array<double>").repartition(3)
    seen = {}

    def kept(points, pivots, block_rows):
        seen["placed"], seen["pivots"] = place(points, pivots, block_rows), pivots
        return seen["placed"]

    place = neighbours._place
    monkeypatch.setattr(neighbours, "_place", kept)
    found = nearest_neighbours(df, "id", "v", k, block_rows=10, probes=2)
    rows = seen["placed"].withColumn("sub", neighbours._sub("key", F.col("subs"))).collect()
    block, cell = {r.key: (r.cell, r["sub"]) for r in rows}, {r.key: r.cell for r in rows}
    centres, used = dict(seen["pivots"])[0], sorted(set(cell.values()))
    expected = []
    for i in range(n):
        probed = sorted(used, key=lambda c: np.linalg.norm(v[i] - centres[c]))[:2]
        met = [j for j in range(n) if j != i and (block[j] == block[i] or cell[j] in probed)]
        expected += [(i, r + 1, j) for r, j in enumerate(sorted(met, key=lambda j: np.linalg.norm(v[i] - v[j]))[:k])]
    assert rows_of(found, "key", "rank", "neighbour") == sorted(expected, key=repr)


def test_other_tiles_return_only_what_is_closer_than_the_own_block(spark, monkeypatch):
    """A tile that a query merely comes near does not send back its best k members."""
    rng = np.random.default_rng(3)
    n, k = 600, 4
    v = rng.normal(size=(n, 2)) * [300.0, 30.0] + [500.0, 0.0]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(n)], "id bigint, v array<double>").repartition(3)
    others = []

    def counted(*args):
        others.append(search(*args))
        return others[-1]

    search = neighbours._search_others
    monkeypatch.setattr(neighbours, "_search_others", counted)
    monkeypatch.setattr(neighbours, "TILE_ROWS", 30)
    found = nearest_neighbours(df, "id", "v", k, block_rows=30)
    gaps = np.linalg.norm(v[:, None] - v[None], axis=2)
    expected = [(i, r + 1, int(j)) for i in range(n) for r, j in enumerate([j for j in np.argsort(gaps[i]) if j != i][:k])]
    assert rows_of(found, "key", "rank", "neighbour") == sorted(expected, key=repr)
    assert 0 < others[0].count() <= 2 * n * k


def test_neighbours_of_a_tiny_group(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id bigint, v array<double>")
    found = nearest_neighbours(df, "id", "v", 5)
    assert rows_of(found, "key", "neighbour") == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]


def minority(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(i < 7), [float(x) for x in rng.normal(size=2)]) for i in range(60)]
    return spark.createDataFrame(rows, "id bigint, y int, v array<double>"), {r[0]: r[2] for r in rows}


def test_smote_balances_with_points_between_neighbours(spark):
    df, points = minority(spark)
    grown = sampling.smote(df, "v", "y", "id", k=5)
    assert rows_of(grown.groupBy("label").count()) == [(0, 53), (1, 53)]
    near = {}
    for r in nearest_neighbours(df.filter("y = 1"), "id", "v", 5).collect():
        near.setdefault(r.key, []).append(r.neighbour)
    copies = {}
    for r in grown.filter("synthetic").collect():
        copies[r.key] = copies.get(r.key, 0) + 1
        x = np.array(points[r.key])
        gaps = []
        for other in near[r.key]:
            o, p = np.array(points[other]), np.array(r.vector)
            u = np.dot(p - x, o - x) / np.dot(o - x, o - x)
            gaps.append(np.linalg.norm(x + u * (o - x) - p) if -1e-9 <= u < 1 else np.inf)
        assert min(gaps) < 1e-9
    assert sum(copies.values()) == 46 and max(copies.values()) - min(copies.values()) <= 1
    assert rows_of(sampling.smote(df.repartition(7), "v", "y", "id", k=5)) == rows_of(grown)


def test_smote_needs_enough_rows(spark):
    df, _ = minority(spark)
    with pytest.raises(ValueError):
        sampling.smote(df, "v", "y", "id", k=7)


ROWS = [("train", 1.0, 5.0, None), ("train", 2.0, 5.0, None), ("train", 6.0, 5.0, 3.0), ("val", 4.0, 7.0, 9.0),
        ("test", None, 5.0, 2.0)]
SCHEMA = "split string, x double, c double, few double"


def test_standardize_uses_training_rows_only(table):
    scaled = scaling.standardize(table(ROWS, SCHEMA))
    train = scaled.filter("split = 'train'").agg(F.avg("x"), F.stddev_samp("x")).first()
    assert abs(train[0]) < 1e-12 and abs(train[1] - 1) < 1e-12
    assert rows_of(scaled, "c") == [(0.0,)] * 5
    assert rows_of(scaled, "few") == sorted([(None,), (None,), (3.0,), (9.0,), (2.0,)], key=repr)
    assert abs(scaled.filter("split = 'val'").first().x - 1 / np.std([1, 2, 6], ddof=1)) < 1e-12
    assert scaled.filter("split = 'test'").first().x is None


def test_normalize(table):
    scaled = scaling.normalize(table(ROWS, SCHEMA), exclude=["few"])
    assert [r.x for r in scaled.filter("x is not null").orderBy("x").collect()] == [0.0, 0.2, 0.6, 1.0]
    assert rows_of(scaled, "c") == [(0.0,)] * 5


def test_amount_column_is_replaced(table):
    scaled = scaling.standardize_amount(table(ROWS, SCHEMA), "x", "scaled", ["c"])
    assert scaled.columns == ["split", "few", "scaled"]
    values = [r.scaled for r in scaled.filter("split = 'train'").collect()]
    assert abs(np.std(values) - 1) < 1e-12


def test_stored_scaler_gives_the_same_result(table):
    df = table(ROWS, SCHEMA)
    params = scaling.scaler_table(scaling.standard_stats(df, ["x", "c", "few"]), "zscore")
    assert rows_of(params, "column", "type") == [("x", "zscore")]
    again = scaling.apply_scaler(df, scaling.stats_from_table(params, ["x"]), scaling.SMALLEST_STD)
    assert rows_of(again, "x") == rows_of(scaling.standardize(df, ["x"]), "x")
    assert scaling.has_split(df) and not scaling.has_split(df, "other")
    assert scaling.take_split(df, "val").columns == ["x", "c", "few"]
