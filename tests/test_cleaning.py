import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from millrace.functions.repair import day_first_timestamp
from millrace.operators import cleaning, columns

CLIMATE = [
    (1, "-1.5C", "01.02.2024 00:00:00", -9999.0), (2, "bad", "01.02.2024 00:10:00", 2.0),
    (3, " 12", "31.12.2023 23:50:00", 0.0), (4, None, "29.02.2024 12:00:00", -1.0), (5, "x.5y7", "01.03.2024 00:00:00", 3.5),
]


@pytest.fixture
def climate(table):
    return table(CLIMATE, "id int, T string, `Date Time` string, `max. wv` double")


def test_first_number_of_text(climate):
    fixed = cleaning.repair_numbers(climate, ["T", "not there"])
    assert rows_of(fixed, "id", "T") == [(1, -1.5), (2, None), (3, 12.0), (4, None), (5, 0.5)]


def test_day_first_text(climate):
    parsed = climate.select(day_first_timestamp(F.col("`Date Time`")).alias("ts")).orderBy("ts")
    assert parsed.first()[0] == dt.datetime(2023, 12, 31, 23, 50)


def test_bad_timestamp_fails_when_strict(table):
    text = table([("2024-01-01",)], "ts string")
    with pytest.raises(Exception):
        text.select(day_first_timestamp(F.col("ts"))).collect()
    assert text.select(day_first_timestamp(F.col("ts"), strict=False)).first()[0] is None


def test_sentinel_in_column_with_dot(climate):
    fixed = cleaning.replace_sentinel(climate, ["max. wv"], -9999.0, 0.0)
    assert [r[0] for r in fixed.orderBy("id").select("`max. wv`").collect()] == [0.0, 2.0, 0.0, -1.0, 3.5]


def test_nested_cells(table):
    df = table([(1, [(1.5, "a"), (2.0, "b")], 7), (2, [], 8), (3, None, 9)],
               "id int, cell array<struct<x: double, y: string>>, plain int")
    assert rows_of(cleaning.unnest_first(df, ["cell", "plain"])) == [(1, 1.5, 7), (2, None, 8), (3, None, 9)]


def test_nan_becomes_null(table):
    df = cleaning.nan_to_null(table([(float("nan"),), (1.0,)], "x double"))
    assert rows_of(df) == [(1.0,), (None,)]


def test_column_kinds_and_profile(table):
    df = table([(1, "a", None, True), (2, None, 2.0, True), (2, "a", 3.0, None)], "i int, s string, d double, b boolean")
    assert columns.numeric_columns(df) == ["i", "d"]
    assert columns.text_columns(df) == ["s"]
    assert columns.columns_of_kind(df, "other") == ["b"]
    expected = [("b", "other", 3, 1, 1), ("d", "numeric", 3, 1, 2), ("i", "numeric", 3, 0, 2), ("s", "categorical", 3, 1, 1)]
    for exact in (False, True):
        profile = columns.column_profile(df, exact_distinct=exact)
        assert rows_of(profile, "column", "kind", "n", "n_null", "n_distinct") == expected


MODES = [("b", 2.0), ("a", 1.0), ("b", 1.0), ("a", 2.0), (None, None), ("c", 9.0)]


def test_smallest_of_several_modes(table):
    df = table(MODES, "s string, x double")
    assert tuple(cleaning.modes(df, ["s", "x"]).first()) == ("a", 1.0)


@pytest.mark.parametrize("strategy,value", [("mean", 3.0), ("median", 2.0), ("mode", 1.0)])
def test_fill_numbers(table, strategy, value):
    filled = cleaning.fill_numbers(table(MODES, "s string, x double"), strategy)
    assert [r[0] for r in filled.filter("s is null").select("x").collect()] == [value]


def test_fill_constant_only_with_value(table):
    df = table(MODES, "s string, x double")
    assert cleaning.fill_numbers(df, "constant").filter("x is null").count() == 1
    assert cleaning.fill_numbers(df, "constant", value=-1.0).filter("x = -1").count() == 1


def test_fill_text(table):
    df = table([(None, "a", None), (None, None, None)], "gone string, s string, x double")
    for strategy, s in (("custom", "Missing"), ("mode", "a")):
        filled = cleaning.fill_text(df, strategy)
        assert rows_of(filled) == sorted([("Missing", "a", None), ("Missing", s, None)], key=repr)


DUPLICATES = [(1, "a", 1.0), (2, "a", 1.0), (3, "a", None), (4, "a", None), (5, "b", 1.0), (6, "a", 1.0), (7, None, None),
              (8, "c", 2.0)]


@pytest.mark.parametrize("partitions", [1, 7])
def test_duplicates(table, partitions):
    df = table(DUPLICATES, "id bigint, s string, x double", partitions)
    assert [r[0] for r in rows_of(cleaning.drop_duplicates(df, row_id="id"), "id")] == [1, 3, 5, 7, 8]
    assert [r[0] for r in rows_of(cleaning.duplicate_rows(df, row_id="id"), "id")] == [1, 2, 3, 4, 6]
    plain = df.drop("id")
    assert cleaning.drop_duplicates(plain).count() == 5
    assert rows_of(cleaning.duplicate_rows(plain)) == sorted([("a", 1.0)] * 3 + [("a", None)] * 2, key=repr)


def test_hot_copies_are_all_listed(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("v"))
    listed = cleaning.duplicate_rows(df, row_id="id")
    assert listed.count() == 6667 and listed.filter("v <> 0").count() == 0


def test_audit_counts_rows_of_each_step(table):
    df = table(DUPLICATES, "id bigint, s string, x double").drop("id")
    audit = cleaning.step_audit([("read", df), ("known", df.dropna()), ("once", df.dropna().distinct())])
    assert rows_of(audit, "step", "rows_in", "rows_out") == [("known", 8, 5), ("once", 5, 3)]


def test_long_form(table):
    df = table([(1.0, 2)], "`a.b` double, c int")
    assert rows_of(cleaning.unpivot_all(df)) == [("a.b", 1.0), ("c", 2.0)]


def test_head_rows(table):
    assert [r[0] for r in cleaning.head_rows(table([(3,), (1,), (2,)], "x int"), ["x"], 2).collect()] == [1, 2]
