"""Outlier flags, reports and filters on single columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lookup import attach_row, attach_values
from ..plans.names import col
from ..plans.quantile import quantiles
from .columns import numeric_columns
from .stats import four_distinct


def zscore_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population standard deviation of every column."""
    return df.agg(*[
        F.struct(F.avg(col(c)).alias("mean"), F.stddev_pop(col(c)).alias("std")).alias(c) for c in columns
    ])


def iqr_stats(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    """One row: fences of every column, null where too few distinct values make them unreliable."""
    data = attach_row(quantiles(df, columns, [0.25, 0.75]), four_distinct(df, columns), "_guard")

    def fences(c: str) -> Column:
        q1, q3 = F.get(col(c), F.lit(0)), F.get(col(c), F.lit(1))
        reach = (q3 - q1) * F.lit(float(threshold))
        enough = F.col("_guard").getField(c)
        return F.struct(F.when(enough, q1 - reach).alias("low"), F.when(enough, q3 + reach).alias("high")).alias(c)

    return data.select(*[fences(c) for c in columns])


def z_value(c: str, stats: str = "_stats") -> Column:
    """Distance from the mean in standard deviations; null for a constant column."""
    part = F.col(stats).getField(c)
    return (col(c) - part.getField("mean")) / F.nullif(part.getField("std"), F.lit(0.0))


def _report(df: DataFrame, row_id: str, columns: Sequence[str], outside) -> DataFrame:
    tags = F.array_compact(F.array(*[F.when(outside(c), F.lit(c)) for c in columns]))
    return (
        df.withColumn("extreme_tag", tags).filter(F.size("extreme_tag") > 0)
        .select(
            *[col(c) for c in columns], "extreme_tag",
            F.size("extreme_tag").cast("bigint").alias("abnormal_count"),
            col(row_id).alias("original_index"),
        )
    )


def zscore_report(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """One row per outlying row: the columns in which it is at least ``threshold`` off."""
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c != row_id]
    data = attach_row(df, zscore_stats(df, chosen), "_stats")
    return _report(data, row_id, chosen, lambda c: F.abs(z_value(c)) >= threshold)


def iqr_report(
    df: DataFrame, row_id: str, columns: Sequence[str] | None = None, threshold: float = 1.5
) -> DataFrame:
    """As ``zscore_report`` with values strictly outside the interquartile fences."""
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c != row_id]
    data = attach_values(df, iqr_stats(df, chosen, threshold), "_stats")

    def outside(c: str) -> Column:
        fence = F.col("_stats").getField(c)
        return (col(c) < fence.getField("low")) | (col(c) > fence.getField("high"))

    return _report(data, row_id, chosen, outside)


def merge_report(report: DataFrame, keep_null_keys: bool = False, repeat_tags: bool = False) -> DataFrame:
    """Merge report rows that are equal in all measured columns.

    Rows of one group share their flags, so no list is collected: ``copies`` tells
    how many rows were merged, ``abnormal_count`` counts flags over all of them and
    ``original_index`` is the smallest row id.  ``repeat_tags`` writes every tag once
    per copy; leave it off where a group may be large.  Groups with a null in a
    measured column are dropped unless ``keep_null_keys`` is set.
    """
    keys = [c for c in report.columns if c not in ("extreme_tag", "abnormal_count", "original_index")]
    rows = report if keep_null_keys else report.dropna(subset=keys)
    merged = rows.groupBy(*[col(c) for c in keys], "extreme_tag").agg(
        F.sum("abnormal_count").alias("abnormal_count"),
        F.min("original_index").alias("original_index"),
        F.count("*").alias("copies"),
    )
    if repeat_tags:
        repeated = F.flatten(F.transform("extreme_tag", lambda t: F.array_repeat(t, F.col("copies").cast("int"))))
        merged = merged.withColumn("extreme_tag", repeated)
    return merged


def remove_zscore(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Keep rows closer than ``threshold`` deviations; rows without a value go too."""
    data = attach_row(df, zscore_stats(df, [column]), "_stats")
    return data.filter(F.abs(z_value(column)) < threshold).drop("_stats")


def remove_iqr(df: DataFrame, column: str, threshold: float = 1.5) -> DataFrame:
    """Keep rows on or inside the fences; all rows if the column has under four values."""
    data = attach_values(df, iqr_stats(df, [column], threshold), "_stats")
    fence = F.col("_stats").getField(column)
    no_fence = fence.getField("low").isNull()
    return data.filter(no_fence | col(column).between(fence.getField("low"), fence.getField("high"))).drop("_stats")


def clean_amounts(df: DataFrame, column: str, reach: float = 3.0) -> DataFrame:
    """Drop rows at or beyond ``reach`` interquartile ranges, then exact duplicates.

    The quartiles skip nulls; rows without a value are kept.
    """
    bounds = quantiles(df, [column], [0.25, 0.75]).select(
        F.get(col(column), F.lit(0)).alias("q1"), F.get(col(column), F.lit(1)).alias("q3")
    )
    data = attach_values(df, bounds, "_stats")
    q1, q3 = F.col("_stats.q1"), F.col("_stats.q3")
    spread = (q3 - q1) * F.lit(float(reach))
    beyond = (col(column) >= q3 + spread) | (col(column) <= q1 - spread)
    return data.filter(~F.coalesce(beyond, F.lit(False))).drop("_stats").dropDuplicates()
