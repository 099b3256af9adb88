"""Scaling on the statistics of the training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lookup import attach_row
from ..plans.names import col
from .columns import numeric_columns

SMALLEST_STD = 1e-8  # fixed value: below it a column counts as constant


def _train(df: DataFrame, split: str, train: str) -> DataFrame:
    return df.filter(col(split) == train)


def standard_stats(df: DataFrame, columns: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """One row: count, mean and sample deviation of the training values of every column."""
    return _train(df, split, train).agg(*[
        F.struct(
            F.count(col(c)).alias("n"), F.avg(col(c)).alias("center"), F.stddev_samp(col(c)).alias("scale")
        ).alias(c)
        for c in columns
    ])


def minmax_stats(df: DataFrame, columns: Sequence[str], split: str = "split", train: str = "train") -> DataFrame:
    """One row: count, minimum and range of the training values of every column."""
    return _train(df, split, train).agg(*[
        F.struct(
            F.count(col(c)).alias("n"),
            F.min(col(c)).cast("double").alias("center"),
            (F.max(col(c)) - F.min(col(c))).cast("double").alias("scale"),
        ).alias(c)
        for c in columns
    ])


def apply_scaler(df: DataFrame, stats: DataFrame, floor: float) -> DataFrame:
    """Centre and scale by ``stats``.

    A column whose training scale is not above ``floor`` becomes 0, one with fewer
    than two training values is left alone.
    """
    data = attach_row(df, stats, "_scaler")

    def scaled(c: str) -> Column:
        part = F.col("_scaler").getField(c)
        scale = part.getField("scale")
        value = col(c).cast("double")
        inside = F.when(scale > floor, (value - part.getField("center")) / F.nullif(scale, F.lit(0.0)))
        return F.when(part.getField("n") > 1, F.when(scale > floor, inside).otherwise(F.lit(0.0))).otherwise(value)

    return data.withColumns({c: scaled(c) for c in stats.columns}).drop("_scaler")


def standardize(
    df: DataFrame, columns: Sequence[str] | None = None, split: str = "split", exclude: Sequence[str] = ()
) -> DataFrame:
    """Z-scores of all numeric features; name labels and keys in ``exclude``."""
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c not in exclude]
    return apply_scaler(df, standard_stats(df, chosen, split), SMALLEST_STD)


def normalize(
    df: DataFrame, columns: Sequence[str] | None = None, split: str = "split", exclude: Sequence[str] = ()
) -> DataFrame:
    """Min-max scaling of all numeric features to the training range."""
    chosen = [c for c in (numeric_columns(df) if columns is None else columns) if c not in exclude]
    return apply_scaler(df, minmax_stats(df, chosen, split), 0.0)


def standardize_amount(
    df: DataFrame, column: str, new_column: str, useless: Sequence[str] = (), split: str = "split"
) -> DataFrame:
    """Add one column scaled by the population deviation, drop the raw and useless columns.

    A constant column is centred only.
    """
    stats = _train(df, split, "train").agg(F.avg(col(column)).alias("mean"), F.stddev_pop(col(column)).alias("std"))
    data = attach_row(df, stats, "_scaler")
    std = F.coalesce(F.nullif(F.col("_scaler.std"), F.lit(0.0)), F.lit(1.0))
    value = (col(column) - F.col("_scaler.mean")) / std
    return data.withColumn(new_column, value).drop("_scaler", column, *useless)


def scaler_table(stats: DataFrame, kind: str) -> DataFrame:
    """Scaler parameters as rows ``(column, type, center, scale)``."""
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(kind).alias("type"),
            col(c).getField("center").alias("center"), col(c).getField("scale").alias("scale"),
            col(c).getField("n").alias("n"),
        )
        for c in stats.columns
    ]
    floor = SMALLEST_STD if kind == "zscore" else 0.0
    return (
        stats.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
        .filter((F.col("n") > 1) & (F.col("scale") > floor)).drop("n")
    )


def stats_from_table(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The one-row form of a stored scaler table, for scoring other data."""
    return table.agg(*[
        F.struct(
            F.lit(2).alias("n"),
            F.max(F.when(F.col("column") == c, F.col("center"))).alias("center"),
            F.max(F.when(F.col("column") == c, F.col("scale"))).alias("scale"),
        ).alias(c)
        for c in columns
    ])


def has_split(df: DataFrame, value: str = "val", split: str = "split") -> bool:
    return not df.filter(col(split) == value).isEmpty()


def take_split(df: DataFrame, value: str, split: str = "split") -> DataFrame:
    return df.filter(col(split) == value).drop(split)
