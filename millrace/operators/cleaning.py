"""Repairing, filling, de-duplicating and reshaping tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.repair import MISSING_TEXT, first_cell, first_number, sentinel_replaced, to_number
from ..plans.lookup import attach_row, repeat_rows, salted_semi_join
from ..plans.names import col
from ..plans.quantile import quantiles
from .columns import numeric_columns, text_columns


def repair_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn text columns into the first number they hold; absent columns are skipped."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: first_number(col(c)) for c in present})


def coerce_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns as doubles, unreadable values as null."""
    chosen = numeric_columns(df) if columns is None else columns
    return df.withColumns({c: to_number(col(c)) for c in chosen})


def unnest_first(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace nested cells by their first scalar; scalar columns stay as they are."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.withColumns({c: first_cell(col(c), kinds[c]) for c in columns if c in kinds})


def replace_sentinel(df: DataFrame, columns: Sequence[str], sentinel: float, value: float | None) -> DataFrame:
    return df.withColumns({c: sentinel_replaced(col(c), sentinel, value) for c in columns})


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null is the only missing value in this library."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the most frequent value of every column, the smallest on ties.

    Values are counted by a grouped aggregate, so many distinct values are spread
    over tasks and frequent ones are merged before the shuffle.
    """
    columns = list(columns)
    # one field per column keeps every type; only the field of the group is filled
    cells = F.array(*[
        F.struct(F.lit(i).alias("i"), *[
            (col(c) if i == j else F.lit(None).cast(df.schema[c].dataType)).alias(f"v{j}")
            for j, c in enumerate(columns)
        ])
        for i, _ in enumerate(columns)
    ])
    names = [f"v{j}" for j in range(len(columns))]
    counts = (
        df.select(F.explode(cells).alias("cell")).select("cell.*")
        .groupBy("i", *names).agg(F.count("*").alias("n"))
    )
    best = [
        F.min(F.when((F.col("i") == j) & F.col(v).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(v).alias("v"))))
        .getField("v").alias(c)
        for j, (v, c) in enumerate(zip(names, columns))
    ]
    return counts.agg(*best)


def _filled(df: DataFrame, values: DataFrame, fallback: Mapping[str, Column]) -> DataFrame:
    data = attach_row(df, values, "_fill")
    fills = {}
    for c in values.columns:
        options = [col(c), F.col("_fill").getField(c)]
        if c in fallback:
            options.append(fallback[c])
        fills[c] = F.coalesce(*options).cast(df.schema[c].dataType)
    return data.withColumns(fills).drop("_fill")


def fill_text(df: DataFrame, strategy: str = "custom", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing text with ``Missing`` (custom) or with the mode of the column."""
    chosen = list(text_columns(df) if columns is None else columns)
    if strategy == "custom":
        return df.na.fill(MISSING_TEXT, subset=chosen)
    if strategy == "mode":
        return _filled(df, modes(df, chosen), {c: F.lit(MISSING_TEXT) for c in chosen})
    raise ValueError(f"unknown strategy for text: {strategy}")


def fill_numbers(
    df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None, value: float | None = None
) -> DataFrame:
    """Fill missing numbers by mean, median, mode or a constant.

    Mean and median turn integer columns into doubles, so nothing is cut off.
    """
    chosen = list(numeric_columns(df) if columns is None else columns)
    if strategy == "constant":
        if value is None:
            return df
        return df.withColumns({c: F.coalesce(col(c), F.lit(value).cast(df.schema[c].dataType)) for c in chosen})
    if strategy == "mode":
        return _filled(df, modes(df, chosen), {})
    data = df.withColumns({c: col(c).cast("double") for c in chosen})
    if strategy == "mean":
        return _filled(data, data.agg(*[F.avg(col(c)).alias(c) for c in chosen]), {})
    if strategy == "median":
        found = quantiles(data, chosen, [0.5])
        return _filled(data, found.select(*[F.get(col(c), F.lit(0)).alias(c) for c in chosen]), {})
    raise ValueError(f"unknown strategy for numbers: {strategy}")


def drop_duplicates(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Keep one row of each set of equal rows.

    With ``row_id`` rows are equal when all other columns are, and the smallest id
    stays.  Copies are merged before the shuffle, so a hot row costs nothing.
    """
    if row_id is None:
        return df.dropDuplicates()
    others = [c for c in df.columns if c != row_id]
    kept = df.groupBy(*[col(c) for c in others]).agg(F.min(col(row_id)).alias(row_id))
    return kept.select(*[col(c) for c in df.columns])


def duplicate_rows(df: DataFrame, row_id: str | None = None) -> DataFrame:
    """Every copy of the rows that occur more than once."""
    keys = [c for c in df.columns if c != row_id]
    repeated = df.groupBy(*[col(c) for c in keys]).agg(F.count("*").alias("_copies")).filter("_copies > 1")
    if row_id is None:
        # copies are alike in every column: repeating the group gives them all back
        return repeat_rows(repeated, "_copies").drop("_copy")
    return salted_semi_join(df, repeated, keys, spread_by=[row_id], copies="_copies")


def unpivot_all(
    df: DataFrame, var_name: str = "Column", value_name: str = "Standardized", columns: Sequence[str] | None = None
) -> DataFrame:
    """Wide to long: one row per cell."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    return df.select(*[col(c).cast("double").alias(c) for c in chosen]).unpivot(
        [], [col(c) for c in chosen], var_name, value_name
    )


def head_rows(df: DataFrame, order_by: Sequence[str | Column], n: int = 5) -> DataFrame:
    """The first ``n`` rows in a stated order."""
    return df.orderBy(*[col(c) if isinstance(c, str) else c for c in order_by]).limit(n)


def step_audit(steps: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Rows in and out of each step of a chain, the first entry being the input.

    Plain counts of the steps' own plans: they stay right when tasks are run again.
    """
    counts = [
        frame.agg(F.count("*").alias("rows")).select(
            F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.lit(len(frame.columns)).alias("n_columns"), "rows"
        )
        for i, (name, frame) in enumerate(steps)
    ]
    table = counts[0]
    for other in counts[1:]:
        table = table.unionAll(other)
    before = F.lag("rows").over(Window.orderBy("step_no"))  # one row per step
    return (
        table.withColumn("rows_in", before).filter("step_no > 0")
        .select("step_no", "step", "n_columns", "rows_in", F.col("rows").alias("rows_out"))
    )
