"""Frequencies, moments, quartiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi, sqrt

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lookup import attach_row
from ..plans.names import col
from ..plans.quantile import quantiles
from .cleaning import unpivot_all
from .columns import numeric_columns


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, rarest first; rows without a class are left out."""
    return (
        df.filter(col(label).isNotNull()).groupBy(col(label)).agg(F.count("*").alias("n"))
        .orderBy("n", col(label))
    )


def class_share(df: DataFrame, label: str, positive=1) -> DataFrame:
    """Number and share of positive rows."""
    hit = col(label) == F.lit(positive)
    return df.agg(
        F.count("*").alias("n"),
        F.count_if(hit).alias("n_positive"),
        F.avg(hit.cast("double")).alias("share"),
    )


def _long(row: DataFrame, columns: Sequence[str], fields: dict[str, object]) -> DataFrame:
    """Turn a one-row table into one row per column."""
    cells = [
        F.struct(F.lit(c).alias("column"), *[make(i, c).alias(name) for name, make in fields.items()])
        for i, c in enumerate(columns)
    ]
    return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, both standard deviations, minimum and maximum in one scan."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    parts = {
        "n": F.count, "mean": F.avg, "std_samp": F.stddev_samp, "std_pop": F.stddev_pop, "min": F.min, "max": F.max,
    }
    row = df.agg(*[
        make(col(c).cast("double")).alias(f"{name}{i}") for i, c in enumerate(chosen) for name, make in parts.items()
    ])
    return _long(row, chosen, {name: (lambda i, c, name=name: F.col(f"{name}{i}")) for name in parts})


def quartiles(df: DataFrame, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """Exact quartiles with linear interpolation, one row per column."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    row = quantiles(df, chosen, [0.25, 0.5, 0.75], **options)
    return _long(row, chosen, {
        name: (lambda i, c, at=at: F.get(col(c), F.lit(at))) for at, name in enumerate(("q1", "median", "q3"))
    })


def four_distinct(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: does each column hold at least four different values, null being one?

    Exact and without a set of values: with the extremes known, four values exist if the
    second smallest is below the second largest.  Two scans of minima and maxima.
    """
    columns = list(columns)
    ends = df.agg(*[
        F.struct(F.min(col(c)).alias("low"), F.max(col(c)).alias("high"),
                 F.max(col(c).isNull().cast("int")).alias("holes")).alias(c)
        for c in columns
    ])
    inner = attach_row(df.select(*[col(c) for c in columns]), ends, "_ends")

    def end(c: str, name: str) -> Column:
        return F.col("_ends").getField(c).getField(name)

    within = inner.agg(*[
        F.struct(F.min(F.when(col(c) > end(c, "low"), col(c))).alias("second"),
                 F.max(F.when(col(c) < end(c, "high"), col(c))).alias("last_but_one")).alias(c)
        for c in columns
    ])

    def enough(c: str) -> Column:
        second, last = col(c).getField("second"), col(c).getField("last_but_one")
        steps = [end(c, "low").isNotNull(), second.isNotNull(), second < end(c, "high"), second < last]
        count = sum((F.coalesce(s, F.lit(False)).cast("int") for s in steps), F.coalesce(end(c, "holes"), F.lit(0)))
        return (count >= 4).alias(c)

    return attach_row(within, ends, "_ends").select(*[enough(c) for c in columns])


def distinct_guard(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    chosen = list(numeric_columns(df) if columns is None else columns)
    return _long(four_distinct(df, chosen), chosen, {"enough": lambda i, c: col(c)})


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """Counts on a ``bins`` x ``bins`` grid between the extremes; the last bin is closed."""
    pairs = df.select(col(x).cast("double").alias("x"), col(y).cast("double").alias("y")).dropna()
    ends = pairs.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))

    def bin_of(value: str) -> Column:
        return bin_index(F.col(value), F.col(f"_e.{value}0"), F.col(f"_e.{value}1"), bins)

    return (
        attach_row(pairs, ends, "_e").select(bin_of("x").alias("bx"), bin_of("y").alias("by"))
        .groupBy("bx", "by").agg(F.count("*").alias("n"))
    )


def bin_index(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Equal-width bin; a column of one value lies in the middle, as its range is ±0.5.

    Edges are ``low + i * width / bins``; dividing may miss one by rounding, so the bin
    is checked against its own edges.
    """
    width = high - low
    step = width / bins
    guess = F.floor((value - low) / F.nullif(step, F.lit(0.0)))
    exact = (
        guess + (value >= low + (guess + 1) * step).cast("int") - (value < low + guess * step).cast("int")
    )
    return F.least(F.lit(bins - 1), F.when(width == 0, F.lit(bins // 2)).otherwise(exact)).cast("int")


def distribution_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Minimum, quartiles, maximum and mean of every column: the numbers of a violin plot."""
    spread = moments(df, columns).select("column", "n", "mean", "min", "max")
    return spread.join(F.broadcast(quartiles(df, columns)), "column")  # one row per column


def column_histograms(df: DataFrame, columns: Sequence[str] | None = None, bins: int = 50) -> DataFrame:
    """One density histogram per column, from the long form, in one scan."""
    chosen = list(numeric_columns(df) if columns is None else columns)
    ends = df.agg(*[
        F.struct(F.min(col(c)).cast("double").alias("low"), F.max(col(c)).cast("double").alias("high")).alias(c)
        for c in chosen
    ])
    data = attach_row(df, ends, "_e")
    placed = data.select(*[
        bin_index(col(c).cast("double"), F.col("_e").getField(c).getField("low"),
                  F.col("_e").getField(c).getField("high"), bins).alias(c)
        for c in chosen
    ])
    return (
        unpivot_all(placed, "column", "bin", chosen).filter(F.col("bin").isNotNull())
        .groupBy("column", F.col("bin").cast("int").alias("bin")).agg(F.count("*").alias("n"))
    )


DENSITY_REACH = 4.0  # bandwidths beyond which the kernel is left out, and by which the grid goes beyond the data


def density(df: DataFrame, columns: Sequence[str] | None = None, points: int = 256) -> DataFrame:
    """Gaussian kernel density of every column on an even grid: ``column, point, x, density``.

    The bandwidth is ``std n^(-1/5)`` (sample deviation).  Every value is shared between its two neighbouring grid
    points in proportion to its distance (linear binning), and the kernel is laid over the grid
    instead of over the rows: one scan for the ends, one for the weights, then ``points`` rows a column.
    Nulls are skipped; columns without two different values, or with values that are not finite, have no curve.
    """
    chosen = list(numeric_columns(df) if columns is None else columns)
    value = {c: col(c).cast("double") for c in chosen}
    ends = df.agg(*[
        F.struct(F.min(v).alias("low"), F.max(v).alias("high"), F.stddev_samp(v).alias("std"), F.count(v).alias("n")).alias(c)
        for c, v in value.items()])
    # one row per column
    grids = ends.unpivot([], [col(c) for c in chosen], "column", "e").select("column", "e.*").filter("std > 0 AND high - low < double('inf')")
    wide = grids.withColumn("h", F.col("std") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).select(
        "column", "n", "h", (F.col("low") - DENSITY_REACH * F.col("h")).alias("start"),
        ((F.col("high") - F.col("low") + 2 * DENSITY_REACH * F.col("h")) / (points - 1)).alias("step"))
    long = unpivot_all(df.select(*[v.alias(c) for c, v in value.items()]), "column", "value", chosen).filter("value IS NOT NULL")
    place = (F.col("value") - F.col("start")) / F.col("step")
    left = F.least(F.floor(place), F.lit(points - 2))
    shares = F.array(
        F.struct(left.alias("point"), (1.0 - (place - left)).alias("w")), F.struct((left + 1).alias("point"), (place - left).alias("w")))
    weights = (
        long.join(F.broadcast(wide), "column").select("column", F.explode(shares).alias("s"))
        .groupBy("column", "s.point").agg(F.sum("s.w").alias("w")))
    # both sides have at most ``points`` rows a column
    at = wide.withColumn("point", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))))
    apart = (F.col("point") - F.col("other")) * F.col("step") / F.col("h")
    kernel = F.when(F.abs(apart) <= DENSITY_REACH, F.exp(-0.5 * apart * apart)).otherwise(0.0)
    height = F.sum(F.col("w") * kernel) / (F.first("n") * F.first("h") * sqrt(2 * pi))
    return (
        at.join(weights.withColumnRenamed("point", "other"), "column")
        .groupBy("column", "point").agg((F.first("start") + F.col("point") * F.first("step")).alias("x"), height.alias("density"))
        .select("column", F.col("point").cast("int").alias("point"), "x", "density"))


def split_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per split and in total."""
    return df.rollup(col(split)).agg(F.count("*").alias("n")).select(
        F.coalesce(col(split), F.lit("total")).alias("split"), "n"
    )
