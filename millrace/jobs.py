"""The two complete jobs: balanced classification of transactions, windows of a weather series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .functions.repair import WIND_SENTINEL, day_first_timestamp
from .operators import classify, cleaning, outliers, sampling, scaling, timeseries
from .operators.columns import numeric_columns
from .operators.ordering import split_by_position
from .plans.names import col
from .plans.ranking import row_index
from .plans.scratch import written

# Column names of the two inputs.
AMOUNT, TIME, CLASS, SCALED_AMOUNT = "交易金额", "时间", "类别", "标准化交易金额"
WEATHER_TIME, TEMPERATURE, PRESSURE = "Date Time", "T", "p"
WIND_SPEEDS = ("wv", "max. wv")


def prepare_transactions(
    raw: DataFrame, amount: str = AMOUNT, time: str = TIME, scaled: str = SCALED_AMOUNT, seed: int = 42
) -> DataFrame:
    """Drop far amounts and copies, number the rows, split, scale the amount on training rows."""
    cleaned = outliers.clean_amounts(cleaning.nan_to_null(raw), amount)
    indexed = row_index(cleaned, cleaned.columns, "row_id")
    split = sampling.random_split(indexed, ["row_id"], seed=seed)
    return scaling.standardize_amount(split, amount, scaled, [time])


def compare_transaction_models(prepared: DataFrame, label: str = CLASS, **options) -> DataFrame:
    """Undersampling, no balancing, raised threshold and SMOTE on the same test rows."""
    rows = written(sampling.shuffle_key(prepared, ["row_id"]), "transactions")
    features = [c for c in numeric_columns(rows) if c not in (label, "row_id")]
    train = rows.filter("split = 'train'").drop("split").withColumn("copy", F.lit(0).cast("bigint"))
    test = rows.filter("split = 'test'").drop("split")
    undersampled = written(sampling.undersample_and_split(train, label, ["row_id"]), "undersampled")
    points = train.select("row_id", label, F.array(*[col(c).cast("double") for c in features]).alias("v"))
    grown = written(sampling.smote(points, "v", label, "row_id"), "oversampled")
    oversampled = sampling.shuffle_key(grown.select(
        "copy", F.col("key").alias("row_id"), F.col("label").alias(label),
        *[F.get("vector", F.lit(i)).alias(c) for i, c in enumerate(features)],
    ), ["row_id", "copy"])
    order = ["copy", "shuffle_key", "row_id"]
    return classify.compare_strategies(train, test, features, label, order, undersampled, oversampled, **options)


def prepare_weather(
    raw: DataFrame, problem_columns: Sequence[str] = (TEMPERATURE,), start: int = 5, step: int = 6,
    targets: Sequence[str] = (TEMPERATURE, PRESSURE),
) -> DataFrame:
    """Hourly rows with time and wind features, split in order and scaled on training rows.

    Impossible wind speeds are replaced before anything is averaged.  Targets stay raw.
    ``row_idx`` counts the sampled rows from 0.
    """
    nested = [f.name for f in raw.schema if f.name in problem_columns]
    fixed = cleaning.repair_numbers(cleaning.unnest_first(raw, nested), problem_columns)
    typed = cleaning.nan_to_null(cleaning.coerce_numbers(fixed))
    timed = typed.withColumn(WEATHER_TIME, day_first_timestamp(col(WEATHER_TIME)))
    calm = cleaning.replace_sentinel(timed, WIND_SPEEDS, WIND_SENTINEL, 0.0)
    filled = cleaning.fill_numbers(cleaning.fill_text(calm, "custom"), "mean")
    once = cleaning.drop_duplicates(filled)
    others = [c for c in once.columns if c != WEATHER_TIME]
    numbered = row_index(once, [WEATHER_TIME, *others])
    # sampled positions are evenly spaced, so their numbers follow without another sort
    hourly = numbered.filter((F.col("row_idx") >= start) & ((F.col("row_idx") - start) % step == 0)).withColumn(
        "row_idx", F.floor((F.col("row_idx") - start) / step)
    )
    featured = timeseries.wind_vectors(timeseries.cyclic_time(hourly, WEATHER_TIME))
    return scaling.standardize(split_by_position(featured), exclude=["row_idx", *targets])


def weather_windows(
    prepared: DataFrame, targets: Sequence[str] = (TEMPERATURE, PRESSURE), **shape
) -> DataFrame:
    """Windows inside each split: all columns as inputs, the targets as labels."""
    columns = [c for c in numeric_columns(prepared) if c != "row_idx"]
    return timeseries.sliding_windows(prepared, columns, list(targets), within=["split"], **shape)
