"""Resampling and scoring of unbounded tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.outliers import zscore_stats
from ..operators.scaling import SMALLEST_STD
from ..plans.names import col
from ..plans.scratch import new_path


def read_parquet_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the Parquet files that match ``path``, schema taken from what is there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def resample_stream(
    stream: DataFrame, time: str, values: Sequence[str], window: str = "1 day", late: str = "1 hour",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean per calendar window and key; rows later than ``late`` are ignored.

    Windows are emitted once they are closed, so a stream holds state only for open ones.
    """
    timed = stream.withColumn(time, col(time).cast("timestamp")).withWatermark(time, late)
    grouped = timed.groupBy(F.window(col(time), window), *[col(k) for k in keys])
    means = grouped.agg(*[F.avg(col(c)).alias(c) for c in values], F.count("*").alias("n"))
    return means.select(F.col("window.start").cast("timestamp_ntz").alias(time), *[col(k) for k in keys],
                        *[col(c) for c in values], "n")


def frozen_stats(history: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column of a finished table: two numbers each."""
    row = zscore_stats(history, columns).first()
    return {c: (row[c]["mean"], row[c]["std"]) for c in columns}


def score_stream(
    stream: DataFrame, stats: dict[str, tuple[float, float]], threshold: float = 3.0
) -> DataFrame:
    """Add ``<column>_z`` and the tags of columns at least ``threshold`` deviations off.

    Stateless: the frozen statistics are constants of the plan.
    """
    scores = {}
    for c, (mean, std) in stats.items():
        usable = std is not None and std > SMALLEST_STD
        scores[f"{c}_z"] = (col(c) - F.lit(mean)) / F.lit(std) if usable else F.lit(None).cast("double")
    tags = F.array_compact(F.array(*[F.when(F.abs(col(f"{c}_z")) >= threshold, F.lit(c)) for c in stats]))
    return stream.withColumns(scores).withColumn("extreme_tag", tags)


def run_available(stream: DataFrame, label: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything that has arrived, then read back the table written so far.

    With the same ``path`` and ``checkpoint`` a later call continues where this one
    stopped; the file sink commits each batch once.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, label)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint or f"{path}-progress")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
