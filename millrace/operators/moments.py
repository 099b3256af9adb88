"""Means and covariances of many columns from one scan, and the regressions that rest on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

#: share of the variance of a standardised column that counts as rounding
_ROUNDING = 1e-13


def moments(cells: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, means and population covariances of ``cells``, one column of arrays of doubles of one length without nulls.

    Sums are taken around the values of one row, so that large means do not cost digits.  What is merged
    and reaches the driver is half the square of the number of columns: tens to a few hundred of them.
    """
    one = cells.first()
    if one is None:
        raise ValueError("no complete row")
    centre = np.array(one[0], float)
    size = len(centre)
    upper = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(size), np.zeros((size, size))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) - centre
            n, total, square = n + len(x), total + x.sum(axis=0), square + x.T @ x
        if n:
            values = np.concatenate([[n], total, square[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values)], names=["place", "value"])

    sums = cells.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    values = np.empty(1 + size + len(upper[0]))
    values[sums["place"].to_numpy()] = sums["value"].to_numpy()
    n, shift = int(values[0]), values[1:1 + size] / values[0]
    square = np.zeros((size, size))
    square[upper] = values[1 + size:]
    square = square + np.triu(square, 1).T
    return n, centre + shift, square / n - np.outer(shift, shift)


def matching_points(mean: np.ndarray, covariance: np.ndarray) -> np.ndarray:
    """Two rows per column with these means and covariances: least squares on them gives the same coefficients
    as on all rows, for every choice of features and target among the columns."""
    size = len(mean)
    scale = np.sqrt(np.clip(np.diag(covariance), 0.0, None))
    used = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(used, used))
    values = np.where(values > _ROUNDING * size, values, 0.0)
    steps = (vectors * np.sqrt(values * size)).T * scale
    return np.concatenate([mean + steps, mean - steps])


def regression_points(spark: SparkSession, points: np.ndarray, n_features: int, labels: list[str]) -> DataFrame:
    """The points as a table of ``features`` and the labels, two rows per column."""
    schema = ", ".join(["x array<double>", *[f"y{i} double" for i in range(len(labels))]])
    rows = [(p[:n_features].tolist(), *p[n_features:].tolist()) for p in points]
    return spark.createDataFrame(rows, schema).select(
        array_to_vector("x").alias("features"), *[F.col(f"y{i}").alias(name) for i, name in enumerate(labels)])
