"""Operators that depend on the position of a row in a stated order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import floor

from pyspark.sql import DataFrame, functions as F

from ..plans.ranking import before_key, keys_at, row_count, row_index


def systematic_sample(df: DataFrame, order_by: Sequence[str], start: int = 0, step: int = 1) -> DataFrame:
    """Every ``step``-th row from position ``start``; keeps the position as ``row_idx``."""
    indexed = row_index(df, order_by)
    return indexed.filter((F.col("row_idx") >= start) & ((F.col("row_idx") - start) % step == 0))


def chronological_split(
    df: DataFrame, order_by: Sequence[str], train: float = 0.7, val: float = 0.2
) -> DataFrame:
    """Cut the ordered rows into train, val and test at whole-row positions.

    The second cut is ``floor(n * (train + val))`` in double arithmetic, which for
    0.7 and 0.2 falls one row short of nine tenths at some sizes.  ``order_by`` is a total
    order of columns of any type that can be ordered: the keys at the two cuts are found by
    counting, and every row is compared with them; none is sorted or shuffled.
    """
    n = df.count()
    first, second = keys_at(df, order_by, [floor(n * train), floor(n * (train + val))])
    split = F.when(before_key(df, order_by, first), "train").when(before_key(df, order_by, second), "val").otherwise("test")
    return df.withColumn("split", split)


def split_by_position(indexed: DataFrame, train: float = 0.7, val: float = 0.2, index: str = "row_idx") -> DataFrame:
    """The same for rows that are numbered from 0 already."""
    n = row_count(indexed).cast("double")
    first, second = F.floor(n * F.lit(train)), F.floor(n * F.lit(train + val))
    split = F.when(F.col(index) < first, "train").when(F.col(index) < second, "val").otherwise("test")
    return indexed.withColumn("split", split)


def contiguous_folds(df: DataFrame, order_by: Sequence[str], k: int = 5, name: str = "fold") -> DataFrame:
    """Number ``k`` runs of consecutive rows; the first ``n mod k`` are one row longer.

    Like ``chronological_split``, the rows are compared with the keys that begin each fold.
    """
    size, extra = divmod(df.count(), k)
    starts = keys_at(df, order_by, [i * size + min(i, extra) for i in range(1, k)])
    passed = [F.when(before_key(df, order_by, key), 0).otherwise(1) for key in starts]
    return df.withColumn(name, reduce(lambda a, b: a + b, passed, F.lit(0)).cast("int"))
