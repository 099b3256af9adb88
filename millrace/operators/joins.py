"""Putting columns and rows together by row id.

Better still is to keep label and features in one table, where none of this is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_on_row_id(features: DataFrame, labels: DataFrame, row_id: str) -> DataFrame:
    """Rows that are in both tables; ids are unique on both sides, so no task gets more than its share."""
    return features.join(labels, row_id, "inner")


def concat_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns side by side, aligned by id; a row missing on one side gets nulls there."""
    return left.join(right, row_id, "full_outer")


def _once(ids: DataFrame, row_id: str) -> DataFrame:
    """Each id once: an id asked for many times merges before the shuffle."""
    return ids.select(row_id).distinct()


def rows_with_ids(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return df.join(_once(ids, row_id), row_id, "left_semi")


def rows_without_ids(df: DataFrame, ids: DataFrame, row_id: str) -> DataFrame:
    return df.join(_once(ids, row_id), row_id, "left_anti")
