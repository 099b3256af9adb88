"""What kind of data each column holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.names import col


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return "numeric"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    return "other"


def columns_of_kind(df: DataFrame, kind: str) -> list[str]:
    return [f.name for f in df.schema if kind_of(f.dataType) == kind]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "numeric")


def text_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, "categorical")


def column_profile(df: DataFrame, exact_distinct: bool = False) -> DataFrame:
    """Kind, row count, nulls and distinct values of every column, in one scan.

    Distinct values are estimated by default (relative error 2 %); the exact count
    shuffles every value once.
    """
    fields = list(df.schema)
    one_pass = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        value = col(f.name)
        one_pass.append(F.count_if(value.isNull()).alias(f"null{i}"))
        if not exact_distinct:
            one_pass.append(F.approx_count_distinct(value, 0.02).alias(f"distinct{i}"))
    cells = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(kind_of(f.dataType)).alias("kind"),
            F.col("rows").alias("n"),
            F.col(f"null{i}").alias("n_null"),
            *([] if exact_distinct else [F.col(f"distinct{i}").alias("n_distinct")]),
        )
        for i, f in enumerate(fields)
    ]
    profile = df.agg(*one_pass).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if not exact_distinct:
        return profile
    return profile.join(distinct_counts(df), "column", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint"))
    )


def distinct_counts(df: DataFrame, null_counts: bool = False) -> DataFrame:
    """Exact number of distinct values of every column.

    Column and value hash are grouped first, so equal values merge before the shuffle
    and no column ends up in one task.  128 bits of hash stand for the value.
    """
    cells = []
    for f in df.schema:
        value = col(f.name)
        seen = value.isNotNull()
        cells.append(F.struct(
            F.lit(f.name).alias("column"),
            F.when(seen, F.xxhash64(value)).alias("v"),
            F.when(seen, F.xxhash64(F.lit(1), value)).alias("w"),
        ))
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").groupBy("column", "v", "w").agg(
        F.lit(1).alias("one")
    )
    counted = F.count("*") if null_counts else F.count("v")
    return values.groupBy("column").agg(counted.alias("n_distinct"))
