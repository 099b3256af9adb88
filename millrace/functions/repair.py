"""Expressions that repair one column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

# Fixed values.
NUMBER_PATTERN = r"([-+]?\d*\.?\d+)"
DAY_FIRST = "dd.MM.yyyy HH:mm:ss"
MISSING_TEXT = "Missing"
WIND_SENTINEL = -9999.0


def first_number(value: Column) -> Column:
    """The first number in a text, null where there is none."""
    return F.regexp_extract(value.cast("string"), NUMBER_PATTERN, 1).try_cast("double")


def to_number(value: Column) -> Column:
    """A double, null where the text is no number; NaN becomes null as well."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def day_first_timestamp(text: Column, strict: bool = True, pattern: str = DAY_FIRST) -> Column:
    """Timestamp from day-first text; bad text fails the job unless ``strict`` is off."""
    parse = F.to_timestamp if strict else F.try_to_timestamp
    return parse(text, F.lit(pattern) if not strict else pattern)


def sentinel_replaced(value: Column, sentinel: float, replacement: float | None) -> Column:
    return F.when(value == F.lit(sentinel), F.lit(replacement)).otherwise(value)


def first_cell(value: Column, kind: T.DataType) -> Column:
    """Scalar out of a nested cell: first row of an array, first field of a struct."""
    while True:
        if isinstance(kind, T.ArrayType):
            value, kind = F.get(value, F.lit(0)), kind.elementType
        elif isinstance(kind, T.StructType):
            value, kind = value.getField(kind.fields[0].name), kind.fields[0].dataType
        else:
            return value
