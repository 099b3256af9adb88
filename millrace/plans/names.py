"""Column names that may hold dots or blanks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """``F.col`` for a top-level column whatever characters its name holds."""
    return F.col(quoted(name))


def clean_zero(value: Column, places: int = 6) -> Column:
    """Rounded double without a negative zero, for results that are compared."""
    return F.round(value, places) + F.lit(0.0)
