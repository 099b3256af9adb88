"""Derived features as built-in expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values.
DAY_SECONDS = 24 * 60 * 60
YEAR_SECONDS = 365.2425 * DAY_SECONDS


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with fractions; the session time zone must be UTC."""
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def cycle(seconds: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a clock with the given period in seconds."""
    angle = seconds * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def polar(magnitude: Column, degrees: Column) -> tuple[Column, Column]:
    """x and y parts of a magnitude that points ``degrees`` from the x axis."""
    angle = F.radians(degrees)
    return magnitude * F.cos(angle), magnitude * F.sin(angle)


def logistic(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))
