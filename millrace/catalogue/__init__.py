"""All registered queries."""

from . import cleaning, evaluation, models, ordered, outliers, sampling, scaling, stats, streams, text, timeseries  # noqa: F401
from . import answers  # noqa: F401  reads what the others have registered
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
