"""Exact quantiles with linear interpolation, also for columns of many distinct values.

``percentile`` keeps every distinct value of a column in one buffer, so it is not used.  One
scan counts the values of all columns and brackets each wanted rank by approximate percentiles;
a second one counts what lies below and on the ends of the brackets and gathers the values strictly
inside.  These are a small share of the rows, whatever the values: a value that many rows share is
an end of its bracket, not inside.  Where even that share is more than a buffer may hold, the
brackets are narrowed by further scans before.  No raw row is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, floor

from pyspark.sql import Column, DataFrame, functions as F

from .names import col


GRID = 100


@dataclass
class _Bracket:
    column: str
    prob: int
    low_rank: int
    high_rank: int
    fraction: float
    low: float
    high: float
    share: float  # of the column's values, at most so many are expected strictly inside
    slack: float = 2.0

    def inside(self) -> Column:
        """Open at ends that are not known yet."""
        value = col(self.column)
        return (value > F.lit(self.low)) & (value < F.lit(self.high))


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    buffer_limit: int = 1_000_000,
    accuracy: int = 10_000,
) -> DataFrame:
    """One row; every column holds the ``array<double>`` of its quantiles.

    Nulls are skipped; a column without values yields null.  Runs small jobs while
    it is called: two scans, more only where ``buffer_limit`` values cannot hold what the brackets
    of all columns leave inside.  The results are a few numbers per column.
    """
    columns, probs = list(dict.fromkeys(columns)), list(probs)
    data = df.select(*[col(c).cast("double").alias(c) for c in columns])
    sizes, brackets = _first_brackets(data, columns, probs, accuracy)
    found: dict = {}
    pending = brackets
    while pending:
        while sum(b.share * sizes[b.column] for b in pending) > buffer_limit and any(_narrow(data, pending, sizes, accuracy)):
            pass
        pending = _gathered(data, pending, sizes, accuracy, found)

    def interpolated(c: str) -> Column:
        own = [(b.fraction, *found[c, b.prob]) for b in brackets if b.column == c]
        return F.array(*[F.lit(low if low == high else low + (high - low) * f) for f, low, high in own]) if own else F.lit(None)

    # constants: nothing is left to run
    return df.sparkSession.sql("SELECT 1").select(*[interpolated(c).cast("array<double>").alias(c) for c in columns])


def _first_brackets(data, columns, probs, accuracy) -> tuple[dict[str, int], list[_Bracket]]:
    margin = 2.0 / accuracy
    wanted = [min(1.0, max(0.0, p + s)) for p in probs for s in (-margin, margin)]
    row = data.agg(*[
        part for i, c in enumerate(columns)
        for part in (F.count(col(c)).alias(f"n{i}"), F.percentile_approx(col(c), wanted, accuracy).alias(f"a{i}"))]).first()
    sizes, brackets = {}, []
    for i, c in enumerate(columns):
        sizes[c] = n = row[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            at = (n - 1) * p
            low, high = row[f"a{i}"][2 * j:2 * j + 2]
            brackets.append(_Bracket(c, j, floor(at), ceil(at), at - floor(at), low, high, 3 * margin))
    return sizes, brackets


def _narrow(data, brackets, sizes, accuracy) -> list[bool]:
    """One scan that cuts every bracket at percentiles of what is inside; tells which ones became tighter."""
    grid = [i / GRID for i in range(GRID + 1)]
    counted = data.agg(*[
        part for i, b in enumerate(brackets)
        for part in (
            F.count_if(col(b.column) <= F.lit(b.low)).alias(f"upto{i}"), F.count_if(b.inside()).alias(f"inside{i}"),
            F.percentile_approx(F.when(b.inside(), col(b.column)), grid, accuracy).alias(f"ends{i}"))]).first()
    tighter = []
    for i, b in enumerate(brackets):
        upto, inside, ends = (counted[f"{x}{i}"] for x in ("upto", "inside", "ends"))
        before, b.share = (b.low, b.high), inside / sizes[b.column]
        if b.high_rank < upto:  # if a bracket lies elsewhere, that is found out when it is gathered
            b.high, b.share = b.low, 0.0
        elif b.low_rank >= upto + inside:
            b.low, b.share = b.high, 0.0
        else:
            room = b.slack / accuracy + 1 / GRID
            first = floor(((b.low_rank - upto) / inside - room) * GRID)
            last = ceil(((b.high_rank + 1 - upto) / inside + room) * GRID)
            b.low = ends[first] if first >= 0 else b.low
            b.high = ends[last] if last <= GRID else b.high
            b.share *= min(1.0, (last - first + 1) / GRID)
        tighter.append((b.low, b.high) != before)
    return tighter


def _gathered(data, brackets, sizes, accuracy, found) -> list[_Bracket]:
    """The values at the wanted ranks; brackets that missed theirs are opened and returned."""
    counted = data.agg(*[
        part for i, b in enumerate(brackets)
        for part in (
            F.count_if(col(b.column) < F.lit(b.low)).alias(f"below{i}"), F.count_if(col(b.column) == F.lit(b.low)).alias(f"low{i}"),
            F.count_if(col(b.column) == F.lit(b.high)).alias(f"high{i}"),
            F.sort_array(F.collect_list(F.when(b.inside(), col(b.column)))).alias(f"values{i}"))
    ])

    def value_at(i: int, b: _Bracket, rank: int) -> Column:
        at = F.lit(rank) - F.col(f"below{i}")
        inner = at - F.col(f"low{i}")
        size = F.size(f"values{i}")
        return (F.when((at >= 0) & (inner < 0), F.lit(b.low))
                .when((inner >= 0) & (inner < size), F.get(f"values{i}", inner.cast("int")))
                .when((inner >= size) & F.lit(b.low != b.high) & (inner - size < F.col(f"high{i}")), F.lit(b.high)))

    row = counted.select(*[
        value_at(i, b, rank).alias(f"{end}{i}")
        for i, b in enumerate(brackets) for end, rank in (("l", b.low_rank), ("h", b.high_rank))]).first()
    missed = []
    for i, b in enumerate(brackets):
        low, high = row[f"l{i}"], row[f"h{i}"]
        if low is None or high is None:
            # the estimate was off: start again from the whole column, NaN being the largest value
            b.low, b.high, b.share, b.slack = float("-inf"), float("nan"), 1.0, b.slack * 2
            missed.append(b)
        else:
            found[b.column, b.prob] = (low, high)
    return missed
