"""Row numbers over a whole table without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from .names import col
from .scratch import written

_POSITION_BITS = 33  # fixed: layout of monotonically_increasing_id


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_idx") -> DataFrame:
    """Add the 0-based position of each row in the order of ``order_by``.

    Without ``order_by`` rows keep the order in which they are read.  Otherwise the
    order must be total (end it with a unique key).  One range sort spreads the
    rows evenly whatever the distribution of the keys; the sorted rows are written
    with their partition and position, and the start of each partition is a running
    sum over one row per partition.
    """
    mid = F.monotonically_increasing_id()
    ordered = df.orderBy(*[col(c) for c in order_by]) if order_by else df
    placed = (
        ordered.withColumn("_mid", mid)
        .withColumn("_part", F.shiftright("_mid", _POSITION_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_mid")
    )
    stored = written(placed, "row-index")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one small row per partition of the sort, or per input split where nothing is sorted
    starts = stored.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    return (
        stored.join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_pos"))
        .drop("_part", "_pos", "_start")
    )


#: keys tried around a position in one scan, rows sampled to find these, and rows few enough to be sorted
CUT_BUCKETS = 8
SAMPLED_ROWS = 10_000
RANKED_ROWS = 100_000


@dataclass
class _Search:
    """Where the key of one position must be: strictly between ``low`` and ``high``, None being open."""

    position: int
    low: tuple | None
    high: tuple | None
    below: int  # rows up to and including ``low``
    held: int  # rows strictly between
    key: tuple | None = None

    def inside(self, keys: DataFrame, order_by: Sequence[str]) -> Column:
        after = ~_compared(keys, order_by, self.low, "<=") if self.low is not None else F.lit(True)
        return after & before_key(keys, order_by, self.high)


def keys_at(df: DataFrame, order_by: Sequence[str], positions: Sequence[int]) -> list[tuple | None]:
    """The order keys of the rows at 0-based ``positions``, None beyond the last row; no row is shuffled.

    Keys of a random sample are tried: one scan counts, for all positions together, the rows before
    and the rows equal to a few sampled keys around each.  Either a key is the one at its position, or
    the search goes on strictly between two of them until few rows are left to sort.  Only comparisons
    of whole keys are made, so columns may be of any type that can be ordered: text, decimals of any
    length, doubles with infinities and NaN (which comes last), nulls (which come first).  Every round
    leaves out at least the keys it tried, and a key that many rows share is tried early.
    """
    order_by = list(order_by)
    keys = df.select(*[col(c) for c in order_by])
    n = keys.count()
    searches = [_Search(p, None, None, 0, n) for p in positions]
    round_ = 0
    while open_ := [s for s in searches if 0 <= s.position < n and s.key is None]:
        for s in open_:
            if s.held <= RANKED_ROWS:
                rows = keys.filter(s.inside(keys, order_by)).orderBy(*[col(c) for c in order_by])
                s.key = tuple(rows.offset(s.position - s.below).limit(1).first())
        open_ = [s for s in open_ if s.key is None]
        if open_:
            round_ += 1
            _narrow(keys, order_by, open_, round_)
    return [s.key for s in searches]


def _narrow(keys: DataFrame, order_by: Sequence[str], searches: list[_Search], seed: int) -> None:
    spans = {}
    for s in searches:
        spans.setdefault((s.low, s.high), s)
    which = F.coalesce(*[F.when(s.inside(keys, order_by), F.lit(i)) for i, s in enumerate(spans.values())])
    inside = keys.withColumn("_span", which).filter("_span IS NOT NULL")
    share = min(1.0, SAMPLED_ROWS * len(spans) / sum(s.held for s in spans.values()))
    while True:
        picked = inside.sample(share, seed).orderBy("_span", *[col(c) for c in order_by]).collect()
        if picked:
            break
        share = min(1.0, share * 10)
    tried = []
    for s in searches:
        own = [tuple(r)[:-1] for r in picked if r["_span"] == list(spans).index((s.low, s.high))]
        if own:
            at = (s.position - s.below) / s.held * len(own)
            reach = max(1.0, len(own) ** 0.5)
            steps = [(2.0 * i / max(1, CUT_BUCKETS - 1) - 1.0) ** 3 * 4 * reach for i in range(CUT_BUCKETS)]
            places = sorted({min(len(own) - 1, max(0, round(at + step))) for step in steps})
            tried.append((s, list(dict.fromkeys(own[i] for i in places))))
    counts = keys.agg(*[
        F.count_if(_compared(keys, order_by, key, how)).alias(f"{how}{i}_{j}")
        for i, (_, own) in enumerate(tried) for j, key in enumerate(own) for how in ("<", "<=")]).first()
    for i, (s, own) in enumerate(tried):
        before, upto = s.below, s.below + s.held
        for j, key in enumerate(own):
            less, with_equal = counts[f"<{i}_{j}"], counts[f"<={i}_{j}"]
            if less <= s.position < with_equal:
                s.key = key
            elif with_equal <= s.position and with_equal >= before:
                s.low, before = key, with_equal
            elif s.position < less < upto:
                s.high, upto = key, less
        s.below, s.held = before, upto - before


def _plain(value):
    """Dates as text: literals of early years are refused."""
    return value.isoformat() if type(value) is date else value


def _compared(df: DataFrame, order_by: Sequence[str], key: tuple, how: str) -> Column:
    place = F.struct(*[col(c) for c in order_by])
    cut = F.struct(*[F.lit(_plain(v)).cast(df.schema[c].dataType).alias(c) for c, v in zip(order_by, key)])
    return place < cut if how == "<" else place <= cut


def before_key(df: DataFrame, order_by: Sequence[str], key: tuple | None) -> Column:
    """True for rows that come before ``key`` in the order; all do where there is no key."""
    return F.lit(True) if key is None else _compared(df, order_by, key, "<")


def row_count(df: DataFrame):
    """The number of rows as a scalar subquery column."""
    return df.agg(F.count("*").alias("n")).scalar()
