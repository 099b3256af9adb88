"""Bringing small results to every row without a join on unbounded data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .names import col

MAX_SMALL_ROWS = 10_000


def one_row(row: DataFrame) -> Column:
    """The single row of ``row`` as a struct literal (scalar subquery).

    Spark evaluates it once and fails if there is more than one row, so its size
    is bounded by construction and no join is planned.
    """
    return row.select(F.struct(*[col(c) for c in row.columns]).alias("row")).scalar()


def attach_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, one_row(row))


def _literal(value, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(None if value is None else value[f.name], f.dataType).alias(f.name) for f in kind])
    return F.lit(value).cast(kind)


def attach_values(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """As ``attach_row`` with the row computed now and written into the plan as constants.

    Used where the row took jobs of its own anyway: comparisons with constants reach
    the file scan.
    """
    return df.withColumn(name, _literal(row.first(), row.schema))


def checked_small(df: DataFrame, limit: int = MAX_SMALL_ROWS, what: str = "table") -> DataFrame:
    """A driver-built copy of a table proven to have at most ``limit`` rows."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what} has more than {limit} rows and must not be broadcast")
    return df.sparkSession.createDataFrame(rows, df.schema)


def maybe_broadcast(df: DataFrame, limit: int = MAX_SMALL_ROWS) -> DataFrame:
    """A table with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    rows = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= limit else df


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Broadcast join with a table that ``checked_small`` returned."""
    return df.join(F.broadcast(small), list(on), how)


SALT_ROWS = 100_000
REPEAT_PIECE = 10_000


def salts_for(copies: Column, rows: int = SALT_ROWS) -> Column:
    """How many tasks the rows of one key are dealt out to."""
    return F.ceil(copies / F.lit(rows)).cast("int")


def salted_semi_join(
    df: DataFrame, keys: DataFrame, on: Sequence[str], spread_by: Sequence[str], copies: str, rows: int = SALT_ROWS
) -> DataFrame:
    """Null-safe semi join that deals the rows of a hot key out to as many tasks as it fills.

    ``keys`` holds each key once with the number of its rows in ``copies``; only keys of more
    than ``rows`` rows are dealt out, and these are few: their rows are told apart by
    ``spread_by``, columns that differ between rows of one key.  The others join as usual.
    """
    hot = keys.filter(col(copies) > rows)
    few = hot.limit(MAX_SMALL_ROWS + 1).count()
    named = [col(c).alias(f"_k{i}") for i, c in enumerate(on)]

    def same(i: int, c: str) -> Column:
        return col(c).eqNullSafe(F.col(f"_k{i}"))

    if not few:
        return df.join(keys.select(*named), _all([same(i, c) for i, c in enumerate(on)]), "left_semi")
    # rows learn the number of salts of their key where it is hot; then both sides carry a salt
    counted = hot.select(*named, salts_for(col(copies), rows).alias("_salts"))
    counted = F.broadcast(counted) if few <= MAX_SMALL_ROWS else counted
    salted = df.join(counted, _all([same(i, c) for i, c in enumerate(on)]), "left").drop(*[f"_k{i}" for i in range(len(on))])
    salt = F.pmod(F.xxhash64(*[col(c) for c in spread_by]), F.coalesce("_salts", F.lit(1))).cast("int")
    spread = keys.select(*named, F.explode(F.sequence(F.lit(0), salts_for(col(copies), rows) - 1)).alias("_ksalt"))
    matches = [F.col("_salt") == F.col("_ksalt"), *[same(i, c) for i, c in enumerate(on)]]
    return salted.withColumn("_salt", salt).join(spread, _all(matches), "left_semi").drop("_salt", "_salts")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for more in conditions[1:]:
        out = out & more
    return out


def repeat_rows(df: DataFrame, copies: str, number: str = "_copy", piece: int = REPEAT_PIECE) -> DataFrame:
    """Each row as often as ``copies`` says, numbered from 1 in ``number``.

    Rows are first repeated piece by piece, the pieces dealt out to all tasks, and each
    piece filled there: no task makes more than its share, no array is longer than a piece.
    """
    pieces = F.sequence(F.lit(0).cast("bigint"), F.floor((col(copies) - 1) / piece))
    # two levels of pieces keep the array of piece numbers short, too
    outer = F.sequence(F.lit(0).cast("bigint"), F.floor((col(copies) - 1) / (piece * piece)))
    inner = F.filter(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(piece - 1).cast("bigint")), lambda i: F.col("_outer") * piece + i),
        lambda p: p * piece < col(copies))
    large = col(copies) > piece
    tall = (
        df.filter(large).withColumn("_outer", F.explode(outer)).withColumn("_piece", F.explode(inner)).drop("_outer")
        .repartition(F.xxhash64("_piece", *[col(c) for c in df.columns]))
    )
    flat = df.filter(~large).withColumn("_piece", F.explode(pieces))
    first = F.col("_piece") * piece + 1
    last = F.least(first + piece - 1, col(copies).cast("bigint"))
    return tall.unionByName(flat).withColumn(number, F.explode(F.sequence(first, last))).drop("_piece", copies)
