"""Choosing rows in a random-looking but repeatable order.

Rows are ordered by the md5 of a seed and a key.  The k-th smallest hash is found
by counting hash buckets, then ranking only the one bucket that holds it; all other
rows are just compared with it.  No raw row is shuffled for that and the result
does not depend on partitioning.  The key must identify a row: rows that share one
share their hash and could not be told apart.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lookup import MAX_SMALL_ROWS, one_row
from .names import col

BUCKET_HEX_DIGITS = 5  # 2**20 buckets: 10**12 rows leave about 10**6 in one


def hash_text(seed: int | str, *keys: Column) -> Column:
    """md5 of ``seed:key:...`` as hex text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def hex_int(text: Column, start: int, digits: int) -> Column:
    """Some hex digits of a hash as a bigint."""
    return F.conv(F.substring(text, start, digits), 16, 10).cast("bigint")


def hash_unit(text: Column, start: int = 1) -> Column:
    """Eight hex digits of a hash as a number in [0, 1)."""
    return hex_int(text, start, 8) / F.lit(4294967296.0)


def _with_hash(df: DataFrame, key: Sequence[str], seed) -> DataFrame:
    hashed = df.withColumn("_h", hash_text(seed, *[col(c) for c in key]))
    return hashed.withColumn("_b", hex_int(F.col("_h"), 1, BUCKET_HEX_DIGITS))


def flag_lowest(
    df: DataFrame, key: Sequence[str], seed, quota: Callable[[Column, Column], Column], name: str,
    among: Column | None = None,
) -> DataFrame:
    """Flag the rows of ``among`` (or all) with the smallest hashes.

    ``quota`` gives their number from the number of rows in ``among`` and of all others,
    which the counted buckets tell as well: the table is read once to count, once to
    rank the bucket at the edge, and once for the result.
    """
    inside = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    hashed = _with_hash(df, key, seed).withColumn("_in", inside)
    running = Window.partitionBy("_in").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(F.lit(0))
    buckets = (
        # at most two rows per bucket
        hashed.groupBy("_in", "_b").agg(F.count("*").alias("_n"))
        .withColumn("_cum", F.sum("_n").over(running))
        .withColumn("_ins", F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0)).over(total))
        .withColumn("_outs", F.sum(F.when(F.col("_in"), 0).otherwise(F.col("_n"))).over(total))
        .withColumn("_k", F.least(quota(F.col("_ins"), F.col("_outs")).cast("bigint"), F.col("_ins")))
        .filter(F.col("_in") & (F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .select("_b", (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_r"))
    )
    edge = one_row(buckets)
    place = [F.col("_h"), *[col(c) for c in key]]
    last = (
        hashed.filter(F.col("_in") & (F.col("_b") == edge.getField("_b")))
        .withColumn("_rn", F.row_number().over(Window.orderBy(*place)))
        .filter(F.col("_rn") == edge.getField("_r"))
        .select(F.struct(*place).alias("cut"))
    )
    flag = F.col("_in") & F.coalesce(F.struct(*place) <= last.scalar(), F.lit(False))
    return hashed.withColumn(name, flag).drop("_h", "_b", "_in")


def flag_lowest_by(
    df: DataFrame, groups: Sequence[str], key: Sequence[str], seed, quota: DataFrame, name: str
) -> DataFrame:
    """As ``flag_lowest`` in every group; ``quota`` has the groups and a column ``k``, one row per group."""
    groups = list(groups)
    few = quota.limit(MAX_SMALL_ROWS + 1).count() <= MAX_SMALL_ROWS
    hint = F.broadcast if few else (lambda frame: frame)  # edges and cuts: one row per group at most
    hashed = _with_hash(df, key, seed)
    by_bucket = Window.partitionBy(*groups).orderBy("_b")
    running = by_bucket.rowsBetween(Window.unboundedPreceding, 0)
    everything = by_bucket.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = (
        hashed.groupBy(*groups, "_b").agg(F.count("*").alias("_n")).join(hint(quota), groups)
        .withColumn("_cum", F.sum("_n").over(running))
        .withColumn("_k", F.least(F.col("k"), F.sum("_n").over(everything)))
        .filter((F.col("_cum") - F.col("_n") < F.col("_k")) & (F.col("_k") <= F.col("_cum")))
        .select(*groups, F.col("_b").alias("_eb"), (F.col("_k") - F.col("_cum") + F.col("_n")).alias("_r"))
    )
    place = [F.col("_h"), *[col(c) for c in key]]
    cuts = (
        hashed.join(hint(edges), groups)
        .filter(F.col("_b") == F.col("_eb"))
        .withColumn("_rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*place)))
        .filter(F.col("_rn") == F.col("_r"))
        .select(*groups, F.struct(*place).alias("_cut"))
    )
    return (
        hashed.join(hint(cuts), groups, "left")
        .withColumn(name, F.coalesce(F.struct(*place) <= F.col("_cut"), F.lit(False)))
        .drop("_h", "_b", "_cut")
    )
