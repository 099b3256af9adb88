"""Random splits and class balancing, repeatable from a seed and a row key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..plans.hashed import flag_lowest, flag_lowest_by, hash_text, hash_unit, hex_int
from ..plans.lookup import maybe_broadcast, repeat_rows
from ..plans.names import col
from ..plans.scratch import written
from .neighbours import nearest_neighbours


def random_split(df: DataFrame, key: Sequence[str], test: float = 0.3, seed: int = 42) -> DataFrame:
    """Split with exactly ``ceil(test * n)`` test rows."""
    flagged = flag_lowest(df, key, seed, lambda n, _: F.ceil(n * F.lit(test)), "_test")
    return flagged.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test")


def random_split_by_hash(df: DataFrame, key: Sequence[str], test: float = 0.3, seed: int = 42) -> DataFrame:
    """Split whose sizes hold in expectation: one scan, no count, usable on streams."""
    share = hash_unit(hash_text(seed, *[col(c) for c in key]))
    return df.withColumn("split", F.when(share < test, "test").otherwise("train"))


def undersample(df: DataFrame, label: str, key: Sequence[str], positive=1, negative=0, seed: int = 42) -> DataFrame:
    """All positive rows and as many negative ones, drawn without replacement."""
    kept = df.filter(col(label).isin(positive, negative))
    drawn = flag_lowest(kept, key, seed, lambda _, positives: positives, "_drawn", among=col(label) == F.lit(negative))
    return drawn.filter(F.col("_drawn") | (col(label) == F.lit(positive))).drop("_drawn")


def undersample_and_split(
    df: DataFrame, label: str, key: Sequence[str], positive=1, negative=0, test: float = 0.3, seed: int = 42
) -> DataFrame:
    """Balance the classes, then cut off a test part of the balanced rows.

    The balanced rows, twice the positive ones, are written between the two steps, so the
    source is read three times in all.
    """
    balanced = written(undersample(df, label, key, positive, negative, seed), "balanced")
    return random_split(balanced, key, test, f"{seed}s")


def shuffle_key(df: DataFrame, key: Sequence[str], name: str = "shuffle_key", seed: int = 42) -> DataFrame:
    """A column to order by where rows are wanted in random but repeatable order."""
    return df.withColumn(name, hash_text(seed, *[col(c) for c in key]))


def class_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per class."""
    return df.filter(col(label).isNotNull()).groupBy(col(label)).agg(F.count("*").alias("n"))


def smote(
    df: DataFrame, vector: str, label: str, key: str, k: int = 5, seed: int = 42, block_rows: int = 2048
) -> DataFrame:
    """Grow every smaller class to the size of the largest with points between neighbours.

    Returns ``key, copy, label, vector, synthetic``: the given rows with copy 0 and, for
    each, its share of new points ``x + u * (neighbour - x)``.  The neighbour is one of
    the ``k`` nearest of the same class.  Shares differ by at most one; the rows that
    get one more are drawn by hash, as are neighbour and ``u``.  Every row learns the vectors
    of its ``k`` neighbours before it grows; what has grown is never joined or shuffled.
    """
    points = written(
        df.filter(col(label).isNotNull())
        .select(col(key).alias("key"), col(label).alias("label"), col(vector).cast("array<double>").alias("vector")),
        "smote-points",
    )
    kept = points.select("key", F.lit(0).cast("bigint").alias("copy"), "label", "vector", F.lit(False).alias("synthetic"))
    sizes = written(class_sizes(points, "label"), "smote-classes")
    largest = sizes.agg(F.max("n")).first()[0] or 0
    short = sizes.filter(F.col("n") < largest)
    too_small = short.filter(F.col("n") <= k).orderBy("n").limit(20).collect()
    if too_small:
        names = ", ".join(sorted(str(r["label"]) for r in too_small))
        raise ValueError(f"classes with no more than {k} rows cannot be grown: {names}")
    if short.isEmpty():
        return kept

    missing = F.lit(largest) - F.col("n")
    plan = short.select("label", F.floor(missing / F.col("n")).cast("bigint").alias("each"), (missing % F.col("n")).alias("k"))
    growing = points.join(maybe_broadcast(plan.select("label", "each")), "label")
    shared = flag_lowest_by(growing, ["label"], ["key"], seed, plan.select("label", "k"), "_extra")
    copies = F.col("each") + F.col("_extra").cast("bigint")
    near = nearest_neighbours(growing, "key", "vector", k, group="label", block_rows=block_rows)
    others = points.select(F.col("key").alias("neighbour"), F.col("vector").alias("to"))
    # k vectors per row
    around = near.select("key", "rank", "neighbour").join(others, "neighbour").groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("rank", "to"))).alias("_near"))
    ready = shared.withColumn("_copies", copies).filter("_copies > 0").join(around, "key")
    ready = written(ready.select("key", "label", "vector", "_near", "_copies"), "smote-ready")
    draw = hash_text(seed, F.col("key"), F.col("copy"))
    made = (
        repeat_rows(ready, "_copies", "copy")
        .withColumn("_to", F.get("_near", (hex_int(draw, 1, 8) % k).cast("int")).getField("to"))
        .withColumn("_u", hash_unit(draw, 9))
        .withColumn("vector", F.zip_with("vector", "_to", lambda a, b: a + F.col("_u") * (b - a)))
        .select("key", "copy", "label", "vector", F.lit(True).alias("synthetic"))
    )
    return kept.unionAll(made)
