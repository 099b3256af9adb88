"""CSV records that span lines.

A quoted cell may hold line breaks, so where a line stands depends on all lines before it.  It
depends on them by one bit only: whether a quoted cell is open.  Each block of a file is read
for both values of that bit at once; one row per block then tells which of the two was true.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..plans.scratch import written
from ..session import ship_package
from .encodings import block_runs, decoded, raw_lines
from .quotes import leaves_open


def _both_ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside, first = [False, True], [-1, -1]
    for path, at, place, lines in block_runs(batches):
        if place == 0:
            inside, first = [False, True], [-1, -1]
        starts, opens = ([], []), ([], [])
        for pos, line in enumerate(lines.to_pylist(), place):
            for way in (0, 1):
                if not inside[way]:
                    first[way] = pos
                inside[way] = leaves_open(line, inside[way])
                starts[way].append(first[way])
                opens[way].append(inside[way])
        n = len(lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()),
             pa.array(range(place, place + n), pa.int64()), lines,
             *[pa.array(s, pa.int64()) for s in starts], *[pa.array(o, pa.bool_()) for o in opens]],
            names=["path", "at", "pos", "line", "start_0", "start_1", "open_0", "open_1"])


def lines_both_ways(spark: SparkSession, paths: str) -> DataFrame:
    """``path, at, pos, line`` of every line, with the place of the first line of its record (-1: before the block)
    and whether it leaves a cell open, for a block that begins outside (``_0``) and inside (``_1``) of a quoted cell."""
    ship_package(spark)
    return raw_lines(spark, paths).mapInArrow(
        _both_ways, "path string, at bigint, pos bigint, line binary, start_0 bigint, start_1 bigint, open_0 boolean, open_1 boolean")


def block_states(lines: DataFrame) -> DataFrame:
    """``path, at, inside, ends_inside, carry_at, carry_pos``: how each block begins and ends, and where the record began
    that is open at its start.

    A block maps the bit to itself, to its opposite or to a constant; the bit at a block is the last constant
    before it, turned as often as blocks since then turn it.  The window holds one row per block of a file.
    """
    blocks = lines.groupBy("path", "at").agg(
        F.max_by("open_0", "pos").alias("end_0"), F.max_by("open_1", "pos").alias("end_1"),
        F.max("start_0").alias("last_0"), F.max("start_1").alias("last_1"))
    so_far = Window.partitionBy("path").orderBy("at")
    before = so_far.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.when(F.expr("end_0 AND NOT end_1"), 1).otherwise(0)
    blocks = blocks.withColumn("turns", F.sum(turns).over(so_far)).withColumn("turn", turns)
    fixed = F.when(F.expr("end_0 = end_1"), F.struct(F.col("end_0").cast("int").alias("bit"), "turns"))
    blocks = blocks.withColumn("fixed", F.last(fixed, ignorenulls=True).over(before))
    bit = F.coalesce("fixed.bit", F.lit(0)) + F.col("turns") - F.col("turn") - F.coalesce("fixed.turns", F.lit(0))
    blocks = blocks.withColumn("inside", bit % 2 == 1)
    last = F.when(F.col("inside"), F.col("last_1")).otherwise(F.col("last_0"))
    carry = F.last(F.when(last >= 0, F.struct("at", last.alias("pos"))), ignorenulls=True).over(before)
    return blocks.withColumn("carry", carry).select(
        "path", "at", "inside", F.when(F.col("inside"), F.col("end_1")).otherwise(F.col("end_0")).alias("ends_inside"),
        F.col("carry.at").alias("carry_at"), F.col("carry.pos").alias("carry_pos"))


def unclosed_files(states: DataFrame) -> DataFrame:
    """``path`` of the files that end inside a quoted cell."""
    return states.groupBy("path").agg(F.max_by("ends_inside", "at").alias("open")).filter("open").select("path")


def joined_records(spark: SparkSession, paths: str, files: DataFrame) -> DataFrame:
    """``path, at, pos, line`` and the columns of ``files (path, encoding, ...)``: the records of those files as text.

    A record that spans lines holds them with ``\\n`` between, at the place of its first line.  Only these records
    are shuffled.  Files that end inside a quoted cell are left out.
    """
    lines = written(lines_both_ways(spark, paths).join(files.select("path"), "path", "left_semi"), "csv-lines")
    states = written(block_states(lines), "csv-blocks")
    lines = lines.join(states, ["path", "at"]).join(unclosed_files(states), "path", "left_anti").join(files, "path")

    def pick(name: str) -> Column:
        return F.when(F.col("inside"), F.col(f"{name}_1")).otherwise(F.col(f"{name}_0"))

    others = [c for c in files.columns if c != "path"]
    lines = lines.select(
        "path", "at", "pos", decoded(F.col("line"), F.col("encoding")).alias("line"), *others,
        pick("start").alias("start"), pick("open").alias("open"), "carry_at", "carry_pos")
    alone = F.expr("start = pos AND NOT open")
    names = ["path", "at", "pos", "line", *others]
    parts = lines.filter(~alone).select(
        "path", F.when(F.col("start") >= 0, F.col("at")).otherwise(F.col("carry_at")).alias("first_at"),
        F.when(F.col("start") >= 0, F.col("start")).otherwise(F.col("carry_pos")).alias("first_pos"),
        F.struct("at", "pos", "line").alias("part"), *others)
    whole = parts.groupBy("path", F.col("first_at").alias("at"), F.col("first_pos").alias("pos")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n").alias("line"),
        *[F.first(c).alias(c) for c in others])
    return lines.filter(alone).select(*names).unionByName(whole.select(*names))
