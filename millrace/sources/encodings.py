"""Text files in unknown encodings.

Lines are read as raw bytes, so large files are split over tasks.  In all listed
encodings a line break is never part of another character, so a whole batch of lines is
decoded at once.  What is known of each file is a table, however many files there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.scratch import written
from ..session import ship_package
from .quotes import leaves_open

# The encodings to try, in this order.
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "big5", "cp936")


def raw_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, at, line``: undecoded lines with the start of the file block they came from."""
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.col("value").cast("binary").alias("line"),
    )


def block_runs(batches: Iterator[pa.RecordBatch]):
    """Runs of lines of one block: ``(path, at, place of the first line in its block, lines)``."""
    block, done = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        paths, starts = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((paths[1:] != paths[:-1]) | (starts[1:] != starts[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            key = (batch.column(0)[a].as_py(), int(starts[a]))
            if key != block:
                block, done = key, 0
            yield *key, done, batch.column(2).slice(a, b - a)
            done += b - a


def valid_mask(data: bytes, encodings: Sequence[str]) -> int:
    """Bit mask of the encodings in which the bytes are valid text."""
    if data.isascii():
        return (1 << len(encodings)) - 1
    mask = 0
    for bit, name in enumerate(encodings):
        try:
            data.decode(name)
        except UnicodeDecodeError:
            continue
        mask |= 1 << bit
    return mask


def survey_files(
    spark: SparkSession, paths: str | Sequence[str], encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """Written table ``path, encoding, header, header_at, header_pos, breaks``: one row per file that is not empty, from one scan.

    ``encoding`` is the first in which all lines are valid, or null; ``header`` holds the bytes of the
    first line that is not blank (null if all are), the next two say where it is, as ``numbered_lines``
    does, and ``breaks`` whether a line leaves a quoted cell open.  A few numbers per block are merged,
    no line is shuffled.
    """
    names = list(encodings)

    def look(batches):
        for path, at, place, lines in block_runs(batches):
            values = lines.to_pylist()
            first = next((i for i, v in enumerate(values) if v.strip()), None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([valid_mask(b"\n".join(values), names)], pa.int32()), pa.array([at], pa.int64()),
                 pa.array([None if first is None else place + first], pa.int64()),
                 pa.array([None if first is None else values[first]], pa.binary()),
                 pa.array([any(map(leaves_open, values))], pa.bool_())],
                names=["path", "mask", "at", "pos", "header", "breaks"])

    ship_package(spark)
    seen = raw_lines(spark, paths).mapInArrow(look, "path string, mask int, at bigint, pos bigint, header binary, breaks boolean")
    found_at = F.min(F.when(F.col("header").isNotNull(), F.struct("at", "pos", "header"))).alias("first")
    files = seen.groupBy("path").agg(F.bit_and("mask").alias("mask"), found_at, F.bool_or("breaks").alias("breaks"))
    found = F.lit(None).cast("string")
    for bit in reversed(range(len(names))):
        found = F.when(F.getbit("mask", F.lit(bit)) == 1, F.lit(names[bit])).otherwise(found)
    return written(files.select(
        "path", found.alias("encoding"), "first.header", F.col("first.at").alias("header_at"), F.col("first.pos").alias("header_pos"),
        "breaks"), "files")


def detect_encodings(
    spark: SparkSession, paths: str | Sequence[str], encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """``path, encoding``: the first encoding in which all lines of a file are valid, or null."""
    return survey_files(spark, paths, encodings).select("path", "encoding")


def left_out(files: DataFrame) -> DataFrame:
    """``path, reason`` of the surveyed files that cannot be read."""
    return files.filter("encoding IS NULL").select("path", F.lit("no listed encoding fits").alias("reason"))


def decoded(line: Column, encoding: Column) -> Column:
    """Text of raw bytes in the encoding named beside them; UTF-8 stays on the JVM."""

    @F.pandas_udf("string")
    def decode(lines: pd.Series, names: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(lines), dtype=object)
        there = lines.notna() & names.notna()
        for name in names[there].unique():
            at = np.flatnonzero(there & (names == name))
            out.iloc[at] = b"\n".join(lines.iloc[at]).decode(name).split("\n")
        return out

    plain = encoding == "utf-8"
    return F.when(plain, line.cast("string")).otherwise(decode(F.when(~plain, line), F.when(~plain, encoding)))


def numbered_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, at, pos, line``: ``pos`` counts the lines of a block, so the three name a line."""

    def number(batches):
        for path, at, place, lines in block_runs(batches):
            n = len(lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path] * n, pa.string()), pa.array([at] * n, pa.int64()),
                 pa.array(range(place, place + n), pa.int64()), lines], names=["path", "at", "pos", "line"])

    ship_package(spark)
    return raw_lines(spark, paths).mapInArrow(number, "path string, at bigint, pos bigint, line binary")


def decode_files(
    spark: SparkSession, paths: str | Sequence[str], encodings: Sequence[str] = ENCODINGS
) -> DataFrame:
    """``path, at, line`` with all lines as text, each file in the encoding found for it.

    Files that fit no listed encoding are left out (``left_out`` of ``survey_files`` lists
    them); it is an error if nothing is left.
    """
    files = survey_files(spark, paths, encodings).filter("encoding IS NOT NULL")
    if files.isEmpty():
        raise ValueError("no file could be read")
    lines = numbered_lines(spark, paths).join(files.select("path", "encoding"), "path")
    return lines.select("path", "at", decoded(F.col("line"), F.col("encoding")).alias("line"))
