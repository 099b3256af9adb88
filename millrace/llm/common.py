"""Small helpers the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.names import col
from ..plans.scratch import new_path, written
from ..session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: text that one step of a Python worker works on, and the most that Spark hands it at once
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

__all__ = [
    "UPPER", "LOWER", "ascii_lower", "col", "new_path", "null_safe_key", "only", "prepared", "shuffle_partitions", "slices",
    "written",
]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  Where all characters are one byte, ``lower`` does the same and is faster."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def prepared(spark: SparkSession) -> SparkSession:
    """Make this package known to the executors' Python, and bound the batches sent there by bytes."""
    if int(spark.conf.get(BATCH_SETTING).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return ship_package(spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def null_safe_key(value: Column) -> Column:
    """Text that differs for null and for every value, to group or join on."""
    return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), value.cast("string")))


def slices(batches: Iterator[pa.RecordBatch], sized: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts in one piece hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(sized))
        start = filled = 0
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            n = n or 0
            if filled and filled + n > limit:
                yield batch.slice(start, i - start)
                start, filled = i, 0
            filled += n
        if start < batch.num_rows:
            yield batch.slice(start)


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns; whatever else the table has cannot clash with columns made later."""
    return df.select(*[col(c) for c in names])
