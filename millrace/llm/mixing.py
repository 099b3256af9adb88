"""Mixing sources to target weights by Pfair scheduling.

The rows of a source are cut into blocks of equal size.  Block ``i`` (from 1) of a source of
weight ``w`` is released at slot ``floor((i - 1) / w)`` and due at ``ceil(i / w)``; taking the
earliest deadline among the released blocks, one block per slot, keeps every source less
than one block away from ``w * t`` at every slot ``t``.  Weights are exact fractions, so no
target is rounded to a period and the schedule does not repeat: it is made slot by slot until a
source runs out.  That is one step of a few numbers per
block, in one task that holds a few numbers per source; there are at most ``MAX_BLOCKS``
blocks, which grow where the given size would make more.  Numbering the rows and joining
them with the schedule are distributed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from math import ceil, lcm, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, null_safe_key, prepared, written

MAX_BLOCKS = 1 << 22
BUCKET_ROWS = 10_000
MIN_BUCKETS = 256
#: rows of one batch of the schedule
BATCH = 50_000
#: where a weight is so small that a deadline is beyond this slot, it is this slot
LAST_SLOT = 9e18


def whole_units(weights: Sequence[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights, which are taken as the decimals that they are written as."""
    exact = [Fraction(str(w)) if w > 0 else Fraction(0) for w in weights]
    common = lcm(*(x.denominator for x in exact))
    return [int(x * common) for x in exact]


def earliest_deadlines(units: Sequence[int], blocks: Sequence[int]) -> Iterator[int]:
    """The source of slot 0, 1, ...; ends before the first slot whose source has run out of blocks."""
    total, given = sum(units), [0] * len(units)
    waiting = [(0, s) for s, u in enumerate(units) if u > 0]  # release, source
    ready: list[tuple[int, int]] = []  # deadline, source
    t = 0
    while waiting or ready:
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(given[s] + 1) * total // units[s]), s))
        _, s = heapq.heappop(ready)
        if given[s] == blocks[s]:
            return
        yield s
        given[s] += 1
        heapq.heappush(waiting, (given[s] * total // units[s], s))
        t += 1


def _schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``src, block, slot, weight`` of every slot, and a row without block for every source."""
    sources = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["src"])
    names, units = [r["src"] for r in sources], whole_units([r["weight"] for r in sources])
    weights = [u / sum(units) for u in units]
    given, slot = [0] * len(sources), 0
    rows: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64()))],
            names=["src", "block", "slot", "weight"])

    for slot, s in enumerate(earliest_deadlines(units, [r["blocks"] for r in sources]), 1):
        rows.append((names[s], given[s], slot - 1, weights[s]))
        given[s] += 1
        if len(rows) == BATCH:
            yield batch()
            rows = []
    rows += [(name, None, slot, w) for name, w in zip(names, weights) if w > 0]
    if rows:
        yield batch()


def source_weights(sizes: DataFrame, weights: Mapping[str | None, float] | None, power: float) -> Column:
    """Target weight of each row of ``sizes (src, n)``: as given, 0 where not named, or the size to ``power``."""
    if weights is None:
        return F.pow(F.col("n").cast("double"), F.lit(power))
    found = F.lit(0.0)
    for s, w in weights.items():
        found = F.when(F.col("src") == ("null" if s is None else f"={s}"), float(w)).otherwise(found)
    return found


def mixing_rows(
    docs: DataFrame, seed: int, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Written table ``doc_id, source, src, size, h, rid``: what the schedule needs of each row.

    Rows that share an id are spread by their texts.
    """
    size = F.coalesce(F.octet_length(col(text_col)), F.lit(0)) + 1  # an empty text takes a place too
    return written(docs.select(
        col(id_col).alias("doc_id"), col(source_col).alias("source"), null_safe_key(col(source_col)).alias("src"),
        size.cast("bigint").alias("size"), F.xxhash64(F.lit(seed), col(id_col).cast("string"), col(text_col)).alias("h"),
        F.monotonically_increasing_id().alias("rid")), "mixing-rows")


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = 0.5, block_bytes: int = 1 << 16,
    seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, block, slot, place, weight, within``.

    ``weights`` gives the target weight of each source (null is a source too), for a handful
    of sources; without it the weights are the sizes of the sources to ``power``.  Rows of a
    source are shuffled by a seeded hash of id and text and cut into blocks of ``block_bytes``
    UTF-8 bytes (more where that makes over ``MAX_BLOCKS`` blocks), one more per row; a row
    belongs to the block in which it starts.  Reading rows by ``slot, source, place`` gives
    the mixture.  ``within`` is true before the first slot whose source has run out: up to
    there every source is less than one block from its target ``weight``, a share of all.  No row
    is dropped: later blocks come in the order of their deadlines, several to a slot.  A
    source without weight has no slot: null, and ``within`` false.  Null ids and repeated
    rows have a place each; an empty table gives no rows.
    """
    spark = prepared(docs.sparkSession)
    rows = mixing_rows(docs, seed, id_col, text_col, source_col)
    sizes = written(rows.groupBy("src").agg(F.sum("size").alias("n")), "source-sizes")
    n_rows, n_bytes = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(block_bytes, -(-n_bytes // MAX_BLOCKS))
    wanted = sizes.select("src", F.ceil(F.col("n") / block).cast("bigint").alias("blocks"),
                          source_weights(sizes, weights, power).alias("weight"))
    schedule = written(wanted.filter("weight > 0").repartition(1).mapInArrow(
        _schedule, "src string, block bigint, slot bigint, weight double"), "schedule")

    buckets = max(MIN_BUCKETS, 1 << ceil(log2(max(1, n_rows / BUCKET_ROWS))))
    placed = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - int(log2(buckets))))
    running = Window.partitionBy("src", "bucket").orderBy("h", "rid").rowsBetween(
        Window.unboundedPreceding, -1)
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # one row per source and bucket: a ten-thousandth of the rows
    starts = placed.groupBy("src", "bucket").agg(F.sum("size").alias("_n")).select(
        "src", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("start"))
    placed = (
        placed.withColumn("inner", F.coalesce(F.sum("size").over(running), F.lit(0)))
        .join(starts, ["src", "bucket"]).withColumn("place", F.col("start") + F.col("inner"))
        .withColumn("block", F.floor(F.col("place") / block).cast("bigint"))
    )
    # weights: one row per source; slots: one row per block
    shares = schedule.filter("block IS NULL").select("src", "weight", F.col("slot").alias("horizon"))
    slots = schedule.filter("block IS NOT NULL").select("src", "block", "slot")
    due = F.least(F.ceil((F.col("block") + 1) / F.col("weight")).cast("double") - 1, F.lit(LAST_SLOT)).cast("bigint")
    return placed.join(shares, "src", "left").join(slots, ["src", "block"], "left").select(
        "doc_id", "source", "block", F.coalesce("slot", F.when(F.col("weight").isNotNull(), F.greatest("horizon", due))).alias("slot"), "place", "weight",
        F.col("slot").isNotNull().alias("within"))
