"""Calendar resampling, sliding windows, time and wind features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.features import DAY_SECONDS, YEAR_SECONDS, cycle, epoch_seconds, polar
from ..plans.names import col

# Bucket start and label of each frequency.
_UNITS = {"H": "hour", "D": "day", "W": "week"}
_STEPS = {"H": "INTERVAL 1 HOUR", "D": "INTERVAL 1 DAY", "W": "INTERVAL 7 DAYS"}
AGGREGATIONS = ("mean", "sum", "max", "min", "first", "last")

WINDOW_CHUNK_ROWS = 100_000


def _aggregate(value: Column, how: str, order: Column) -> Column:
    if how == "mean":
        return F.avg(value)
    if how == "sum":
        return F.sum(value)
    if how == "max":
        return F.max(value)
    if how == "min":
        return F.min(value)
    # an ordering that is null for a null value makes the row invisible
    seen = F.when(value.isNotNull(), order)
    if how == "first":
        return F.min_by(value, seen)
    if how == "last":
        return F.max_by(value, seen)
    raise ValueError(f"aggregation must be one of {', '.join(AGGREGATIONS)}")


def bucket_start(ts: Column, freq: str) -> Column:
    return F.date_trunc(_UNITS[freq], ts.cast("timestamp"))


def resample(
    df: DataFrame,
    time: str,
    values: Sequence[str] | Mapping[str, tuple[str, str]],
    freq: str = "H",
    how: str = "mean",
    keys: Sequence[str] = (),
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """One row per calendar bucket and key, buckets without rows included.

    Empty buckets hold null, or 0 for sums.  ``first`` and ``last`` skip nulls and
    follow ``time`` and then ``tie_break``.  A week starts on Monday and carries the
    date of its Sunday.  Rows are merged to buckets before the shuffle; the gaps are
    found on the buckets, never on rows.  ``values`` may map names of the result to
    ``(column, aggregate)``: all are made in one pass.
    """
    if time not in df.columns:
        raise ValueError(f"no time column {time}")
    wanted = dict(values) if isinstance(values, Mapping) else {c: (c, how) for c in values}
    order = F.struct(col(time), *[col(c) for c in tie_break])
    buckets = (
        df.withColumn("_bucket", bucket_start(col(time), freq)).filter(F.col("_bucket").isNotNull())
        .groupBy(*keys, "_bucket").agg(*[_aggregate(col(c), h, order).alias(name) for name, (c, h) in wanted.items()])
    )
    step = F.expr(_STEPS[freq])
    following = F.lead("_bucket").over(Window.partitionBy(*keys).orderBy("_bucket"))
    spread = (
        buckets.withColumn("_next", following)
        .withColumn("_at", F.explode(F.sequence(
            "_bucket", F.coalesce(F.col("_next") - step, F.col("_bucket")), step)))
    )
    real = F.col("_at") == F.col("_bucket")

    def filled(c: str) -> Column:
        value = F.when(real, col(c))
        return F.coalesce(value, F.lit(0)) if wanted[c][1] == "sum" else value

    shown = F.col("_at") + F.expr("INTERVAL 6 DAYS") if freq == "W" else F.col("_at")
    return spread.select(
        *[col(k) for k in keys], shown.cast("timestamp_ntz").alias(time), *[filled(c).alias(c) for c in wanted]
    )


def sliding_windows(
    indexed: DataFrame,
    columns: Sequence[str],
    label_columns: Sequence[str] | None = None,
    input_width: int = 6,
    label_width: int = 5,
    shift: int = 24,
    within: Sequence[str] = (),
    index: str = "row_idx",
    chunk_rows: int = WINDOW_CHUNK_ROWS,
) -> DataFrame:
    """All windows of ``input_width + shift`` consecutive rows, one per start.

    ``indexed`` comes from ``row_index``.  Returns ``within, start_idx, inputs,
    labels``: the first ``input_width`` and the last ``label_width`` rows as arrays of
    structs.  Windows never cross from one ``within`` group (a split, a series) to the
    next; order the index by those columns first.  Rows are cut into chunks by
    position and the head of each chunk is repeated in the one before, so tasks are
    of equal size even if one series holds most rows.
    """
    labels = list(columns if label_columns is None else label_columns)
    total = input_width + shift
    if chunk_rows < total:
        raise ValueError("a chunk must hold at least one window")
    offset = col(index) % chunk_rows
    chunk = col(index) - offset  # a chunk is named by the position of its first row
    places = F.when((offset < total - 1) & (chunk > 0), F.array(chunk, chunk - chunk_rows)).otherwise(F.array(chunk))
    needed = list(dict.fromkeys([*within, index, *columns, *labels]))
    rows = indexed.select(*[col(c) for c in needed], F.explode(places).alias("_chunk"))
    span = Window.partitionBy(*within, "_chunk").orderBy(col(index))

    def taken(names: Sequence[str], first: int, last: int) -> Column:
        cells = F.struct(*[col(c).alias(c) for c in names])
        return F.collect_list(cells).over(span.rowsBetween(first, last))

    return (
        rows.withColumn("inputs", taken(columns, 0, input_width - 1))
        .withColumn("labels", taken(labels, total - label_width, total - 1))
        .filter((chunk == F.col("_chunk")) & (F.size("labels") == label_width))
        .select(*[col(c) for c in within], col(index).alias("start_idx"), "inputs", "labels")
    )


def window_layout(df: DataFrame, input_width: int = 6, label_width: int = 5, shift: int = 24) -> DataFrame:
    """One row: window size and the positions of inputs and labels inside it."""
    total = input_width + shift
    return df.sparkSession.range(1).select(
        F.lit(total).alias("total"),
        F.sequence(F.lit(0), F.lit(input_width - 1)).alias("input_idx"),
        F.sequence(F.lit(total - label_width), F.lit(total - 1)).alias("label_idx"),
    )


def window_series(
    windows: DataFrame, column: str, input_width: int = 6, label_width: int = 5, shift: int = 24,
    predictions: str | None = None,
) -> DataFrame:
    """Windows of one column in long form: ``start_idx, step, kind, value``."""
    first_label = input_width + shift - label_width

    def part(source: str, kind: str, first_step: int) -> DataFrame:
        cells = F.transform(col(source), lambda row: row.getField(column))
        return windows.select("start_idx", F.posexplode(cells).alias("_pos", "value")).select(
            "start_idx", (F.col("_pos") + first_step).alias("step"), F.lit(kind).alias("kind"), "value"
        )

    series = part("inputs", "input", 0)
    if column in windows.schema["labels"].dataType.elementType.names:
        series = series.unionAll(part("labels", "label", first_label))
    if predictions:
        series = series.unionAll(part(predictions, "prediction", first_label))
    return series


def example_windows(windows: DataFrame, n: int = 32) -> DataFrame:
    """A fixed small batch: the first ``n`` windows, kept in memory once computed."""
    return windows.orderBy("start_idx").limit(n).cache()


def cyclic_time(df: DataFrame, time: str) -> DataFrame:
    """Replace the time column by its place in the day and in the year."""
    seconds = epoch_seconds(col(time))
    day_sin, day_cos = cycle(seconds, DAY_SECONDS)
    year_sin, year_cos = cycle(seconds, YEAR_SECONDS)
    return df.withColumns(
        {"Day sin": day_sin, "Day cos": day_cos, "Year sin": year_sin, "Year cos": year_cos}
    ).drop(time)


def polar_to_xy(df: DataFrame, vectors: Mapping[str, tuple[str, str]], angle: str) -> DataFrame:
    """Replace magnitudes and their common angle in degrees by x and y parts.

    ``vectors`` maps each magnitude column to the names of its parts.
    """
    parts = {}
    for magnitude, names in vectors.items():
        parts.update(zip(names, polar(col(magnitude), col(angle))))
    return df.withColumns(parts).drop(*vectors, angle)


def wind_vectors(df: DataFrame) -> DataFrame:
    """Mean and maximum wind as vectors."""
    return polar_to_xy(df, {"wv": ("Wx", "Wy"), "max. wv": ("max Wx", "max Wy")}, "wd")

