"""CSV files in, tables and reports out, models both ways."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..plans.names import col
from ..plans.ranking import row_index
from ..plans.scratch import written
from .encodings import ENCODINGS, decoded, left_out, numbered_lines, survey_files
from .quotes import leaves_open
from .records import block_states, joined_records, lines_both_ways, unclosed_files

_DOUBLED = {"escape": '"'}  # quotes inside quoted cells are doubled


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One CSV file or folder with a header row, in UTF-8, each row on one line; ``read_csv_files`` reads line breaks in cells."""
    reader = spark.read.options(header=True, **_DOUBLED)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def _header_names(header: str) -> list[str]:
    return next(csv.reader([header]))


def _parsed(line: Column, header: Column, layouts: Sequence[str]) -> Column:
    """The cells of a line as a struct of text columns: those of all layouts, null where a file has none."""
    names = list(dict.fromkeys(n for h in layouts for n in _header_names(h)))
    parsed = F.lit(None)
    for h in layouts:
        own = _header_names(h)
        cells = F.from_csv(line, ", ".join(f"c{i} string" for i in range(len(own))), _DOUBLED)
        place = {n: i for i, n in reversed(list(enumerate(own)))}
        row = F.struct(*[
            (cells.getField(f"c{place[n]}") if n in place else F.lit(None).cast("string")).alias(n) for n in names])
        parsed = F.when(header == h, row).otherwise(parsed)
    return parsed


_KINDS = {
    "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
    "string": T.StringType(),
}


def _inferred(table: DataFrame, columns: Sequence[str]) -> T.StructType:
    """Types that all texts of a column fit: bigint, double, boolean, timestamp, else string."""
    fits = {
        "bigint": lambda c: c.rlike(r"^[+-]?[0-9]{1,19}$") & c.try_cast("bigint").isNotNull(),
        "double": lambda c: c.try_cast("double").isNotNull(),
        "boolean": lambda c: F.lower(c).isin("true", "false"),
        "timestamp_ntz": lambda c: c.try_cast("timestamp_ntz").isNotNull(),
    }
    seen = table.agg(*[
        F.bool_and(F.when(col(c).isNotNull(), test(F.trim(col(c))))).alias(f"{kind}{i}")
        for i, c in enumerate(columns) for kind, test in fits.items()
    ]).first()
    schema = T.StructType()
    for i, c in enumerate(columns):
        kind = next((k for k in fits if seen[f"{k}{i}"]), "string")
        schema.add(c, _KINDS[kind])
    return schema


def read_csv_files(
    spark: SparkSession, pattern: str, encodings: Sequence[str] = ENCODINGS, row_id: str | None = "row_id",
    schema: T.StructType | None = None,
) -> DataFrame:
    """All CSV files that match a pattern as one table, columns matched by name.

    One scan finds the encoding and the header of every file, a second one reads all files
    whatever their encodings and headers.  Columns that a file lacks are null, and the first
    line of each file that is not blank is its header, no other.  Empty and blank files are skipped, and so are files in
    no listed encoding (``unreadable_files`` lists them); it is an error if nothing is
    left.  ``schema`` types the columns it names, the others stay text; without it types
    are found on the texts that were read.  ``row_id`` numbers the rows by file and place.
    Quoted cells may hold line breaks, which become ``\\n``; quotes inside them are doubled.
    The names in a header must not, and a file that ends inside a quoted cell is unreadable.
    """
    files = survey_files(spark, pattern, encodings).filter("encoding IS NOT NULL")
    files = written(files.select(
        "path", "encoding", decoded(F.col("header"), F.col("encoding")).alias("header"), "header_at", "header_pos", "breaks"),
        "headers")
    # one row per layout, not per file
    layouts = sorted(r["header"] for r in files.select("header").distinct().collect() if r["header"])
    if not layouts:
        raise ValueError(f"no readable file matches {pattern}")
    if any(leaves_open(h.encode()) for h in layouts):
        raise ValueError(f"a header among {pattern} has a name with a line break")
    lines = numbered_lines(spark, pattern).join(files.filter("NOT breaks"), "path")
    lines = lines.withColumn("line", decoded(F.col("line"), F.col("encoding")))
    if not files.filter("breaks").isEmpty():
        lines = lines.unionByName(joined_records(spark, pattern, files.filter("breaks")))
    lines = lines.filter("at > header_at OR at = header_at AND pos > header_pos").filter(F.trim("line") != "")
    place = F.struct("path", "at", "pos")
    table = written(
        lines.select(place.alias("place"), _parsed(F.col("line"), F.col("header"), layouts).alias("row")), "csv-cells")
    columns = table.schema["row"].dataType.names
    cells = table.select("place", "row.*")
    kinds = schema or _inferred(cells, columns)
    typed = {f.name: col(f.name).try_cast(f.dataType) for f in kinds if f.name in columns}
    cells = cells.withColumns(typed)
    if row_id is None:
        return cells.drop("place")
    return row_index(cells, ["place"], row_id).drop("place")


def unreadable_files(spark: SparkSession, pattern: str, encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """``path, reason`` of the files that ``read_csv_files`` leaves out."""
    files = survey_files(spark, pattern, encodings)
    open_ended = unclosed_files(block_states(lines_both_ways(spark, pattern))).join(files.filter("encoding IS NOT NULL"), "path")
    return left_out(files).unionAll(open_ended.select("path", F.lit("ends inside a quoted cell").alias("reason")))


_INTEGRAL = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}  # fixed: digits of each type


def common_type(types: set[T.DataType]) -> T.DataType:
    """The type that holds all values: no integer loses a digit, and only floats make doubles."""
    if len(types) == 1:
        return next(iter(types))
    kinds = {type(t) for t in types}
    if kinds <= set(_INTEGRAL):
        return max(kinds, key=_INTEGRAL.index)()
    if kinds <= {*_INTEGRAL, T.DecimalType}:
        exact = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (_DIGITS[type(t)], 0) for t in types]
        scale = max(s for _, s in exact)
        whole = max(p - s for p, s in exact)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    return T.DoubleType() if all(isinstance(t, T.NumericType) for t in types) else T.StringType()


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """Append rows, columns matched by name; where types differ all become the ``common_type``."""
    kinds: dict[str, set] = {}
    for frame in frames:
        for field in frame.schema:
            kinds.setdefault(field.name, set()).add(field.dataType)
    casts = {name: common_type(types) for name, types in kinds.items() if len(types) > 1}

    def aligned(frame: DataFrame) -> DataFrame:
        changed = {c: col(c).cast(casts[c]) for c in frame.columns if c in casts}
        return frame.withColumns(changed) if changed else frame

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), map(aligned, frames))


def write_csv(df: DataFrame, path: str) -> None:
    """Every part file has its own header, so the folder reads back as one table; white space in cells stays."""
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(header=True, **_DOUBLED, **kept).csv(path)


def transcode(spark: SparkSession, pattern: str, path: str, encodings: Sequence[str] = ENCODINGS) -> None:
    """Rewrite CSV files of any listed encoding as one table in UTF-8."""
    write_csv(read_csv_files(spark, pattern, encodings, row_id=None), path)


def write_report(report: DataFrame, path: str, as_csv: bool = False) -> None:
    """Outlier reports go to Parquet; in CSV their lists are JSON text."""
    if not as_csv:
        report.write.mode("overwrite").parquet(path)
        return
    nested = [f.name for f in report.schema if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]
    write_csv(report.withColumns({c: F.to_json(col(c)) for c in nested}) if nested else report, path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
