import datetime as dt

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from millrace.plans import lookup, scratch
from millrace.sources import encodings, files
from millrace.streaming import operators as streaming

CHINESE = "金额,类别\n12.5,正常\n7,异常\n"
TRADITIONAL = "金額,類別\n3,測試裡\n"


@pytest.fixture
def mixed(tmp_path):
    (tmp_path / "a.csv").write_bytes(CHINESE.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(CHINESE.replace("\n", "\r\n").encode("gbk"))
    (tmp_path / "c.csv").write_bytes("金额,类别\n1,ñ\n".encode("gb18030"))
    (tmp_path / "d.csv").write_bytes(b"")
    return str(tmp_path / "*.csv")


def test_encoding_of_each_file(spark, mixed):
    found = {r.path.rsplit("/", 1)[1]: r.encoding for r in encodings.detect_encodings(spark, mixed).collect()}
    assert found == {"a.csv": "utf-8", "b.csv": "gbk", "c.csv": "gb18030"}


def test_order_of_encodings_counts(spark, tmp_path):
    (tmp_path / "big5.csv").write_bytes(TRADITIONAL.encode("big5"))
    raw = TRADITIONAL.encode("big5")
    expected = None
    for name in encodings.ENCODINGS:
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        expected = name
        break
    found = encodings.detect_encodings(spark, str(tmp_path / "*.csv")).first()
    assert found.encoding == expected
    lines = encodings.decode_files(spark, str(tmp_path / "*.csv"), ("utf-8", "big5"))
    assert rows_of(lines, "line") == sorted((line,) for line in TRADITIONAL.splitlines())


def test_unknown_encoding_is_an_error(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    with pytest.raises(ValueError):
        encodings.decode_files(spark, str(tmp_path / "x.csv"))


def test_csv_files_of_mixed_encodings_become_one_table(spark, mixed, tmp_path):
    table = files.read_csv_files(spark, mixed)
    assert rows_of(table, "金额", "类别") == [(1.0, "ñ"), (12.5, "正常"), (12.5, "正常"), (7.0, "异常"), (7.0, "异常")]
    assert sorted(r.row_id for r in table.collect()) == [0, 1, 2, 3, 4]
    files.transcode(spark, mixed, str(tmp_path / "out"))
    assert rows_of(files.read_csv(spark, str(tmp_path / "out"))) == rows_of(table.drop("row_id"))


def test_columns_may_differ_between_files(spark, tmp_path):
    (tmp_path / "1.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "2.csv").write_text("b,c\nz,2.5\n")
    (tmp_path / "3.csv").write_text("a,b\n3.5,w\n")
    table = files.read_csv_files(spark, str(tmp_path / "*.csv"), row_id=None)
    assert rows_of(table, "a", "b", "c") == sorted(
        [(1.0, "x", None), (2.0, "y", None), (3.5, "w", None), (None, "z", 2.5)], key=repr)


def test_only_the_first_line_is_a_header(spark, tmp_path):
    for encoding in ("gbk", "utf-8"):
        (tmp_path / encoding).mkdir()
        (tmp_path / encoding / "x.csv").write_bytes("列,a\n值,1\n列,a\n\n值,2\n".encode(encoding))
        table = files.read_csv_files(spark, str(tmp_path / encoding / "*.csv"))
        assert rows_of(table, "row_id", "列", "a") == [(0, "值", "1"), (1, "列", "a"), (2, "值", "2")]


def test_blank_lines_before_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"\n  \r\n\nx,y\n1,2\n\n3,4\n")
    (tmp_path / "b.csv").write_bytes("y,x,z\n5,6,开\n".encode("gbk"))
    (tmp_path / "c.csv").write_bytes(b"\n\n \n")
    found = files.read_csv_files(spark, str(tmp_path / "*.csv"), row_id=None)
    assert rows_of(found, "x", "y", "z") == sorted([(1, 2, None), (3, 4, None), (6, 5, "开")], key=repr)


def test_unreadable_files_are_skipped_and_listed(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,b\n\xff\xff\xff,1\n")
    (tmp_path / "good.csv").write_text("a,b\n1,x\n")
    pattern = str(tmp_path / "*.csv")
    assert rows_of(files.read_csv_files(spark, pattern), "a", "b") == [(1, "x")]
    listed = files.unreadable_files(spark, pattern).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in listed] == [("bad.csv", "no listed encoding fits")]


def test_schema_types_the_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n007,"x, y",2024-01-02 03:04:05\nbad,,\n')
    pattern = str(tmp_path / "*.csv")
    import pyspark.sql.types as T

    schema = T.StructType().add("a", T.IntegerType())
    assert rows_of(files.read_csv_files(spark, pattern, schema=schema), "a", "b", "c") == sorted(
        [(7, "x, y", "2024-01-02 03:04:05"), (None, None, None)], key=repr)
    assert [f.dataType.simpleString() for f in files.read_csv_files(spark, pattern, row_id=None).schema] == [
        "string", "string", "timestamp_ntz"]


def test_large_file_in_many_blocks(spark, tmp_path):
    text = "id,word\n" + "".join(f"{i},词{i}\n" for i in range(30_000))
    (tmp_path / "big.csv").write_bytes(text.encode("gbk"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        table = files.read_csv_files(spark, str(tmp_path / "*.csv"))
        assert table.count() == 30_000
        assert table.filter("id != row_id OR word != concat('词', id)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CELLS = ["plain", "two\nlines", 'a "word", quoted', "\n", "first\n\n  \nlast", "5\" pipe", "", '"', 'x"\n"y', "1,2\n3,4", "词\n句"]


@pytest.mark.parametrize("encoding", ["utf-8", "gbk"])
def test_line_breaks_in_cells_across_blocks(spark, tmp_path, encoding):
    """The same rows as the csv module reads, whatever blocks the file is cut into."""
    import csv
    import io
    import random

    rng = random.Random(3)
    written = [(i, rng.choice(CELLS), rng.choice(CELLS) * rng.choice([1, 1, 1, 40])) for i in range(4000)]
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows([("id", "a", "b"), *written])
    (tmp_path / "broken.csv").write_bytes(text.getvalue().encode(encoding))
    (tmp_path / "plain.csv").write_bytes("id,a,b\n-1,甲,乙\n".encode(encoding))
    for size in ("16k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            table = files.read_csv_files(spark, str(tmp_path / "*.csv"))
            found = [(r.id, r.a or "", r.b or "") for r in table.orderBy("row_id").collect()]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert found == [*written, (-1, "甲", "乙")]


def test_state_of_a_line_agrees_with_the_csv_module():
    import csv
    import itertools

    from millrace.sources.quotes import leaves_open

    for n in range(7):
        for chars in itertools.product('",x', repeat=n):
            line = "".join(chars)
            # two more lines: they are swallowed where a cell is open
            rows = list(csv.reader([line + "\n", "x\n", "x\n"]))
            assert leaves_open(line.encode()) == (len(rows) == 1), line
            rows = list(csv.reader(['"\n', line + "\n", "x\n", "x\n"]))
            assert leaves_open(line.encode(), True) == (len(rows) == 1), line


def test_a_quote_that_never_closes(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n3,z\n')
    (tmp_path / "good.csv").write_text('a,b\n4,"p\nq"\n')
    pattern = str(tmp_path / "*.csv")
    assert rows_of(files.read_csv_files(spark, pattern), "a", "b") == [(4, "p\nq")]
    listed = files.unreadable_files(spark, pattern).collect()
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in listed] == [("open.csv", "ends inside a quoted cell")]
    (tmp_path / "good.csv").write_text('"a\nc",b\n4,5\n')
    with pytest.raises(ValueError):
        files.read_csv_files(spark, pattern)


def test_common_types():
    import pyspark.sql.types as T

    assert files.common_type({T.IntegerType(), T.LongType()}) == T.LongType()
    assert files.common_type({T.LongType(), T.DoubleType()}) == T.DoubleType()
    assert files.common_type({T.IntegerType(), T.DecimalType(12, 4)}) == T.DecimalType(14, 4)
    assert files.common_type({T.LongType(), T.StringType()}) == T.StringType()


def test_nothing_readable_is_an_error(spark, tmp_path):
    (tmp_path / "empty.csv").write_bytes(b"")
    with pytest.raises(ValueError):
        files.read_csv_files(spark, str(tmp_path / "*.csv"))


def test_report_as_csv_and_parquet(spark, table, tmp_path):
    report = table([(1, ["a", "b"])], "id int, extreme_tag array<string>")
    files.write_report(report, str(tmp_path / "p"))
    files.write_report(report, str(tmp_path / "c"), as_csv=True)
    assert spark.read.parquet(str(tmp_path / "p")).first().extreme_tag == ["a", "b"]
    assert files.read_csv(spark, str(tmp_path / "c")).columns == ["id", "extreme_tag"]


def test_small_tables_are_checked(spark):
    assert lookup.checked_small(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        lookup.checked_small(spark.range(4), 3)


def test_scratch_follows_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = scratch.scratch_dir(spark)
    assert folder == configured.rstrip("/") if configured else folder
    assert rows_of(scratch.written(spark.range(2), "t")) == [(0,), (1,)]


def test_managed_scratch_is_empty_afterwards(spark):
    import os

    left = scratch.tables(spark)
    with scratch.managed(spark):
        scratch.written(spark.range(3), "inside")
        kept = scratch.written(spark.range(2), "kept", outlives=True)
        made = [p for p in scratch.tables(spark) if p not in left]
        assert len(made) == 2 and os.path.exists(made[0].removeprefix("file:"))
    assert scratch.tables(spark) == [*left, made[1]] and not os.path.exists(made[0].removeprefix("file:"))
    assert kept.count() == 2
    scratch.remove(spark, made)
    assert scratch.tables(spark) == left and not os.path.exists(made[1].removeprefix("file:"))


def _event(day, hour, value):
    return (dt.datetime(2024, 1, day, hour), value)


def test_stream_resample_emits_closed_days_and_drops_late_rows(spark, tmp_path):
    schema = "ts timestamp_ntz, value double"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = [_event(1, 1, 2.0), _event(1, 5, 4.0), _event(2, 3, 8.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        daily = streaming.resample_stream(stream, "ts", ["value"])
        return rows_of(streaming.run_available(daily, "t", out, str(tmp_path / "progress")))

    assert run() == [(dt.datetime(2024, 1, 1), 3.0, 2)]
    late = [_event(1, 23, 100.0), _event(2, 4, 10.0), _event(3, 9, 1.0)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    assert run() == [(dt.datetime(2024, 1, 1), 3.0, 2), (dt.datetime(2024, 1, 2), 9.0, 2)]


def test_stream_scores_equal_table_scores(spark, tmp_path):
    history = spark.createDataFrame([(i, float(i % 5), 3.0) for i in range(60)], "id bigint, a double, c double")
    stats = streaming.frozen_stats(history, ["a", "c"])
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, 2.0, 3.0), (2, 50.0, 9.0)], history.schema).write.parquet(source)
    scored = streaming.score_stream(streaming.read_parquet_stream(spark, source, 1), stats)
    found = streaming.run_available(scored, "scores", str(tmp_path / "out"))
    assert rows_of(found.select("id", "extreme_tag", F.round("a_z", 3), "c_z")) == [
        (1, [], 0.0, None), (2, ["a"], 33.941, None)]
