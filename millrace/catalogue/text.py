"""Files in several encodings, written from the documents and read back."""

import pandas as pd
from pyspark.sql import functions as F

from ..plans.scratch import new_path
from ..sources.encodings import decode_files
from ..sources.files import read_csv_files, write_csv
from .registry import query

_NARROW = ["en", "de"]  # written as UTF-8, the others as GB18030


def _encoded(encoding: str):
    @F.pandas_udf("binary")
    def encode(lines: pd.Series) -> pd.Series:
        return lines.map(lambda text: text.encode(encoding))

    return encode


@query("transcode", r"""
    SELECT doc_id, md5(regexp_replace(text, '[\r\n]', ' ', 'g')) AS text_md5 FROM documents""")
def transcode(t):
    flat = F.regexp_replace("text", "[\r\n]", " ")
    lines = t.documents.select("lang", F.concat_ws("\t", F.col("doc_id").cast("string"), flat).alias("line"))
    folder = new_path(t.spark, "mixed-encodings")
    narrow = F.coalesce(F.col("lang").isin(_NARROW), F.lit(False))
    lines.filter(narrow).select("line").write.text(f"{folder}/utf8")
    # raw bytes go through the text writer as they are
    raw = lines.filter(~narrow).select(_encoded("gb18030")("line").cast("string").alias("line"))
    raw.write.text(f"{folder}/gb18030")
    parts = F.split("line", "\t", 2)
    return decode_files(t.spark, f"{folder}/*/*.txt").select(
        parts[0].cast("bigint").alias("doc_id"), F.md5(parts[1].cast("binary")).alias("text_md5"))


def _mixed_folder(t):
    """Orders as CSV files of two encodings and two layouts; returns the folder."""
    folder = new_path(t.spark, "mixed-csv")
    orders = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    done = orders.filter("status = 'F'").select("id", F.lit("完").alias("mark"), "amount")
    write_csv(done, f"{folder}/utf8")
    # one header line and the rows of one task per file; bytes go through the text writer as they are
    rest = orders.filter("NOT (status <=> 'F')").select(F.concat_ws(",", "amount", "id", F.lit("开"), "status").alias("line"))
    keyed = rest.coalesce(1)
    header = t.spark.range(1).select(F.lit("amount,id,mark,status").alias("line"))
    both = header.unionAll(keyed).coalesce(1).select(_encoded("gbk")("line").cast("string").alias("line"))
    both.write.text(f"{folder}/gbk")
    return folder


@query("csv_roundtrip", """
    SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '完' ELSE '开' END AS mark, o_totalprice AS amount,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status
    FROM orders""")
def csv_roundtrip(t):
    return read_csv_files(t.spark, f"{_mixed_folder(t)}/*/part-*", row_id=None).select("id", "mark", "amount", "status")


@query("csv_line_breaks", r"""
    SELECT doc_id, lang, md5(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g')) AS text_md5 FROM documents""")
def csv_line_breaks(t):
    folder = new_path(t.spark, "csv-texts")
    write_csv(t.documents.select("doc_id", "lang", "text"), folder)
    back = read_csv_files(t.spark, f"{folder}/part-*", row_id=None)
    return back.select("doc_id", "lang", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))
