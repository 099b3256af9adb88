"""From documents to token files: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes all rows its predecessor kept, written as Parquet and read again, and
returns the columns of ``documents``; the last returns what is read back from the token files.

Null columns, empty texts and empty tables pass as the operators say.  Where a stage removes
documents by id, rows that repeat an id go together; rows without an id are never removed
for their id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from millrace.llm.common import new_path, shuffle_partitions, written
from millrace.llm.decontaminate import contamination
from millrace.llm.mixing import mix
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.quality import classify, trusted_ids
from millrace.llm.queries import tokenizer_path
from millrace.llm.token_files import read_documents, write_token_files
from millrace.plans import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: list[str] = []


def _stage(build: Stage) -> Stage:
    """Remove the scratch tables of the stages before: their results have been written and read again."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scratch.remove(spark, _LEFT)
        before = set(scratch.tables(spark))
        result = build(spark, docs, sf_dir)
        _LEFT[:] = [p for p in scratch.tables(spark) if p not in before]
        return result

    return run_stage


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    # ids to remove grow with the documents: joined by shuffle at every size
    return docs.join(ids.distinct().hint("merge"), "doc_id", "left_anti").select(*docs.columns)


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose perplexity lies outside the limits of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = classify(docs, trusted_ids(labels))
    return judged.filter("kept").select("doc.*")


@_stage
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates; of rows that repeat an id, one."""
    groups = near_duplicates(docs, percent=80, k=5)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1")
    repeated = written(repeated.select("doc_id"), "repeated-ids")
    dropped = groups.filter(~F.col("kept")).select("doc_id")
    if repeated.isEmpty():
        return _without(docs, dropped)
    dropped = written(dropped.distinct(), "dropped-ids")
    rows = docs.join(repeated, "doc_id", "left_semi").join(dropped, "doc_id", "left_anti").select(
        F.struct(*docs.columns).alias("d"))
    first = Window.partitionBy("d.doc_id").orderBy(F.xxhash64("d.text"))
    one = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").select("d.*")
    return _without(docs, dropped.unionAll(repeated)).unionByName(one)


@_stage
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contamination(docs, benchmark).filter("contaminated").select("doc_id"))


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put the documents into the order of the mixture; every document stays.

    The order is that of the written files and of the rows in them.
    """
    plan = mix(docs, power=0.5).groupBy("doc_id").agg(F.min(F.struct("slot", "source", "place")).alias("at"))
    rows = docs.select(F.struct("*").alias("d"))
    placed = rows.join(plan, F.col("d.doc_id").eqNullSafe(F.col("doc_id"))).select("d", "at")
    keys = [F.col("at.slot").asc_nulls_last(), F.col("at.source"), F.col("at.place"), F.col("d.doc_id")]
    ordered = placed.repartitionByRange(shuffle_partitions(spark), *keys).sortWithinPartitions(*keys)
    return ordered.select("d.*")


@_stage
def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token files in the order in which the documents are stored, and read them back."""
    stored = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    files = write_token_files(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, order_by=stored)
    return read_documents(files)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("token-ID / binary output", token_stage),
]

#: no SQL states a language model, a forest of signatures or a tokenizer; tests use brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, outputs = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for number, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{number}", listed=number < len(STAGES) - 1)
        stage(spark, docs, sf_dir).write.parquet(path)
        scratch.remove(spark, outputs)
        outputs = [path]
        docs = spark.read.parquet(path)
    return docs
