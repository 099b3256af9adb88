"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (a shorter item is one window).
Texts are winnowed with grams of ``K`` words: of every ``span - K + 1`` neighbouring grams
the one with the least hash is a fingerprint, so two texts that share ``span`` words share a
fingerprint inside them.  Document fingerprints that the benchmark has too are hits; each
hit is extended to the windows around it, and these are compared word by word with the
windows of the benchmark.  Windows shorter than ``span`` are winnowed with grams of their
own length, which keeps every gram.  So nothing is missed and nothing is found by a hash alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import col, prepared, slices, written
from .words import ALNUM, gram_hashes, words_of

SPAN = 10
K = 5
#: up to so many benchmark fingerprints (8 bytes each) go to every task to sieve the documents' first
SIEVE_LIMIT = 4_000_000


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """True where a gram is the least of one of the ``window`` windows it lies in; all ties are kept."""
    n = len(grams)
    if n <= window:
        return grams == grams.min() if n else np.zeros(0, bool)
    least = grams[:n - window + 1].copy()
    for j in range(1, window):
        np.minimum(least, grams[j:n - window + 1 + j], out=least)
    highest = np.zeros(n, np.uint64)
    for j in range(window):
        np.maximum(highest[j:n - window + 1 + j], least, out=highest[j:n - window + 1 + j])
    return grams == highest


def _item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column(1).to_pylist(), ALNUM)
        items, texts, sizes, prints = [], [], [], []
        for item, a, b in zip(batch.column(0).to_pylist(), words.first[:-1], words.first[1:]):
            n = int(min(SPAN, b - a))
            if not n:
                continue
            k = K if n == SPAN else n
            grams = gram_hashes(words.hashes[a:b], k)
            for at in range(a, b - n + 1):
                inside = grams[at - a:at - a + n - k + 1]
                items.append(item)
                texts.append(words.joined(at, n))
                sizes.append(n)
                prints.append(np.unique(inside[winnowed(inside, n - k + 1)]).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int32()),
             pa.array(prints, pa.list_(pa.int64()))], names=["item_id", "window", "size", "prints"])


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Written table ``item_id string, window binary, size, prints``: every window of every item."""
    prepared(benchmark.sparkSession)
    items = benchmark.select(col(id_col).cast("string").alias("item_id"), col(text_col).cast("binary").alias("text"))
    return written(items.mapInArrow(
        _item_windows, "item_id string, window binary, size int, prints array<bigint>"), "windows")


def _candidates(sizes: list[int], sieve):
    """Documents with the windows around their hits.  Without a sieve every fingerprint is a hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if sieve is None else sieve.value
        for batch in slices(batches, "text"):
            words = words_of(batch.column(1).to_pylist(), ALNUM)
            n_words, first = len(words.hashes), words.first
            last_of = np.repeat(first[1:], np.diff(first))  # end of the text a word belongs to
            starts_by_size = {}
            for size in sizes:
                k = K if size == SPAN else size
                grams = gram_hashes(words.hashes, k)
                if not len(grams):
                    continue
                place = np.arange(len(grams))
                inside = place + k <= last_of[:len(grams)]
                # a gram across two texts must not win a window
                chosen = winnowed(np.where(inside, grams, np.uint64(2**64 - 1)), size - k + 1) & inside
                at = np.flatnonzero(chosen)
                if known is not None:
                    spot = np.searchsorted(known, grams[at])
                    at = at[known[np.minimum(spot, len(known) - 1)] == grams[at]] if len(known) else at[:0]
                around = (at[:, None] - np.arange(size - k + 1)[None, :]).ravel()
                around = np.unique(around[around >= 0])
                around = around[around + size <= last_of[around]] if len(around) else around
                starts_by_size[size] = around
            text_of = np.searchsorted(first, np.arange(n_words), side="right") - 1
            windows: list[list] = [[] for _ in range(batch.num_rows)]
            for size, around in starts_by_size.items():
                for at in around.tolist():
                    text = int(text_of[at])
                    windows[text].append({"at": at - int(first[text]), "size": size, "window": words.joined(at, size)})
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first), pa.int64()), pa.array(windows, WINDOWS)],
                names=["rid", "n_words", "windows"])

    return run


WINDOWS = pa.list_(pa.struct([("at", pa.int32()), ("size", pa.int32()), ("window", pa.binary())]))


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z.  A
    word inside any occurrence of a benchmark window is hit; ``n_items`` counts the distinct
    items with an occurring window, ``items_sha256`` is over their ids, sorted as text and
    joined with commas.  Null and empty texts have no words, items without words no window;
    items without an id count as one item with an empty id.  Repeated documents have a row
    each, repeated items count once.  Empty tables give no rows, or no hits.
    """
    spark = prepared(docs.sparkSession)
    windows = benchmark_windows(benchmark, item_col, item_text_col)
    sizes = [r[0] for r in windows.select("size").distinct().collect()]  # at most SPAN values
    prints = windows.select(F.explode("prints").alias("p")).distinct()
    n_prints = prints.count()
    sieve = None
    if n_prints <= SIEVE_LIMIT:
        values = prints.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)
        sieve = spark.sparkContext.broadcast(np.sort(values))
    rows = docs.select(
        col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), col(text_col).cast("binary").alias("text"))
    searched = rows.select(F.struct("doc_id", "rid").alias("rid"), "text").mapInArrow(
        _candidates(sorted(sizes), sieve),
        f"rid struct<doc_id:{dict(rows.dtypes)['doc_id']},rid:bigint>, n_words bigint, "
        "windows array<struct<at:int,size:int,window:binary>>")
    searched = written(searched.select("rid.doc_id", "rid.rid", "n_words", "windows"), "searched")

    # a window that very many documents share is one row on the right, so the left may be split at will
    distinct = windows.select("window", "size").distinct()
    spread = searched.select("rid", F.explode("windows").alias("w")).select("rid", "w.at", "w.size", "w.window")
    hits = written(spread.join(distinct, ["window", "size"]), "window-hits")
    covered = hits.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("at", "size"))).alias("spans"))
    union = F.aggregate(
        "spans", F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["at"] + s["size"]).alias("upto"),
            (acc["n"] + F.greatest(F.lit(0), s["at"] + s["size"] - F.greatest(acc["upto"], s["at"]))).alias("n")))
    covered = covered.select("rid", union["n"].alias("n_hit"))

    items_of = windows.groupBy("window", "size").agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("items"))
    items = (
        hits.select("rid", "window", "size").distinct().join(items_of, ["window", "size"])
        .select("rid", F.explode("items").alias("item_id")).distinct()
        .groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    )
    found = covered.join(items, "rid")
    none = F.array().cast("array<string>")
    return searched.select("doc_id", "rid", "n_words").join(found, "rid", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
