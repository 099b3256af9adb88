"""Ranked lexical search: an inverted index in shards, searched by Block-Max MaxScore.

The index holds every term of every document.  A shard covers a run of documents and has one row
per term: postings in blocks of ``BLOCK``, compressed (gaps of positions and term counts as
variable-length bytes), with the last position and the largest impact of each block, and the
largest impact of the list.  An impact depends on the number and the length of documents, so these are
counted first.  A common term has a row in every shard and is never one group.

A search joins the lists of its terms with the index.  In a shard, a query goes through the
documents window by window.  Lists whose bounds together stay below the score to beat are not
essential: only documents of the other lists are candidates.  Block maxima of the lists that are
not essential reject candidates before any of those blocks is decompressed; what is left is
scored list by list, rejected again as bounds fall, and enters the shard's heap.  The heaps of all
shards are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import col, prepared, shuffle_partitions, slices, written
from .words import ALNUM, Words, class_of, words_of

BLOCK = 128
#: postings of a shard, unless one block of text or one text has more
SHARD_POSTINGS = 2_000_000
#: terms sent to Spark at once
TERMS_AT_ONCE = 100_000
#: queries that meet a shard together
QUERIES = 256
SHARDS_A_TASK = 4
#: documents of the first window, and of the largest
FIRST_WINDOW, WINDOW = 256, 4096

#: fixed values: impact = FULL * tf div (1000 * tf + 12 * m), weight = floor(1000 * ln((2N + 2) / (2 df + 1)))
FULL, TF_SCALE, M_SCALE = 1_000_000_000, 1000, 12
#: fixed: [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]
WORD_BYTES = ALNUM | class_of(bytes(range(0x41, 0x5B)))

INDEX = ("shard bigint, term bigint, n_docs bigint, best bigint, lasts array<int>, bests array<int>, ends array<int>,"
         " data binary")


def length_norm(n: int, documents: int, terms: int) -> int:
    return 75 + 25 * n * documents // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return FULL * tf // (TF_SCALE * tf + M_SCALE * m)


# --- counting ---------------------------------------------------------------------------------

def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms and terms in all, of each piece of text."""
    for batch in slices(batches, "text"):
        texts = [t or b"" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        inside = WORD_BYTES[np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)]
        found = np.flatnonzero(inside[1:] & ~inside[:-1])
        counts = np.diff(np.searchsorted(found, begins))
        yield pa.RecordBatch.from_arrays(
            [pa.array([int((counts > 0).sum())]), pa.array([int(counts.sum())])], names=["documents", "terms"])


# --- compressing ------------------------------------------------------------------------------

def encoded(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers as bytes of seven bits, low ones first, the last without the high bit; and their ends."""
    values = values.astype(np.uint64)
    sizes = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        sizes += values >= np.uint64(1 << bits)
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts, left = ends - sizes, np.arange(len(values))
    for byte in range(10):
        left = left[sizes[left] > byte]
        if not len(left):
            break
        part = (values[left] >> np.uint64(7 * byte) & np.uint64(127)).astype(np.uint8)
        out[starts[left] + byte] = part | np.where(sizes[left] > byte + 1, 128, 0).astype(np.uint8)
    return out, ends


def decoded(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(data < 128) + 1
    starts = np.concatenate([[0], ends[:-1]])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), starts)


# --- building ---------------------------------------------------------------------------------

class _Shard:
    """Postings of a run of documents, gathered text by text."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.postings = 0

    def add(self, ids: list[int | None], words: Words) -> None:
        counts = np.diff(words.first)
        held = np.flatnonzero(counts)
        place = np.zeros(len(ids), np.int64)
        place[held] = len(self.ids) + np.arange(len(held))
        self.ids += [ids[i] for i in held.tolist()]
        self.lengths += counts[held].tolist()
        order = np.argsort(words.hashes, kind="stable")  # documents stay in order
        terms, docs = words.hashes[order], np.repeat(place, counts)[order]
        new = np.ones(len(terms), bool)
        new[1:] = (terms[1:] != terms[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(new)
        self.parts.append((terms[at], docs[at].astype(np.int32), np.diff(np.append(at, len(terms))).astype(np.int32)))
        self.postings += len(at)

    def rows(self, shard: int, documents: int, terms: int) -> Iterator[pa.RecordBatch]:
        """One row for the documents (without a term), then one for each term."""
        m = np.array([length_norm(n, documents, terms) for n in self.lengths], np.int64)
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], np.int64)
        yield self._batch([shard], pa.array([None], pa.int64()), [len(ids)], [0], *(
            pa.array([None], pa.list_(pa.int32())) for _ in range(3)),
            pa.array([m.tobytes() + ids.tobytes() + known.tobytes()], pa.binary()))
        names, docs, tf = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(names, kind="stable")
        names, docs, tf = names[order], docs[order].astype(np.int64), tf[order].astype(np.int64)
        new = np.ones(len(names), bool)
        new[1:] = names[1:] != names[:-1]
        lists = np.flatnonzero(new)
        for at in range(0, len(lists), TERMS_AT_ONCE):
            own = lists[at:at + TERMS_AT_ONCE + 1]
            end = int(own[-1]) if len(own) > TERMS_AT_ONCE else len(names)
            own = own[:TERMS_AT_ONCE]
            part = slice(int(own[0]), end)
            yield self._lists(shard, names[part], docs[part], tf[part], own - own[0], m)

    def _lists(self, shard, names, docs, tf, lists, m) -> pa.RecordBatch:
        sizes = np.diff(np.append(lists, len(names)))
        inside = np.arange(len(names)) - np.repeat(lists, sizes)
        blocks = np.flatnonzero(inside % BLOCK == 0)
        impact = impacts(tf, m[docs])
        bests = np.maximum.reduceat(impact, blocks)
        block_ends = np.append(blocks[1:], len(names))
        gaps = np.diff(docs, prepend=0)
        gaps[blocks] = docs[blocks]
        data, ends = encoded(np.stack([gaps, tf], axis=1).ravel())
        byte_ends = ends[2 * block_ends - 1]  # of each block
        per_list = np.add.reduceat((inside % BLOCK == 0).astype(np.int64), lists)
        block_offsets = np.concatenate([[0], np.cumsum(per_list)])
        list_bytes = np.concatenate([[0], byte_ends[block_offsets[1:] - 1]])
        within = byte_ends - np.repeat(list_bytes[:-1], per_list)
        offsets = pa.array(block_offsets, pa.int32())
        arrays = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (docs[block_ends - 1], bests, within)]
        payload = pa.Array.from_buffers(
            pa.binary(), len(lists), [None, pa.array(list_bytes, pa.int32()).buffers()[1], pa.py_buffer(data.tobytes())])
        return self._batch(
            np.full(len(lists), shard), pa.array(names[lists].view(np.int64)), sizes, np.maximum.reduceat(impact, lists),
            *arrays, payload)

    @staticmethod
    def _batch(shard, term, n_docs, best, lasts, bests, ends, data) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(shard, pa.int64()), term, pa.array(n_docs, pa.int64()), pa.array(best, pa.int64()), lasts, bests, ends, data],
            names=[f.split()[0] for f in INDEX.split(", ")])


def _index(documents: int, terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        shard = _Shard()
        for batch in slices(batches, "text"):
            shard.add(batch.column(0).to_pylist(), words_of(batch.column(1).to_pylist(), ALNUM))
            if shard.postings >= SHARD_POSTINGS:
                yield from shard.rows(name, documents, terms)
                shard, name = _Shard(), name + 1
        if shard.postings:
            yield from shard.rows(name, documents, terms)

    return run


@dataclass
class LexicalIndex:
    """A written index: ``table`` as in ``INDEX``, the number of documents with terms, and of their terms."""

    table: DataFrame
    documents: int
    terms: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
    """Index the whole texts of all rows.

    Terms are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased, known by
    a 64-bit hash of their bytes.  Null texts and texts without terms are not documents.  Rows that
    repeat an id, or have none, are documents of their own.  A very long text is a shard of its own.
    """
    prepared(docs.sparkSession)
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    documents, terms = rows.select("text").mapInArrow(_sizes, "documents bigint, terms bigint").agg(
        F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return LexicalIndex(written(rows.mapInArrow(_index(documents, terms), INDEX), "lexical-index"), documents, terms)


# --- searching --------------------------------------------------------------------------------

class _List:
    """Postings of a term in a shard; blocks are decompressed when first asked for."""

    def __init__(self, n: int, best: int, lasts, bests, ends, data: bytes, m: np.ndarray):
        self.n, self.best = n, best
        self.lasts, self.bests, self.ends = (x.to_numpy().astype(np.int64) for x in (lasts, bests, ends))
        self.data, self.m = np.frombuffer(data, np.uint8), m
        # a block that is not decompressed shows its last document everywhere: the array stays sorted
        self.docs = np.repeat(self.lasts, BLOCK)[:n]
        self.impacts = np.zeros(n, np.int64)
        self.ready = np.zeros(len(self.lasts), bool)

    def fetch(self, blocks: np.ndarray) -> None:
        blocks = blocks[~self.ready[blocks]]
        if not len(blocks):
            return
        starts = np.where(blocks > 0, self.ends[blocks - 1], 0)
        if blocks[-1] - blocks[0] + 1 == len(blocks):
            data = self.data[starts[0]:self.ends[blocks[-1]]]
        else:
            data = np.concatenate([self.data[a:b] for a, b in zip(starts, self.ends[blocks])])
        values = decoded(data)
        sums, tf = np.cumsum(values[0::2]), values[1::2]
        first = blocks * BLOCK
        counts = np.minimum(first + BLOCK, self.n) - first
        before = np.cumsum(counts) - counts
        sums -= np.repeat(np.where(before > 0, sums[before - 1], 0), counts)
        at = np.repeat(first - before, counts) + np.arange(len(sums))
        self.docs[at], self.impacts[at] = sums, impacts(tf, self.m[sums])
        self.ready[blocks] = True

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a window."""
        a, b = np.searchsorted(self.lasts, (low, high - 1))
        self.fetch(np.arange(a, min(b + 1, len(self.lasts))))
        a, b = np.searchsorted(self.docs, (low, high))
        return self.docs[a:b], self.impacts[a:b]

    def maxima(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block that may hold each document, and its largest impact (0 beyond the last block)."""
        blocks = np.searchsorted(self.lasts, docs)
        inside = blocks < len(self.lasts)
        return blocks, np.where(inside, self.bests[np.where(inside, blocks, 0)], 0)

    def impacts_of(self, docs: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        self.fetch(np.unique(blocks[blocks < len(self.lasts)]))
        at = np.searchsorted(self.docs, docs)
        inside = at < self.n
        at = np.where(inside, at, 0)
        return np.where(inside & (self.docs[at] == docs), self.impacts[at], 0)


def top_of_shard(lists: list[_List], weights: list[int], n_docs: int, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and scores of the ``k`` best documents of a shard; ``order`` breaks ties."""
    bounds = np.array([w * x.best for x, w in zip(lists, weights)], np.int64)
    by_bound = np.argsort(bounds, kind="stable")
    lists, weights = [lists[i] for i in by_bound], [weights[i] for i in by_bound]
    together = np.cumsum(bounds[by_bound])
    top, top_scores, to_beat = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
    low, size = 0, FIRST_WINDOW
    while low < n_docs:
        # lists before this one cannot lift a document to the score to beat by themselves
        essential = int(np.searchsorted(together, to_beat))
        if essential == len(lists):
            break
        high = min(n_docs, low + size)
        sums = np.zeros(high - low, np.int64)
        for x, w in zip(lists[essential:], weights[essential:]):
            docs, found = x.between(low, high)
            sums[docs - low] += w * found
        docs = np.flatnonzero(sums)
        scores, docs = sums[docs], docs + low
        if essential:
            room = scores + together[essential - 1] >= to_beat
            docs, scores = docs[room], scores[room]
        if essential and len(docs):
            places, maxima = zip(*[x.maxima(docs) for x in lists[:essential]])
            maxima = np.stack([v * w for v, w in zip(maxima, weights)])
            places, rest = np.stack(places), maxima.sum(axis=0)
            for i in range(essential - 1, -1, -1):
                room = scores + rest >= to_beat
                if not room.all():
                    docs, scores, rest, places, maxima = docs[room], scores[room], rest[room], places[:, room], maxima[:, room]
                if not len(docs):
                    break
                rest = rest - maxima[i]
                scores = scores + weights[i] * lists[i].impacts_of(docs, places[i])
        room = scores >= to_beat
        if room.any():
            top, top_scores = np.concatenate([top, docs[room]]), np.concatenate([top_scores, scores[room]])
            best = np.lexsort((order[top], -top_scores))[:k]
            top, top_scores = top[best], top_scores[best]
            if len(top) == k:
                to_beat = int(top_scores[-1])  # an equal score may still win by its id
        low, size = high, min(2 * size, WINDOW)
    return top, top_scores


def _search(k: int):
    def run(table: pa.Table) -> pa.Table:
        known = table["term"].is_valid().to_numpy()
        head = table.filter(pa.array(~known))
        n = head["n_docs"][0].as_py()
        data = head["data"][0].as_py()
        m, ids = (np.frombuffer(data, np.int64, n, at) for at in (0, 8 * n))
        has_id = np.frombuffer(data, np.uint8, n, 16 * n).astype(bool)
        order = np.empty(n, np.int64)
        order[np.lexsort((ids, ~has_id))] = np.arange(n)  # rows without an id come last
        rows = table.filter(pa.array(known))
        lists = {
            term: _List(size, best, lasts.values, bests.values, ends.values, packed.as_buffer(), m)
            for term, size, best, lasts, bests, ends, packed in zip(
                *(rows[c].to_pylist() for c in ("term", "n_docs", "best")), *(rows[c] for c in ("lasts", "bests", "ends", "data")))}
        out: dict[str, list] = {"qid": [], "doc_id": [], "score": []}
        for query in head["queries"][0].as_py():
            asked = [(lists[t["term"]], t["weight"]) for t in query["terms"] if t["term"] in lists]
            if asked:
                top, scores = top_of_shard([x for x, _ in asked], [w for _, w in asked], n, order, k)
                out["qid"] += [query["qid"]] * len(top)
                out["doc_id"] += [int(ids[i]) if has_id[i] else None for i in top]
                out["score"] += scores.tolist()
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    return run


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = words_of(batch.column(1).to_pylist(), ALNUM)
        found = [
            Counter(words.hashes[a:b].view(np.int64).tolist()) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(c) for c in found]).astype(np.int64))),
            pa.array([t for c in found for t in c], pa.int64()), pa.array([n for c in found for n in c.values()], pa.int64())],
            names=["qid", "term", "times"])


def search(
    index: LexicalIndex, queries: DataFrame, k: int = 20, id_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents with a score above 0 for each row of ``queries``.

    A term that ``df`` of the ``N`` documents hold weighs ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``.  A
    document of ``n`` terms in which it occurs ``tf`` times gains ``w`` times ``10^9 tf div (1000 tf + 12 m)`` for each
    time the query has it, with ``m = 75 + 25 n N div L`` and ``L`` terms in all documents.  Equal scores go
    to the smaller id, documents without an id come last among them.

    Rows of ``queries`` that repeat an id, or have none, are queries of their own.  Null texts and texts
    without known terms find nothing, an empty index or table of queries gives no rows.  Other
    columns are not looked at.  Very long queries are searched whole.
    """
    spark = prepared(queries.sparkSession)
    asked = written(queries.select(
        F.monotonically_increasing_id().alias("qid"), col(id_col).alias("item_id"), col(text_col).cast("binary").alias("text")),
        "queries")
    terms = written(asked.select("qid", "text").mapInArrow(_query_terms, "qid bigint, term bigint, times bigint"), "query-terms")
    lists = index.table.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi")
    seen = lists.groupBy("term").agg(F.sum("n_docs").alias("df"))
    ratio = F.lit(float(2 * index.documents + 2)) / (2 * F.col("df") + 1).cast("double")
    weighted = terms.join(seen, "term").withColumn("weight", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint") * F.col("times"))
    sets = max(1, -(-asked.count() // QUERIES))
    weighted = written(weighted.filter("weight > 0").withColumn(
        "part", F.pmod(F.xxhash64("qid"), F.lit(sets)).cast("int")).select("part", "qid", "term", "weight"), "query-weights")
    # about QUERIES queries each
    parts = weighted.groupBy("part", "qid").agg(F.collect_list(F.struct("term", "weight")).alias("terms")).groupBy("part").agg(
        F.collect_list(F.struct("qid", "terms")).alias("queries"))
    columns = [f.split()[0] for f in INDEX.split(", ")]
    shards = index.table.filter("term IS NULL").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))).join(
        parts, "part").select("part", *columns, "queries")
    wanted = index.table.filter("term IS NOT NULL").join(weighted.select("part", "term").distinct(), "term").select(
        "part", *columns, F.lit(None).cast(parts.schema["queries"].dataType).alias("queries"))
    # lists are small when compressed, so tasks follow the number of shards instead of bytes
    tasks = max(shuffle_partitions(spark), index.table.filter("term IS NULL").count() * sets // SHARDS_A_TASK)
    heaps = shards.unionByName(wanted).repartition(tasks, "shard", "part").groupBy("shard", "part").applyInArrow(
        _search(k), "qid bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("qid", "item_id"), "qid").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
