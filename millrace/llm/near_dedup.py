"""Near-duplicates by an LSH forest of MinHash signatures.

Documents with the same shingle set are one node.  Every tree of the forest sorts the nodes
by its own ``DEPTH`` MinHash values.  Candidates of a node are its neighbours in the sorted
orders that share at least ``LEAST_DEPTH`` values with it: all of them where they are at most
``REGION``, else the nearest ones of the order, which share the longest prefixes.  So
the depth adapts to the region, and neighbours meet across the borders of deeper prefixes.

Candidates pass an estimate from the low bytes of their signatures; what is left is
compared on the full shingle sets.  Links are merged to components.

Crowded regions lose links, so what they still hold in different components is joined
exactly: sets at the threshold share one of their rarest shingles (prefix filter).  Lengths
and parity bitmaps bound the difference of two such sets from below, the full sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.ranking import row_index
from ..plans.scratch import managed
from .common import col, prepared, slices, written
from .components import components
from .words import NO_SPACE, mix, shingle_sets, words_of

TREES, DEPTH, LEAST_DEPTH = 16, 8, 4
REGION = 128
#: counters of shingles, for an order that begins with rare ones; and 64-bit words of a parity bitmap
RARITY_BITS, BITMAP_WORDS = 20, 8
HASHES = TREES * DEPTH
#: four standard errors of the estimate below a similarity of 0.85 with 128 hashes
SLACK = 0.13

_RANDOM = np.random.default_rng(20_240_101)
_MULTIPLIERS = _RANDOM.integers(0, 2**64, HASHES, np.uint64) | np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 2**64, HASHES, np.uint64)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` values per set; sets must not be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    if not sets:
        return out
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    room = np.empty_like(values)
    for i in range(HASHES):
        np.multiply(values, _MULTIPLIERS[i], out=room)
        np.add(room, _OFFSETS[i], out=room)
        out[:, i] = np.minimum.reduceat(room, starts) >> np.uint64(32)
    return out


def _heads(signatures: np.ndarray) -> np.ndarray:
    """One hash per tree of the first ``LEAST_DEPTH`` values of its order; trees have different ones."""
    values = signatures.reshape(-1, TREES, DEPTH)[:, :, :LEAST_DEPTH].astype(np.uint64)
    out = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), values.shape[:2]).copy()
    for i in range(LEAST_DEPTH):
        out = mix(out * _MULTIPLIERS[i] + values[:, :, i])
    return out.view(np.int64)


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column(1).to_pylist(), NO_SPACE), k)
            signatures = minhash([s for s in sets if len(s)])
            heads = iter(_heads(signatures))
            lows = iter(signatures.astype(np.uint8))
            rows = [(blake2b(s.tobytes(), digest_size=16).digest(), next(heads), next(lows).tobytes()) if len(s)
                    else (None, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[2] for r in rows], pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "heads", "low"])

    return run


def sketches(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Written table ``doc_id, n_shingles, set_id, heads, low``: one row per document.

    ``heads`` names the prefix of the node in every tree, ``low`` has the low byte of every MinHash value.
    """
    rows = docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(
        _sketch(k), "doc_id bigint, n_shingles bigint, set_id binary, heads array<bigint>, low binary"), "sketches")


def forest_regions(nodes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Candidate regions ``region bigint, node``, at most ``REGION`` nodes each, and, where some
    were crowded, the members ``top bigint, node`` of all that were."""
    deep = lambda t: F.substring(F.col("low"), t * DEPTH + LEAST_DEPTH + 1, F.lit(DEPTH - LEAST_DEPTH))
    trees = nodes.select("node", F.explode(F.transform(
        "heads", lambda h, t: F.struct(t.alias("tree"), h.alias("top"), deep(t).alias("deep")))).alias("t")).select("node", "t.*")
    # written, so that the rows of a hot prefix are rows of a join that may be split
    sizes = written(trees.groupBy("top").agg(F.count("*").alias("n")).filter("n > 1"), "region-sizes")
    near = written(trees.join(sizes.hint("merge"), "top"), "forest")
    small = near.filter(F.col("n") <= REGION).select(F.col("top").alias("region"), "node")
    crowded = near.filter(F.col("n") > REGION).select("tree", "top", "deep", "node")
    if crowded.isEmpty():
        return small, None
    # windows over the sorted order, each the second half of one and the first half of the next
    ordered = row_index(crowded, ["tree", "top", "deep", "node"], "place")
    half = F.floor(F.col("place") / max(1, REGION // 2))
    windows = ordered.select("tree", "node", F.explode(F.array(half, half - 1)).alias("window")).select(
        F.xxhash64("tree", "window").alias("region"), "node")
    return small.unionByName(windows), crowded.select("top", "node")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of equal ``key`` in rows that come sorted by it; runs may span batches."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if kept and kept[-1].column(kept[-1].schema.get_field_index(key))[0].as_py() != keys[a]:
                yield pa.Table.from_batches(kept)
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield pa.Table.from_batches(kept)


class Unions:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.parent[max(i, j)] = min(i, j)
        return i != j


def _screen(least: float):
    """Split regions into what the signatures say may be linked; equal splits get equal names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(r, pa.int64()) for r in zip(*rows)], names=["cell", "node"])

        rows: list[tuple[int, int]] = []
        for table in _grouped(batches, "region"):
            nodes = table["node"].to_pylist()
            lows = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, HASHES)
            unions = Unions(len(nodes))
            for i in range(1, len(nodes)):
                alike = (lows[:i] == lows[i]).sum(axis=1) >= least * HASHES
                for j in np.flatnonzero(alike).tolist():
                    unions.join(i, j)
            members: dict[int, set[int]] = {}
            for i, node in enumerate(nodes):
                members.setdefault(unions.find(i), set()).add(node)
            for cell in members.values():
                if len(cell) > 1:
                    ordered = np.array(sorted(cell), np.int64)
                    name = int.from_bytes(blake2b(ordered.tobytes(), digest_size=8).digest(), "little", signed=True)
                    rows += [(name, node) for node in ordered.tolist()]
            if len(rows) > 10_000:
                yield flushed(rows)
                rows = []
        if rows:
            yield flushed(rows)

    return run


def _confirm(k: int, percent: int):
    """Links between the texts of a cell, on their full sets; pairs already in one component are skipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, "cell"):
            nodes = table["node"].to_pylist()
            unions = Unions(len(nodes))
            sets = []
            for at in range(len(nodes)):  # one text at a time: the words of a long text are large
                sets.append(shingle_sets(words_of(table["text"].slice(at, 1).to_pylist(), NO_SPACE), k)[0])
            links = []
            for i in range(1, len(nodes)):
                for j in range(i):
                    a, b = sorted((sets[i], sets[j]), key=len)
                    if not len(a) or unions.find(i) == unions.find(j) or 100 * len(a) < percent * len(b):
                        continue
                    at = np.searchsorted(b, a)
                    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
                    if 100 * both >= percent * (len(a) + len(b) - both):
                        unions.join(i, j)
                        links.append((nodes[i], nodes[j]))
            if links:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*links)], names=["u", "v"])

    return run


def _links(cells: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """``cells``: ``cell, node``."""
    rows = cells.join(texts.hint("merge"), "node").select("cell", "node", "text")
    rows = rows.repartition("cell").sortWithinPartitions("cell")
    return rows.mapInArrow(_confirm(k, percent), "u bigint, v bigint")


def _full_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = shingle_sets(words_of(batch.column(1).to_pylist(), NO_SPACE), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["node", "shingles"])

    return run


def _rarity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).flatten().to_numpy().view(np.uint64)
        counters, counts = np.unique((values >> np.uint64(64 - RARITY_BITS)).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(counters), pa.array(counts)], names=["counter", "n"])


def _prefixes(counts, percent: int):
    """The rarest shingles of each set, as many as hold one of any set it can be linked to, and its parity bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(1).offsets.to_numpy()
            values = batch.column(1).values.to_numpy()
            heads, bitmaps = [], []
            for a, b in zip(starts[:-1], starts[1:]):
                own, n = values[a:b].view(np.uint64), int(b - a)
                # any order will do that is the same for all sets
                order = np.lexsort((own, counts.value[(own >> np.uint64(64 - RARITY_BITS)).astype(np.int64)]))
                heads.append(own[order[:n + (-percent * n // 100) + 1]].view(np.int64))
                bits = np.bincount((own & np.uint64(64 * BITMAP_WORDS - 1)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
                bitmaps.append(np.packbits(bits.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(starts).astype(np.int64)), pa.array(heads, pa.list_(pa.int64())),
                 pa.array(bitmaps, pa.list_(pa.int64()))], names=["node", "size", "head", "bitmap"])

    return run


def exact_links(sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """All links ``u, v`` between rows of ``sets (node, shingles)`` of different components, written.

    A shingle that all but one component lack makes no pair.  Rows of a hot shingle are rows of
    a join that may be split, and pairs that cannot be linked leave it unwritten.
    """
    spark = sets.sparkSession
    counts = np.zeros(1 << RARITY_BITS, np.int64)
    # at most 2^RARITY_BITS rows
    table = sets.select("shingles").mapInArrow(_rarity, "counter bigint, n bigint").groupBy("counter").agg(
        F.sum("n").alias("n")).toArrow()
    counts[table["counter"].to_numpy()] = table["n"].to_numpy()
    heads = sets.mapInArrow(
        _prefixes(spark.sparkContext.broadcast(counts), percent),
        "node bigint, size bigint, head array<bigint>, bitmap array<bigint>")
    heads = written(heads.join(known, "node", "left").withColumn("component", F.coalesce("component", "node")), "heads")
    tokens = heads.select("node", "component", F.explode("head").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a < b")
    rows = written(
        heads.select("node", "component", "size", "bitmap", F.explode("head").alias("token"))
        .join(mixed.select("token").hint("merge"), "token", "left_semi"), "postings")
    a, b = (rows.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "size", "bitmap")]) for x in "ab")
    apart = " + ".join(f"bit_count(bitmap_a[{i}] ^ bitmap_b[{i}])" for i in range(BITMAP_WORDS))
    pairs = a.hint("merge").join(b, "token").filter(
        f"component_a < component_b AND 100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)"
        f" AND {100 + percent} * ({apart}) <= {100 - percent} * (size_a + size_b)"
    ).select(F.col("node_a").alias("u"), F.col("node_b").alias("v")).distinct()
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")).hint("merge")
    both = pairs.join(full("u"), "u").join(full("v"), "v").select(
        "u", "v", (F.size("set_u") + F.size("set_v")).cast("bigint").alias("n"),
        F.size(F.array_intersect("set_u", "set_v")).cast("bigint").alias("both"))
    return written(both.filter(f"100 * both >= {percent} * (n - both)").select("u", "v"), "exact-links")


def near_duplicates(
    docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    A document's set holds its distinct shingles of ``k`` words (words: runs without ASCII white
    space, A-Z lower-cased); with fewer words the whole sequence is its one shingle.
    Documents are linked where the shared part of their sets is at least ``percent`` per cent of
    the union.  ``component_id`` is the least id that links reach; ``kept`` marks the row
    with that id.  Null and empty texts have no set and stand alone.  Rows that repeat an id
    are the same document, whatever their texts.  A row without an id is never linked: its
    component is null and it is kept.
    """
    spark = prepared(docs.sparkSession)
    sketch = sketches(docs, k, id_col, text_col)
    sets = written(
        sketch.filter("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id")
        .agg(F.min("doc_id").alias("node"), F.first("heads").alias("heads"), F.first("low").alias("low")), "shingle-sets")
    texts = docs.select(col(id_col).cast("bigint").alias("node"), col(text_col).cast("binary").alias("text"))
    with managed(spark):
        regions, crowded = forest_regions(sets)
        screened = regions.join(sets.select("node", "low").hint("merge"), "node").select("region", "node", "low")
        screened = screened.repartition("region").sortWithinPartitions("region").mapInArrow(
            _screen(percent / 100 - SLACK), "cell bigint, node bigint")
        # equal cells of several trees are compared once
        cells = written(screened.distinct(), "cells")
        wanted = cells.select("node")
        if crowded is not None:  # for the exact join: documents are shuffled once
            wanted = wanted.unionAll(crowded.select("node"))
        wanted = wanted.distinct()
        near = written(texts.join(wanted.hint("merge"), "node", "left_semi"), "cell-texts")
        known = components(written(_links(cells, near, k, percent), "forest-links"))
        if crowded is not None:
            members = crowded.join(known, "node", "left").select("top", "node", F.coalesce("component", "node").alias("c"))
            mixed = members.groupBy("top").agg(F.min("c").alias("a"), F.max("c").alias("b")).filter("a < b").select("top")
            left = written(members.join(mixed, "top", "left_semi").select("node").distinct(), "mixed-nodes")
            if not left.isEmpty():
                whole = written(
                    near.join(left.hint("merge"), "node", "left_semi").distinct()
                    .mapInArrow(_full_sets(k), "node bigint, shingles array<bigint>"), "crowded-sets")
                rest = exact_links(whole, known, percent)
                if not rest.isEmpty():
                    known = components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(rest))
        known = written(known, "components", outlives=True)

    named = sets.select("set_id", "node").join(known, "node", "left").select(
        "set_id", F.coalesce("component", "node").alias("component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return sketch.select("doc_id", "n_shingles", "set_id").join(named, "set_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
