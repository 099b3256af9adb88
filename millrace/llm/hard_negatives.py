"""Hard negatives by rotated one-bit codes whose error is bounded, never guessed.

A row's unit vector is rotated and coded by the signs ``x`` of its components (a unit vector, too).
The code is stored with its alignment ``r = <x, z>`` and with the length of the residual
``z - r x``; the residual is coded the same way, ``LEVELS`` times in all.  For a rotated query ``w``

    <w, z> = r1 <w, x1> + r2 <w, x2> + ... + <w, residual>

The products with codes are popcounts of the code and the bit planes of the quantised query; the
last term is at most the residual's length times the part of the query that the last code
leaves out (Cauchy-Schwarz), and what quantising the query leaves out is measured.  So every row
has an interval that holds its score.  Rows whose interval cannot be among the best go level by
level, and those that are left are scored in whole numbers: the result is that of scoring every row.

Rows and anchors are dealt into blocks and every block of rows meets every block of anchors; a
task returns the few best of its block, and those are merged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import col, null_safe_key, prepared, written
from .vectors import matrices, packed, unpacked

LEVELS = 4
#: bits of a quantised query component
PLANES = 8
#: values of a block of rows, and anchors of a block
BLOCK_VALUES, LEAST_ROWS, ANCHORS = 1 << 20, 256, 512
#: so few rows are scored at once instead of being narrowed further
FEW = 64
#: components saturate here, so that scores of up to 8,192 components stay far inside 64 bits
MOST = 1 << 24
#: room for the rounding of doubles, as a share of the product of both lengths
ROOM = 1e-9

CODED = ("rid bigint, vec_id bigint, grp string, dim int, vector binary, norm double, bits binary, along binary,"
         " rest binary")


@lru_cache(maxsize=4)
def _flips(width: int) -> np.ndarray:
    return np.random.default_rng(width).integers(0, 2, (3, width)) * 2.0 - 1.0


def rotated(matrix: np.ndarray) -> np.ndarray:
    """Random signs and a Hadamard transform, three times over: lengths and products stay as they are.

    Rows are filled up with zeros to a power of two of at least 64.
    """
    width = 64
    while width < matrix.shape[1]:
        width *= 2
    out = np.zeros((len(matrix), width))
    out[:, :matrix.shape[1]] = matrix
    for signs in _flips(width):
        out *= signs
        half = 1
        while half < width:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), width)
            half *= 2
        out /= np.sqrt(width)
    return out


def one_bit_codes(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bits (n, levels, words), alignments, lengths of the residuals`` of rotated vectors of length 1 or 0."""
    n, width = units.shape
    bits = np.empty((n, LEVELS, width // 64), np.uint64)
    along, rest = np.empty((n, LEVELS)), np.empty((n, LEVELS))
    left = units.copy()
    for level in range(LEVELS):
        positive = left >= 0
        bits[:, level] = np.packbits(positive, axis=1, bitorder="little").view(np.uint64)
        along[:, level] = np.abs(left).sum(axis=1) / np.sqrt(width)
        left -= np.where(positive, 1.0, -1.0) * (along[:, level] / np.sqrt(width))[:, None]
        rest[:, level] = np.linalg.norm(left, axis=1)
    return bits, along, rest


def _unit(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = whole.astype(np.float64)
    norms = np.linalg.norm(values, axis=1)
    return values / np.where(norms > 0, norms, 1.0)[:, None], norms


def _code(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, matrix in matrices(batch.column(3)):
                whole = np.clip(np.floor(matrix * scale), -MOST, MOST).astype(np.int32)
                units, norms = _unit(whole)
                bits, along, rest = one_bit_codes(rotated(units))
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at),
                     pa.array(np.full(len(rows), matrix.shape[1], np.int32)), packed(whole), pa.array(norms),
                     packed(bits.reshape(len(rows), -1)), packed(along), packed(rest)],
                    names=[f.split()[0] for f in CODED.split(", ")])

    return run


class Block:
    """Rows of one block, those of a label side by side."""

    def __init__(self, table: pa.Table, dim: int):
        names = np.array(table["grp"].to_pylist(), dtype=str)
        order = np.argsort(names, kind="stable")
        table, names = table.take(pa.array(order)), names[order]
        groups, starts = np.unique(names, return_index=True)
        ends = np.append(starts[1:], len(names))
        self.spans = {g: (int(a), int(b)) for g, a, b in zip(groups.tolist(), starts, ends)}
        self.rids, self.ids, self.norms = (table[c].to_numpy() for c in ("rid", "vec_id", "norm"))
        self.whole = unpacked(table["vector"], np.int32, dim)
        self.largest = int(np.abs(self.whole).max(initial=0))
        width = 64
        while width < dim:
            width *= 2
        self.bits = unpacked(table["bits"], np.uint64, LEVELS * width // 64).reshape(len(table), LEVELS, -1)
        self.along, self.rest = (unpacked(table[c], np.float64, LEVELS) for c in ("along", "rest"))

    def scores(self, at: np.ndarray, query: Query) -> np.ndarray:
        """Exact scores; doubles are used only where all sums fit them."""
        if self.largest * query.largest * len(query.whole) < 1 << 53:
            return (self.whole[at].astype(np.float64) @ query.whole.astype(np.float64)).astype(np.int64)
        return self.whole[at].astype(np.int64) @ query.whole.astype(np.int64)

    def narrowed(self, at: np.ndarray, query: Query, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        """The rows of ``at`` that ``keep``, given the ends of their scores, cannot rule out."""
        estimate = np.zeros(len(at))
        for level in range(LEVELS):
            if len(at) <= FEW:
                break
            on_code = query.on_codes(self.bits[at, level])
            estimate += self.along[at, level] * on_code
            rest = self.rest[at, level]
            beside = np.sqrt(np.maximum(0.0, 1.0 - np.maximum(0.0, np.abs(on_code) - query.error) ** 2))
            reach = beside * rest + query.error * (1.0 + rest) + ROOM
            lengths = query.norm * self.norms[at]
            kept = keep(np.ceil((estimate - reach) * lengths - ROOM), np.floor((estimate + reach) * lengths + ROOM))
            at, estimate = at[kept], estimate[kept]
        return at

    def best(self, at: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        return np.lexsort((self.rids[at], self.ids[at], -scores))[:k]


class Query:
    """A rotated anchor as bit planes of small whole numbers, and how far these are from it."""

    def __init__(self, whole: np.ndarray):
        self.whole, self.largest = whole, int(np.abs(whole).max(initial=0))
        units, norms = _unit(whole[None, :])
        self.norm, w = float(norms[0]), rotated(units)[0]
        self.low = float(w.min())
        self.step = max((float(w.max()) - self.low) / ((1 << PLANES) - 1), 1e-300)
        levels = np.clip(np.rint((w - self.low) / self.step), 0, (1 << PLANES) - 1).astype(np.uint16)
        quantised = self.low + self.step * levels
        self.error, self.total, self.width = float(np.linalg.norm(w - quantised)), float(quantised.sum()), len(w)
        self.planes = np.stack([
            np.packbits((levels >> j & 1).astype(np.uint8), bitorder="little").view(np.uint64) for j in range(PLANES)])

    def on_codes(self, bits: np.ndarray) -> np.ndarray:
        """Products of the quantised query with codes, by popcounts."""
        ones = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        weighted = np.zeros(len(bits), np.int64)
        for j in range(PLANES):
            weighted += np.bitwise_count(bits & self.planes[j]).sum(axis=1, dtype=np.int64) << j
        return (2.0 * (self.low * ones + self.step * weighted) - self.total) / np.sqrt(self.width)


def _nth_largest(values: np.ndarray, n: int) -> float:
    return float(np.partition(values, len(values) - n)[len(values) - n]) if len(values) >= n else -np.inf


def _positives(k: int):
    """The ``k`` best rows of a block with the anchor's label, for each anchor."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "rid": [], "vec_id": [], "score": []}
        if len(rows) and len(anchors):
            dim = key[0].as_py()
            block = Block(rows, dim)
            whole = unpacked(anchors["vector"], np.int32, dim)
            for rid, grp, vector in zip(anchors["rid"].to_pylist(), anchors["grp"].to_pylist(), whole):
                at = np.arange(*block.spans.get(grp, (0, 0)))
                at = at[block.rids[at] != rid]
                query = Query(vector)
                at = block.narrowed(at, query, lambda low, high: high >= _nth_largest(low, k))
                scores = block.scores(at, query)
                best = block.best(at, scores, k)
                out["anchor"].append(np.full(len(best), rid))
                out["rid"].append(block.rids[at[best]])
                out["vec_id"].append(block.ids[at[best]])
                out["score"].append(scores[best])
        return _table(out)

    return run


def _negatives(k: int, low_percent: int, high_percent: int):
    """For each anchor and positive, the ``k`` best rows of a block with another label and a score in the band."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = {"anchor": [], "positive": [], "rid": [], "vec_id": [], "score": []}
        if len(rows) and len(anchors):
            dim = key[0].as_py()
            block = Block(rows, dim)
            whole = unpacked(anchors["vector"], np.int32, dim)
            for rid, grp, bands, vector in zip(
                    anchors["rid"].to_pylist(), anchors["grp"].to_pylist(), anchors["bands"].to_pylist(), whole):
                first, end = block.spans.get(grp, (0, 0))
                at = np.concatenate([np.arange(first), np.arange(end, len(block.rids))])
                query = Query(vector)
                # whole numbers s with low_percent * positive <= 100 * s <= high_percent * positive
                ends = {b["score"]: (-(-low_percent * b["score"] // 100), high_percent * b["score"] // 100) for b in bands}
                open_bands = [b for b in ends.values() if b[0] <= b[1]]

                def keep(low, high):
                    kept = np.zeros(len(low), bool)
                    for least, most in open_bands:
                        surely = low[(low >= least) & (high <= most)]
                        kept |= (low <= most) & (high >= max(least, _nth_largest(surely, k)))
                    return kept

                at = block.narrowed(at, query, keep) if open_bands else at[:0]
                scores = block.scores(at, query)
                for b in bands:
                    least, most = ends[b["score"]]
                    inside = np.flatnonzero((scores >= least) & (scores <= most))
                    best = inside[block.best(at[inside], scores[inside], k)]
                    out["anchor"].append(np.full(len(best), rid))
                    out["positive"].append(np.full(len(best), b["rid"]))
                    out["rid"].append(block.rids[at[best]])
                    out["vec_id"].append(block.ids[at[best]])
                    out["score"].append(scores[best])
        return _table(out)

    return run


def _table(columns: dict[str, list]) -> pa.Table:
    return pa.table({c: pa.array(np.concatenate(v) if v else [], pa.int64()) for c, v in columns.items()})


def hard_negatives(
    df: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100,
    scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` marks the rows of ``df`` that are anchors.  Components become ``floor(scale * x)`` and a score
    is a product of two such vectors; higher scores come first, then smaller ids, then rows as they
    are read.  Positives are an anchor's ``positives`` first other rows of its label.  For each,
    the first ``negatives`` rows of other labels with ``low_percent`` to ``high_percent`` per cent of the
    positive's score are returned; a negative positive score leaves no such row.

    Rows take no part if their id, label or vector is null or a component is null or not finite.
    An empty vector scores 0.  Vectors of different lengths never meet.  Components beyond ``MOST`` after
    scaling saturate.  Rows that repeat an id are rows of their own, so an anchor and its copy
    are positives of each other.  Other columns are not looked at; an empty table gives no rows.
    """
    prepared(df.sparkSession)
    usable = col(id_col).isNotNull() & col(label_col).isNotNull() & col(vector_col).isNotNull()
    base = df.filter(usable).select(
        F.monotonically_increasing_id().alias("rid"), col(id_col).cast("bigint").alias("vec_id"),
        null_safe_key(col(label_col)).alias("grp"), col(vector_col).cast("array<double>").alias("v"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"))
    # one scan codes all rows; the mark of an anchor rides in the label's first character
    marked = base.withColumn("grp", F.concat(F.when(F.col("anchor"), "a").otherwise("-"), "grp"))
    coded = written(marked.select("rid", "vec_id", "grp", "v").mapInArrow(_code(scale), CODED).withColumns({
        "anchor": F.col("grp").startswith("a"), "grp": F.substring("grp", 2, 1 << 30)}), "coded-vectors")

    def blocks(n: Column) -> Column:
        size = F.greatest(F.lit(LEAST_ROWS), F.floor(F.lit(BLOCK_VALUES) / F.greatest(F.col("dim"), F.lit(1))))
        return F.greatest(F.lit(1), F.ceil(n / size)).cast("int")

    sizes = coded.groupBy("dim").agg(
        blocks(F.count("*")).alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.count_if("anchor") / F.lit(ANCHORS))).cast("int").alias("sets"))

    def dealt(rows: DataFrame, own: str, other: str, into: str, across: str) -> DataFrame:
        placed = rows.join(sizes, "dim").withColumn(into, F.pmod(F.xxhash64("rid", F.lit(into)), F.col(own)).cast("int"))
        return placed.withColumn(across, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    keys = ["dim", "block", "anchor_set"]
    left = dealt(coded.drop("anchor"), "blocks", "sets", "block", "anchor_set").select(
        *keys, "rid", "vec_id", "grp", "vector", "norm", "bits", "along", "rest")
    asked = coded.filter("anchor").select("dim", "rid", "grp", "vector")

    def meet(asked: DataFrame, run, schema: str) -> DataFrame:
        right = dealt(asked, "sets", "blocks", "anchor_set", "block").drop("blocks", "sets")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides stem from one table
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id", "rid")
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    found = meet(asked, _positives(positives), "anchor bigint, rid bigint, vec_id bigint, score bigint")
    chosen = written(first(found, ["anchor"], positives).drop("rank"), "positives")
    bands = chosen.groupBy("anchor").agg(F.collect_list(F.struct("rid", "score")).alias("bands"))
    asked = asked.join(bands.withColumnRenamed("anchor", "rid"), "rid").select("dim", "rid", "grp", "vector", "bands")
    found = meet(
        asked, _negatives(negatives, low_percent, high_percent),
        "anchor bigint, positive bigint, rid bigint, vec_id bigint, score bigint")
    ranked = first(found, ["anchor", "positive"], negatives)
    names = coded.filter("anchor").select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.select(
        "anchor", F.col("rid").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
