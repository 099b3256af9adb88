"""Near-duplicate embeddings by products of int8 tiles.

Equal vectors of a label are one node.  The nodes of a label are dealt into tiles of bounded
size, and every pair of tiles is one task.  A node's unit vector ``u`` is held as ``s * q`` with
integers ``q`` from -127 to 127; the length ``e`` of what that leaves out is measured, so

    cos(a, b) <= s_a s_b (q_a . q_b) + |s_a q_a| e_b + e_a

for any two nodes (Cauchy-Schwarz).  The integer product of two tiles gives this bound for all
their pairs at once; only pairs whose bound reaches the threshold are computed again from the
full vectors.  A task returns, for each node, how many rows it is linked with, and a spanning
forest of its links: never the pairs themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..plans.scratch import managed
from .common import col, null_safe_key, prepared, written
from .components import components
from .vectors import matrices, packed, unpacked

#: most nodes and bytes of a tile; side of the squares that a task works on
TILE_ROWS, TILE_BYTES, SIDE = 4096, 32 << 20, 1024
#: room for the rounding of doubles
ROOM = 1e-9
#: largest sum of products that float32 holds exactly
EXACT_FLOAT32 = 1 << 24


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes, scaled by a power of two so that no square overflows; others as null."""
    for batch in batches:
        out: list[bytes | None] = [None] * batch.num_rows
        for rows, matrix in matrices(batch.column(2)):
            if matrix.shape[1]:
                largest = np.abs(matrix).max(axis=1)
                _, exponents = np.frexp(largest)
                scaled = np.ldexp(matrix, -exponents[:, None]) + 0.0  # no negative zero
                for i, row, most in zip(rows.tolist(), scaled, largest):
                    if most > 0:
                        out[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["rid", "grp", "vector"])


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``codes, scale, length of the coded vector, length of what it leaves out`` of unit vectors."""
    scale = np.abs(units).max(axis=1) / 127.0
    codes = np.rint(units / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    return codes, scale, np.linalg.norm(coded, axis=1), np.linalg.norm(units - coded, axis=1)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(v) // 8 for v in batch.column(2).to_pylist()])
        for dim in np.unique(sizes).tolist():
            part = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            units = unpacked(pa.chunked_array([part.column(2)]), np.float64, dim)
            units = units / np.linalg.norm(units, axis=1)[:, None]
            codes, scale, length, error = quantise(units)
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.full(len(units), dim, np.int32)), packed(codes), pa.array(scale),
                 pa.array(length), pa.array(error)],
                names=["node", "grp", "vector", "copies", "dim", "code", "scale", "length", "error"])


class _Tile:
    def __init__(self, table: pa.Table, dim: int):
        self.nodes, self.copies = table["node"].to_numpy(), table["copies"].to_numpy()
        self.vectors = unpacked(table["vector"], np.float64, dim)
        self.norms = np.sqrt(np.einsum("nd,nd->n", self.vectors, self.vectors))
        # sums of products of whole numbers: exact
        kind = np.float32 if 127 * 127 * dim < EXACT_FLOAT32 else np.float64
        self.codes = unpacked(table["code"], np.int8, dim).astype(kind)
        self.scale, self.length, self.error = (table[c].to_numpy() for c in ("scale", "length", "error"))


def _possible(a: _Tile, b: _Tile, i: slice, j: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two squares whose bound reaches the threshold."""
    bound = (a.codes[i] @ b.codes[j].T).astype(np.float64)
    bound *= a.scale[i][:, None]
    bound *= b.scale[j][None, :]
    bound += a.length[i][:, None] * b.error[j][None, :]
    bound += a.error[i][:, None]
    p, q = np.nonzero(bound >= least - ROOM)
    return p + i.start, q + j.start


def _cosines(a: _Tile, b: _Tile, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    out = np.empty(len(p))
    step = max(1, (1 << 21) // a.vectors.shape[1])
    for at in range(0, len(p), step):
        x, y = p[at:at + step], q[at:at + step]
        out[at:at + step] = np.einsum("nd,nd->n", a.vectors[x], b.vectors[y]) / (a.norms[x] * b.norms[y])
    return out


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (positions of least members) after linking ``p`` with ``q``."""
    while True:
        a, b = label[p], label[q]
        if (a == b).all():
            return label
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]


def _linked(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, first, second = key[1].as_py(), key[2].as_py(), key[3].as_py()
        tiles = table["tile"].to_numpy()
        a = _Tile(table.filter(pa.array(tiles == first)), dim)
        b = a if first == second else _Tile(table.filter(pa.array(tiles == second)), dim)
        nodes = a.nodes if b is a else np.concatenate([a.nodes, b.nodes])
        offset = 0 if b is a else len(a.nodes)
        copies = a.copies if b is a else np.concatenate([a.copies, b.copies])
        label, links = np.arange(len(nodes)), np.zeros(len(nodes), np.int64)
        for x in range(0, len(a.nodes), SIDE):
            for y in range(x if b is a else 0, len(b.nodes), SIDE):
                p, q = _possible(a, b, slice(x, x + SIDE), slice(y, y + SIDE), least)
                if b is a:
                    p, q = p[p < q], q[p < q]
                found = _cosines(a, b, p, q) >= least
                p, q = p[found], q[found] + offset
                np.add.at(links, p, copies[q])
                np.add.at(links, q, copies[p])
                label = _merge(label, p, q)
        some = np.flatnonzero(links)
        return pa.table({"node": nodes[some], "n_links": links[some], "other": nodes[label[some]]})

    return run


def embedding_duplicates(
    df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str | None = "label",
) -> DataFrame:
    """One row per row of ``df``: ``vec_id, n_links, component_id, kept``.

    Rows of one label (of the whole table without ``label_col``) are linked where the cosine of their
    vectors is at least ``threshold``.  ``n_links`` counts the other rows linked directly, copies
    included; ``component_id`` is the least id that links reach, ``kept`` marks the row with it.
    Rows stand alone (no links, their own id, kept) if the id or the label is null or the vector is
    null, empty, zero or holds null or non-finite components; vectors of different lengths are
    not linked.  Rows that repeat an id are rows of their own and are kept together.  Long vectors
    make smaller tiles.  Other columns are not looked at; an empty table gives an empty result.
    """
    spark = prepared(df.sparkSession)
    label = null_safe_key(col(label_col)) if label_col else F.lit("=")
    usable = col(id_col).isNotNull() & (col(label_col).isNotNull() if label_col else F.lit(True))
    rows = written(df.select(
        F.monotonically_increasing_id().alias("rid"), col(id_col).cast("bigint").alias("vec_id"),
        F.when(usable, label).alias("grp"), F.when(usable, col(vector_col).cast("array<double>")).alias("v")), "vectors")
    whole = written(
        rows.select("rid", "grp", "v").mapInArrow(_usable, "rid bigint, grp string, vector binary")
        .filter("grp IS NOT NULL AND vector IS NOT NULL"), "usable-vectors")
    nodes = written(
        whole.groupBy("grp", "vector").agg(F.min("rid").alias("node"), F.count("*").alias("copies"))
        .select("node", "grp", "vector", "copies").mapInArrow(
            _coded, "node bigint, grp string, vector binary, copies bigint, dim int, code binary, scale double,"
            " length double, error double"), "vector-nodes")
    with managed(spark):
        most = F.greatest(F.lit(64), F.least(F.lit(TILE_ROWS), F.floor(F.lit(TILE_BYTES) / (9 * F.col("dim")))))
        sizes = nodes.groupBy("grp", "dim").agg(F.ceil(F.count("*") / most).cast("int").alias("tiles"))
        dealt = nodes.join(sizes, ["grp", "dim"]).withColumn(
            "tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(
            "grp", "dim", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
            "tile", "node", "copies", "vector", "code", "scale", "length", "error")
        found = written(
            pairs.groupBy("grp", "dim", "first", "second").applyInArrow(
                _linked(threshold), "node bigint, n_links bigint, other bigint"), "tile-links")
        known = components(found.filter("node != other").select(F.col("node").alias("u"), F.col("other").alias("v")))
        counts = found.groupBy("node").agg(F.sum("n_links").alias("n_links"))
        classes = written(
            nodes.select("node", "grp", "vector", "copies").join(known, "node", "left").join(counts, "node", "left")
            .select("grp", "vector", F.coalesce("component", "node").alias("class"),
                    (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
        placed = written(
            whole.join(classes, ["grp", "vector"]).select("rid", "class", "n_links"), "placed", outlives=True)
    named = placed.join(rows.select("rid", "vec_id"), "rid")
    least = named.groupBy("class").agg(F.min("vec_id").alias("component_id"))
    return (
        rows.select("rid", "vec_id").join(placed, "rid", "left").join(least, "class", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
