"""Exact k nearest neighbours inside groups, without comparing all pairs.

Points go to the nearest of a few pivots; each such cell is dealt out to blocks of
bounded size.  Searching a point's own block bounds how far its k-th neighbour can
be, and only the cells whose ball comes that close are searched as well.  For that,
small blocks lie together in tiles: a query goes once to each tile that holds such a
cell, however many of them it holds.  A tile meets the queries of one other tile at a
time, so no task ever holds more than two tiles, whatever share of the points falls into
one cell.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.hashed import flag_lowest_by
from ..plans.lookup import maybe_broadcast, salts_for
from ..plans.names import col
from ..plans.scratch import written

PIVOTS = 4_096  # over all groups together
TILE_ROWS = 2_048  # of blocks that are searched together, where a block is not larger
TIE_PLACES = 9  # distances equal to so many places are ties, broken by key
_CHUNK_CELLS = 4_000_000  # doubles held at once while distances are computed
_PRODUCT_CELLS = 250_000  # entries of a matrix product screened at once: they stay in the cache
_CROWDED = 8  # times k: a query that many members come close to is held to the best k of them before these are measured


def nearest_neighbours(
    df: DataFrame, key: str, vector: str, k: int, group: str | None = None, block_rows: int = 2048,
    probes: int | None = None,
) -> DataFrame:
    """``group, key, rank, neighbour, distance`` for the ``k`` nearest other points.

    Euclidean distance; ``key`` is a unique integer.  Points of a group that is not
    larger than ``k`` get all the others.  The search runs on distinct vectors, so
    copies of one vector do not meet each other.  The search is exact unless the caller sets
    ``probes``: then a point is compared with its own block and the ``probes`` nearest cells
    only, which is how vectors that no cell separates are searched in bounded work.
    """
    label = col(group) if group else F.lit(0)
    points = written(
        df.select(label.alias("grp"), col(key).cast("bigint").alias("key"),
                  col(vector).cast("array<double>").alias("v")),
        "knn-points",
    )
    vectors = written(
        points.groupBy("grp", "v").agg(F.min("key").alias("key"), F.count("*").alias("copies")), "knn-vectors"
    )
    found = _search(vectors.drop("copies"), k, block_rows, probes)
    copied = vectors.filter("copies > 1")
    if not copied.isEmpty():
        found = _spread_to_copies(points, copied, written(_best(found, k), "knn-vectors-found"), k)
    return _best(found, k).withColumnsRenamed({"grp": group or "grp"})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("grp", "key").orderBy(F.round("distance", TIE_PLACES), "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("grp", "key", "rank", "neighbour", "distance")
    )


def _spread_to_copies(points: DataFrame, copied: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """From neighbours of vectors to neighbours of points.

    Of each copied vector only the ``k + 1`` smallest keys can be neighbours of
    anything, and all copies share one list of ``k + 1`` candidates.
    """
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    owners = copied.select("grp", "v", F.col("key").alias("owner"), salts_for(F.col("copies")).alias("salts"))
    # the join that finds the owner of each copy may be split by Spark: it is not aggregated above
    copies = written(
        points.join(owners, ["grp", "v"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
        .select("grp", "owner", "key", "salt"), "knn-copies",
    )
    smallest = Window.partitionBy("grp", "owner").orderBy("key")
    shown = copies.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1).select(
        "grp", "owner", "key"
    )
    others = (
        found.join(shown.select("grp", F.col("owner").alias("neighbour"), F.col("key").alias("copy")),
                   ["grp", "neighbour"], "left")
        .select("grp", "key", F.coalesce("copy", "neighbour").alias("neighbour"), "distance")
    )
    same = shown.select("grp", F.col("owner").alias("key"), F.col("key").alias("neighbour"), F.lit(0.0).alias("distance"))
    lists = written(_best(others.unionAll(same), k + 1).drop("rank"), "knn-lists")
    single = lists.join(copied.select("grp", "key"), ["grp", "key"], "left_anti")
    shared = lists.withColumnRenamed("key", "owner").join(owners.select("grp", "owner", "salts"), ["grp", "owner"])
    shared = shared.withColumn("salt", salts).drop("salts")
    several = (
        copies.join(shared, ["grp", "owner", "salt"]).filter(F.col("neighbour") != F.col("key"))
        .select("grp", "key", "neighbour", "distance")
    )
    return single.unionAll(several)


def _search(points: DataFrame, k: int, block_rows: int, probes: int | None) -> DataFrame:
    """Candidates that include the ``k`` nearest of every point; vectors are distinct.

    Groups of one block are searched as they are, however many there are.
    """
    fields = {f.name: f.dataType.simpleString() for f in points.schema}
    schema = f"grp {fields['grp']}, key bigint, neighbour bigint, distance double"
    sizes = written(points.groupBy("grp").agg(F.count("*").alias("n")), "knn-groups")
    large = sizes.filter(F.col("n") > block_rows)
    whole = sizes.filter(F.col("n") <= block_rows).select(F.col("grp").alias("_g"))
    alone = points.join(maybe_broadcast(whole), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g")
    found = alone.groupBy("grp").applyInPandas(_search_home(k), schema)
    if large.isEmpty():
        return found
    named = large.select(F.col("grp").alias("_g"))
    rest = written(points.join(maybe_broadcast(named), F.col("grp").eqNullSafe(F.col("_g"))).drop("_g"), "knn-large")
    return found.unionAll(_search_cells(rest, large, k, block_rows, probes, schema))


def _search_cells(points: DataFrame, sizes: DataFrame, k: int, block_rows: int, probes: int | None, schema: str) -> DataFrame:
    pivots = _pivots(points, sizes, block_rows)
    placed = _place(points, pivots, block_rows)
    cells = _tiled(_cells(placed), block_rows)
    members = placed.withColumn("sub", _sub("key", F.col("subs")))
    grp = points.schema["grp"].dataType.simpleString()
    spans = points.sparkSession.createDataFrame(
        [(c["grp"], c["cell"], c["first"], c["tiles"]) for c in cells], f"grp {grp}, cell int, first int, tiles int")
    # the blocks of a cell are dealt out to its tiles in turn; no more cells than pivots
    tile = F.col("first") + F.floor(F.col("sub") * F.col("tiles") / F.col("subs")).cast("int")
    members = members.join(F.broadcast(spans), ["grp", "cell"]).withColumn("tile", tile).drop("subs", "first", "tiles")
    home = written(members.groupBy("grp", "cell", "sub").applyInPandas(_search_home(k), schema), "knn-home")
    reach = home.groupBy("key").agg(F.count("*").alias("have"), F.max("distance").alias("far"))
    routes = written(_route(members.join(reach, "key", "left"), pivots, cells, k, probes), "knn-routes")
    return home.unionAll(_search_others(routes, members, k, schema))


def _tiled(cells: list, block_rows: int) -> list[dict]:
    """Each cell with its first tile and the number of them.

    Where blocks are small, cells share a tile while there is room; blocks of the size of a tile are tiles themselves.
    """
    room, shared = max(TILE_ROWS, block_rows), block_rows < TILE_ROWS
    out, filled, used = [], {}, {}
    for c in sorted(cells, key=lambda c: c["cell"]):
        g, n = c["grp"], c["n"]
        tiles = min(c["subs"], ceil(n / room))
        if not shared or tiles > 1 or g not in used or filled[g] + n > room:
            first = used.get(g, 0)
            used[g] = first + tiles
            # the tiles of a large cell are its own
            filled[g] = n if tiles == 1 else room
        else:
            first = used[g] - 1
            filled[g] += n
        out.append({**c.asDict(), "first": first, "tiles": tiles})
    return out


def _sub(key: str, subs):
    return F.pmod(F.xxhash64(key), subs.cast("bigint")).cast("int")


def _pivots(points: DataFrame, sizes: DataFrame, block_rows: int) -> list:
    """One pivot per block of each large group, in all about ``PIVOTS`` where there would be more.

    Fewer pivots make larger cells, which hold more blocks: more work, the same neighbours.
    """
    blocks = F.ceil(F.col("n") / block_rows)
    total = sizes.agg(F.sum(blocks)).first()[0]
    count = F.greatest(F.lit(1), F.floor(blocks * min(1.0, PIVOTS / total))).cast("bigint")
    quota = sizes.select("grp", count.alias("k"))
    rows = flag_lowest_by(points, ["grp"], ["key"], "pivot", quota, "chosen").filter("chosen").collect()
    by_group: dict = {}
    for r in sorted(rows, key=lambda r: r["key"]):
        by_group.setdefault(r["grp"], []).append(r["v"])
    return [(g, np.array(v, dtype=float)) for g, v in by_group.items()]


def _place(points: DataFrame, pivots: list, block_rows: int) -> DataFrame:
    """Nearest pivot of each point and the number of blocks of that cell."""
    lookup = dict(pivots)

    def assign(batches):
        for batch in batches:
            for g, part in batch.groupby("grp"):
                points, centres = np.stack(part["v"].to_numpy()), lookup[g]
                near = np.concatenate([rough.argmin(axis=1) for _, rough, _ in _products(points, centres)])
                diff = points - centres[near]
                yield part.assign(cell=near.astype("int32"), off=np.sqrt(np.einsum("nd,nd->n", diff, diff)))

    fields = points.schema
    grp = fields["grp"].dataType.simpleString()
    placed = points.mapInPandas(assign, f"grp {grp}, key bigint, v array<double>, cell int, off double")
    placed = written(placed, "knn-placed")
    # no more cells than pivots
    subs = placed.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("subs"))
    return placed.join(F.broadcast(subs), ["grp", "cell"])


def _cells(placed: DataFrame) -> list:
    return placed.groupBy("grp", "cell").agg(
        F.max("subs").alias("subs"), F.max("off").alias("radius"), F.min("off").alias("inner"), F.count("*").alias("n")
    ).collect()


def _gaps(a: np.ndarray, b: np.ndarray):
    """Distances between the rows of two matrices: ``(slice of a, distances)`` in bounded pieces."""
    step = max(1, _CHUNK_CELLS // max(1, b.size))
    for start in range(0, len(a), step):
        rows = slice(start, start + step)
        diff = a[rows, None, :] - b[None, :, :]
        yield rows, np.sqrt(np.einsum("qmd,qmd->qm", diff, diff))


def _products(a: np.ndarray, b: np.ndarray):
    """Squared distances by a matrix product: ``(slice of a, squares, the most that rounding adds or takes per row)``."""
    bb = np.einsum("md,md->m", b, b)
    step = max(1, _PRODUCT_CELLS // max(1, len(b)))
    for start in range(0, len(a), step):
        rows = slice(start, start + step)
        q = a[rows]
        qq = np.einsum("qd,qd->q", q, q)
        rough = q @ (-2.0 * b.T)
        rough += qq[:, None]
        rough += bb[None, :]
        yield rows, np.maximum(rough, 0.0, out=rough), 1e-15 * (q.shape[1] + 4) * (qq + np.fmax.reduce(bb, initial=0.0))


def _closest(
    grp, queries: pd.DataFrame, members: pd.DataFrame, k: int, barred=None, bound: np.ndarray | None = None
) -> pd.DataFrame:
    """The k best members for every query; ties go to the smaller key.

    ``barred`` tells for a slice of the queries which members they do not meet, by default those of their own key.
    ``bound`` is a distance per query beyond which no member is wanted: those of a tile are mostly farther.
    A matrix product screens all pairs; only those that may be among the best are measured exactly.
    """
    qkeys, mkeys = queries["key"].to_numpy(), members["key"].to_numpy()
    a, b = np.stack(queries["v"].to_numpy()), np.stack(members["v"].to_numpy())
    largest = np.einsum("md,md->m", b, b).max(initial=0.0)
    parts = []
    for rows, rough, _ in _products(a, b):
        q, keys = a[rows], qkeys[rows]
        qq = np.einsum("qd,qd->q", q, q)
        out = keys[:, None] == mkeys[None, :] if barred is None else barred(rows)
        if out is not None:
            rough[out] = np.inf

        def screened(which, edge: np.ndarray):
            # room for what rounding does to the product and to ties
            room = 1e-10 * (qq[which] + largest) + 4.0 * 10.0 ** -TIE_PLACES * np.sqrt(np.where(np.isfinite(edge), edge, 0.0)) + 1e-16
            return rough[which] <= (edge + room)[:, None]

        edge = np.full(len(q), np.inf) if bound is None else bound[rows] ** 2
        close = screened(slice(None), edge) if bound is not None else None
        crowded = np.arange(len(q)) if close is None else np.flatnonzero(close.sum(axis=1) > _CROWDED * k)
        if rough.shape[1] > k and len(crowded):
            edge[crowded] = np.minimum(edge[crowded], np.partition(rough[crowded], k - 1, axis=1)[:, k - 1])
            if close is not None:
                close[crowded] = screened(crowded, edge[crowded])
        if close is None:
            close = screened(slice(None), edge)
        at, to = np.nonzero(close)
        met = np.isfinite(rough[at, to])
        at, to = at[met], to[met]
        diff = q[at] - b[to]
        exact = np.sqrt(np.einsum("nd,nd->n", diff, diff))
        order = np.lexsort((mkeys[to], np.round(exact, TIE_PLACES), at))
        at, to, exact = at[order], to[order], exact[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        best = rank < k
        parts.append(pd.DataFrame({
            "grp": grp, "key": keys[at[best]], "neighbour": mkeys[to[best]], "distance": exact[best],
        }))
    return pd.concat(parts)


def _search_home(k: int):
    def search(block: pd.DataFrame) -> pd.DataFrame:
        return _closest(block["grp"].iloc[0], block, block, k)

    return search


def _route(queries: DataFrame, pivots: list, cells: list, k: int, probes: int | None) -> DataFrame:
    """One row per query and tile with a cell that may hold a closer point; with ``probes``, also which cells these are."""
    centres = dict(pivots)
    shape = {}
    for g in centres:
        own = [c for c in cells if c["grp"] == g]
        shape[g] = (
            np.array([c["cell"] for c in own], dtype="int32"),
            np.array([c["radius"] for c in own]),
            np.array([c["inner"] for c in own]),
            np.array([c["first"] for c in own], dtype="int64"),
            np.array([c["tiles"] for c in own], dtype="int64"),
        )

    def measured(points: np.ndarray, others: np.ndarray):
        if probes is not None:
            # which cells are the nearest is told by exact distances
            yield from ((rows, gaps, 0.0) for rows, gaps in _gaps(points, others))
        else:
            yield from ((rows, np.sqrt(squares), np.sqrt(error)) for rows, squares, error in _products(points, others))

    def route(batches):
        for batch in batches:
            for g, part in batch.groupby("grp"):
                ids, radius, inner, first, tiles = shape[g]
                far = np.where(part["have"].fillna(0).to_numpy() >= k, part["far"].to_numpy(dtype=float), np.inf)
                for piece, gaps, slack in measured(np.stack(part["v"].to_numpy()), centres[g][ids]):
                    nearest_possible = np.maximum(gaps - radius, inner - gaps)
                    # a little slack keeps rounding from hiding a tie
                    near = nearest_possible <= (far[piece] + 10.0 ** -TIE_PLACES + slack)[:, None]
                    if probes is not None and probes < gaps.shape[1]:
                        near &= gaps <= np.partition(gaps, probes - 1, axis=1)[:, probes - 1:probes]
                    q, c = np.nonzero(near)
                    # every tile of each cell, then each tile once
                    n, width = tiles[c], int((first + tiles).max())
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    met, cell = np.repeat(q * width + first[c], n) + nth, np.repeat(ids[c], n)
                    order = np.argsort(met, kind="stable")
                    met, begin = np.unique(met[order], return_index=True)
                    rows = part.iloc[piece].iloc[met // width]
                    bound = far[piece][met // width]
                    yield pd.DataFrame({
                        "grp": rows["grp"].to_numpy(), "key": rows["key"].to_numpy(), "v": rows["v"].to_numpy(),
                        "from_cell": rows["cell"].to_numpy(), "from_sub": rows["sub"].to_numpy(),
                        "from_tile": rows["tile"].to_numpy(), "tile": (met % width).astype("int32"), "bound": bound,
                        "cells": None if probes is None else np.split(cell[order], begin[1:]) if len(met) else [],
                    })

    grp = queries.schema["grp"].dataType.simpleString()
    return queries.mapInPandas(
        route, f"grp {grp}, key bigint, v array<double>, from_cell int, from_sub int, from_tile int, tile int, "
        "bound double, cells array<int>"
    )


def _search_others(routes: DataFrame, members: DataFrame, k: int, schema: str) -> DataFrame:
    """Search the routed tiles; queries of one tile against members of another, or of other blocks of their own.

    The distances found in a query's own block bound those that are looked for, so few tiles return rows.
    """
    pair = ["grp", "tile", "from_tile"]
    met = routes.select("grp", "tile", F.col("from_tile").alias("ft")).distinct()
    targets = members.select("grp", "cell", "sub", "tile", "key", "v").join(met, ["grp", "tile"])

    def search(queries: pd.DataFrame, tile: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or tile.empty:
            return pd.DataFrame({"grp": [], "key": [], "neighbour": [], "distance": []})
        cell, sub = tile["cell"].to_numpy(), tile["sub"].to_numpy()
        own_cell, own_sub = queries["from_cell"].to_numpy(), queries["from_sub"].to_numpy()
        allowed = queries["cells"].to_numpy()
        at_home = queries["tile"].iloc[0] == queries["from_tile"].iloc[0]

        def barred(rows: slice) -> np.ndarray | None:
            # the own block, which lies in the own tile, has been searched
            out = (own_cell[rows, None] == cell[None, :]) & (own_sub[rows, None] == sub[None, :]) if at_home else None
            if allowed[0] is not None:
                others = np.stack([~np.isin(cell, a) for a in allowed[rows]])
                out = others if out is None else out | others
            return out

        return _closest(queries["grp"].iloc[0], queries, tile, k, barred, queries["bound"].to_numpy(dtype=float))

    left = routes.select(*pair, "key", "v", "from_cell", "from_sub", "bound", "cells").groupBy(*pair)
    right = targets.select("grp", "tile", F.col("ft").alias("from_tile"), "cell", "sub", "key", "v").groupBy(*pair)
    return left.cogroup(right).applyInPandas(search, schema)
