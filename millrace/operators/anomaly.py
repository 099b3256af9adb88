"""Isolation forest: outliers over several columns at once.

The sample that the trees are grown from has a fixed size, so growing costs the same
for any table; scoring is one narrow pass over all rows in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.hashed import flag_lowest, hash_text
from ..plans.names import col
from ..plans.quantile import quantiles
from ..plans.ranking import row_count
from ..plans.scratch import written

# Fixed values.
TREES = 100
TREE_ROWS = 256
CONTAMINATION = 0.025
_EULER = 0.5772156649015329

_NODES = "tree int, node int, feature int, cut double, left int, right int, size int"


def expected_depth(n):
    """Mean depth of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        depth = 2.0 * (np.log(n - 1.0) + _EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, depth, np.where(n == 2, 1.0, 0.0))


def _grow(columns: list[str], seed: int, tree_rows: int):
    """Grow the tree of one group of at most ``tree_rows`` rows."""
    limit = int(np.ceil(np.log2(max(tree_rows, 2))))

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        data = rows.sort_values("row_key")[columns].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes, todo = [], [(0, np.arange(len(data)), 0)]
        following = 1
        while todo:
            node, members, depth = todo.pop()
            part = data[members]
            low, high = part.min(axis=0), part.max(axis=0)
            usable = np.flatnonzero(high > low)
            if depth >= limit or len(members) <= 1 or len(usable) == 0:
                nodes.append((tree, node, -1, 0.0, -1, -1, len(members)))
                continue
            feature = int(rng.choice(usable))
            cut = float(rng.uniform(low[feature], high[feature]))
            goes_left = part[:, feature] <= cut
            nodes.append((tree, node, feature, cut, following, following + 1, len(members)))
            todo += [(following, members[goes_left], depth + 1), (following + 1, members[~goes_left], depth + 1)]
            following += 2
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "size"])

    return grow


def grow_forest(
    df: DataFrame, row_key: str, columns: Sequence[str], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42
) -> DataFrame:
    """Nodes of all trees: at most ``trees * 2 * tree_rows`` rows whatever the input.

    One random order of at most ``trees * tree_rows`` rows is dealt out in slices; a
    smaller table starts again from its first row as often as needed.
    """
    columns = list(columns)
    slots = trees * tree_rows
    complete = df.select(col(row_key).alias("row_key"), *[col(c).cast("double").alias(c) for c in columns]).dropna()
    pool = flag_lowest(complete, ["row_key"], seed, lambda n, _: F.lit(slots), "_drawn").filter("_drawn").drop("_drawn")
    pool = written(pool, "forest-pool")
    # at most ``slots`` rows, so one task can number them
    place = F.row_number().over(Window.orderBy(hash_text(seed, F.col("row_key")), "row_key")) - 1
    n = row_count(pool).cast("int")
    per_tree = F.least(n, F.lit(tree_rows))
    samples = (
        pool.withColumn("_place", place)
        .withColumn("_slot", F.explode(F.sequence(F.col("_place"), F.lit(trees) * per_tree - 1, n)))
        .withColumn("tree", F.floor(F.col("_slot") / per_tree).cast("int"))
    )
    return samples.select("row_key", "tree", *[col(c) for c in columns]).groupBy("tree").applyInPandas(
        _grow(columns, seed, tree_rows), _NODES
    )


def _packed(nodes: pd.DataFrame) -> tuple:
    """One tree for fast walking: leaves lead to themselves, ``value`` is the depth credited there."""
    feature, cut = nodes["feature"].to_numpy(), nodes["cut"].to_numpy()
    leaf = feature < 0
    itself = np.arange(len(nodes))
    children = np.column_stack([
        np.where(leaf, itself, nodes["left"].to_numpy()), np.where(leaf, itself, nodes["right"].to_numpy())
    ])
    depth = np.zeros(len(nodes))
    for node in np.flatnonzero(~leaf):  # children have higher numbers than their parent
        depth[children[node]] = depth[node] + 1
    value = depth + expected_depth(nodes["size"].to_numpy())
    return np.where(leaf, 0, feature), np.where(leaf, np.inf, cut), children.ravel(), value, int(depth.max())


def score_rows(df: DataFrame, forest: DataFrame, columns: Sequence[str], name: str = "score") -> DataFrame:
    """Add the anomaly score in (0, 1); null where a column is null."""
    columns = list(columns)
    nodes = forest.toPandas().sort_values(["tree", "node"])  # bounded by trees * 2 * tree_rows
    norm = float(expected_depth(nodes.groupby("tree")["size"].max().max()))
    trees = [_packed(part) for _, part in nodes.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast(trees)

    @F.pandas_udf("double")
    def score(*values: pd.Series) -> pd.Series:
        data = np.column_stack([v.to_numpy(dtype=float) for v in values])
        known = ~np.isnan(data).any(axis=1)
        first_cell = np.arange(len(data)) * data.shape[1]
        cells = data.ravel()
        total = np.zeros(len(data))
        for feature, cut, children, value, levels in shared.value:
            at = np.zeros(len(data), dtype=np.intp)
            for _ in range(levels):
                right = cells.take(first_cell + feature.take(at)) > cut.take(at)
                at = children.take(2 * at + right)
            total += value.take(at)
        result = np.power(2.0, -total / len(shared.value) / norm)
        return pd.Series(result).where(pd.Series(known))

    return df.withColumn(name, score(*[col(c).cast("double") for c in columns]))


def isolation_outliers(
    df: DataFrame, row_key: str, columns: Sequence[str], contamination: float = CONTAMINATION,
    trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 42,
) -> DataFrame:
    """All rows with ``score`` and ``is_outlier``; about ``contamination`` of them are flagged."""
    forest = grow_forest(df, row_key, columns, trees, tree_rows, seed)
    scored = written(score_rows(df, forest, columns), "forest-scores")
    cut = quantiles(scored, ["score"], [1.0 - contamination]).select(F.get("score", F.lit(0))).scalar()
    return scored.withColumn("is_outlier", F.coalesce(F.col("score") > cut, F.lit(False)))
