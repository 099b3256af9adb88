"""Splits, undersampling, neighbours and synthetic points."""

from pyspark.sql import functions as F

from ..operators import sampling
from ..operators.neighbours import nearest_neighbours
from ..plans.names import clean_zero
from .registry import query

_E = "e AS (SELECT event_id, value, CAST(event_type = 'error' AS INTEGER) AS y FROM events)"


def labelled(t):
    return t.events.select("event_id", "value", (F.col("event_type") == "error").cast("int").alias("y"))


@query("random_split_exact", """
    SELECT event_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || event_id), event_id)
        <= ceil((SELECT count(*) FROM events) * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM events""")
def random_split_exact(t):
    return sampling.random_split(t.events.select("event_id"), ["event_id"])


@query("random_split_hash", """
    SELECT event_id, CASE WHEN CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
        < 0.3::DOUBLE THEN 'test' ELSE 'train' END AS split FROM events""")
def random_split_hash(t):
    return sampling.random_split_by_hash(t.events.select("event_id"), ["event_id"])


@query("undersample", f"""
    WITH {_E} SELECT event_id, value, y FROM e WHERE y = 1
    UNION ALL SELECT event_id, value, y FROM (
        SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn FROM e WHERE y = 0)
    WHERE rn <= (SELECT count(*) FROM e WHERE y = 1)""")
def undersample(t):
    return sampling.undersample(labelled(t), "y", ["event_id"])


@query("undersample_split", f"""
    WITH {_E}, b AS (
        SELECT event_id, y FROM e WHERE y = 1
        UNION ALL SELECT event_id, y FROM (
            SELECT *, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) AS rn FROM e WHERE y = 0)
        WHERE rn <= (SELECT count(*) FROM e WHERE y = 1))
    SELECT event_id, y, CASE WHEN row_number() OVER (ORDER BY md5('42s:' || event_id), event_id)
        <= ceil((SELECT count(*) FROM b) * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS split FROM b""")
def undersample_split(t):
    return sampling.undersample_and_split(labelled(t).drop("value"), "y", ["event_id"])


_KNN = """p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    near AS (
        SELECT a.label, a.vec_id AS vec_id, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance,
               row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS rank
        FROM p a JOIN p b ON a.label = b.label AND a.vec_id <> b.vec_id)"""


_KNN_SQL = f"""
    WITH {_KNN} SELECT label, vec_id, CAST(rank AS INTEGER) AS rank, neighbour, round(distance, 6) + 0.0 AS distance
    FROM near WHERE rank <= 5"""


@query("knn_minority", _KNN_SQL)
def knn_minority(t):
    return _neighbours(t, 2048)


@query("knn_minority_blocks", _KNN_SQL)
def knn_minority_blocks(t):
    """The same over several cells and blocks per class, as on a large table."""
    return _neighbours(t, 24)


def _neighbours(t, block_rows):
    near = nearest_neighbours(t.embeddings, "vec_id", "embedding", 5, group="label", block_rows=block_rows)
    return near.select(
        "label", F.col("key").alias("vec_id"), "rank", "neighbour", clean_zero(F.col("distance")).alias("distance"))


@query("smote", f"""
    WITH {_KNN},
    sizes AS (SELECT label, count(*) AS n FROM p GROUP BY label),
    need AS (SELECT label, ((SELECT max(n) FROM sizes) - n) // n AS each, ((SELECT max(n) FROM sizes) - n) % n AS extra
             FROM sizes),
    shared AS (
        SELECT p.*, each + CASE WHEN row_number() OVER (PARTITION BY p.label ORDER BY md5('42:' || vec_id), vec_id)
                                <= extra THEN 1 ELSE 0 END AS copies
        FROM p JOIN need USING (label)),
    wanted AS (SELECT *, unnest(generate_series(1, copies)) AS copy FROM shared WHERE copies > 0),
    drawn AS (SELECT *, md5('42:' || vec_id || ':' || copy) AS h FROM wanted),
    made AS (
        SELECT d.vec_id, d.copy, d.label, d.v AS x, b.v AS o,
               CAST('0x' || substr(h, 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
        FROM drawn d
        JOIN near n ON n.vec_id = d.vec_id AND n.rank = 1 + CAST('0x' || substr(h, 1, 8) AS BIGINT) % 5
        JOIN p b ON b.vec_id = n.neighbour)
    SELECT vec_id, CAST(copy AS BIGINT) AS copy, label, true AS synthetic,
           round(x[1] + u * (o[1] - x[1]), 6) + 0.0 AS first,
           round(list_sum(x) + u * (list_sum(o) - list_sum(x)), 6) + 0.0 AS total
    FROM made
    UNION ALL
    SELECT vec_id, 0, label, false, round(v[1], 6) + 0.0, round(list_sum(v), 6) + 0.0 FROM p""")
def smote(t):
    grown = sampling.smote(t.embeddings, "embedding", "label", "vec_id")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return grown.select(
        F.col("key").alias("vec_id"), "copy", "label", "synthetic",
        clean_zero(F.get("vector", F.lit(0))).alias("first"), clean_zero(total).alias("total"))
