"""Positions in a stated order."""

from pyspark.sql import functions as F

from ..operators import ordering
from ..plans.ranking import row_index
from .registry import query

_IDX = "idx AS (SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events)"
_N = "(SELECT count(*) FROM events)"


def _events(t):
    return t.events.select("event_id", "ts", "value")


@query("row_index", f"WITH {_IDX} SELECT event_id, row_idx FROM idx")
def row_index_of_events(t):
    return row_index(_events(t), ["ts", "event_id"]).select("event_id", "row_idx")


@query("systematic_sample", f"WITH {_IDX} SELECT event_id, value, row_idx FROM idx WHERE row_idx >= 5 AND (row_idx - 5) % 6 = 0")
def systematic_sample(t):
    return ordering.systematic_sample(_events(t), ["ts", "event_id"], 5, 6).select("event_id", "value", "row_idx")


@query("chrono_split", f"""
    WITH {_IDX} SELECT event_id,
        CASE WHEN row_idx < floor({_N} * 0.7::DOUBLE) THEN 'train'
             WHEN row_idx < floor({_N} * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM idx""")
def chrono_split(t):
    return ordering.chronological_split(_events(t), ["ts", "event_id"]).select("event_id", "split")


@query("kfold_assign", """
    SELECT doc_id, CAST(ntile(5) OVER (ORDER BY doc_id) - 1 AS INTEGER) AS fold FROM labels""")
def kfold_assign(t):
    return ordering.contiguous_folds(t.labels, ["doc_id"], 5).select("doc_id", F.col("fold"))


@query("chrono_split_text", f"""
    WITH o AS (
        SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderstatus, o_orderkey) - 1 AS place FROM orders)
    SELECT o_orderkey,
        CASE WHEN place < floor((SELECT count(*) FROM orders) * 0.7::DOUBLE) THEN 'train'
             WHEN place < floor((SELECT count(*) FROM orders) * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split
    FROM o""")
def chrono_split_text(t):
    order = ["o_orderpriority", "o_orderstatus", "o_orderkey"]
    return ordering.chronological_split(t.orders.select(*order), order).select("o_orderkey", "split")
