"""Projection, repair, filling, duplicates, joins and unions."""

from pyspark.sql import functions as F

from ..functions.repair import day_first_timestamp
from ..operators import cleaning, columns, joins
from ..plans.names import clean_zero
from ..sources.files import union_by_name
from .registry import query


@query("project_drop", "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def project_drop(t):
    return t.orders.drop("o_custkey", "o_orderpriority")


@query("filter_pred", "SELECT * FROM orders WHERE o_totalprice > 250000 AND o_orderstatus <> 'P'")
def filter_pred(t):
    return t.orders.filter((F.col("o_totalprice") > 250000) & (F.col("o_orderstatus") != "P"))


@query("topk_limit", """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5""")
def topk_limit(t):
    priced = t.orders.select("o_orderkey", "o_totalprice")
    return cleaning.head_rows(priced, [F.desc("o_totalprice"), "o_orderkey"], 5)


@query("regex_repair", r"""
    SELECT p_partkey,
           TRY_CAST(nullif(regexp_extract(CASE WHEN p_size = 1 THEN 'bad' ELSE 'v=' || p_retailprice || 'C' END,
                    '([-+]?\d*\.?\d+)', 1), '') AS DOUBLE) AS price
    FROM part""")
def regex_repair(t):
    text = F.when(F.col("p_size") == 1, "bad").otherwise(F.concat(F.lit("v="), F.col("p_retailprice"), F.lit("C")))
    return cleaning.repair_numbers(t.part.select("p_partkey", text.alias("price")), ["price", "absent"])


@query("coerce_numeric", """
    SELECT p_partkey, TRY_CAST(CASE WHEN p_size < 5 THEN 'bad' ELSE CAST(p_retailprice AS VARCHAR) END AS DOUBLE) AS price
    FROM part""")
def coerce_numeric(t):
    text = F.when(F.col("p_size") < 5, "bad").otherwise(F.col("p_retailprice").cast("string"))
    return cleaning.coerce_numbers(t.part.select("p_partkey", text.alias("price")), ["price"])


@query("unnest_first", "SELECT o_orderkey, o_totalprice AS nested, o_custkey AS scalar FROM orders")
def unnest_first(t):
    cell = F.array(F.struct("o_totalprice", "o_orderstatus"), F.struct(F.lit(0.0).alias("o_totalprice"), "o_orderstatus"))
    nested = t.orders.select("o_orderkey", cell.alias("nested"), F.col("o_custkey").alias("scalar"))
    return cleaning.unnest_first(nested, ["nested", "scalar"])


@query("unnest_first_array", """
    SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) + 0.0 AS embedding FROM embeddings""")
def unnest_first_array(t):
    first = cleaning.unnest_first(t.embeddings.select("vec_id", "embedding"), ["embedding"])
    return first.withColumn("embedding", clean_zero(F.col("embedding").cast("double")))


_LINEITEM = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric", "l_linenumber": "numeric",
    "l_quantity": "numeric", "l_extendedprice": "numeric", "l_discount": "numeric", "l_tax": "numeric",
    "l_returnflag": "categorical", "l_linestatus": "categorical", "l_shipdate": "other",
}


@query("column_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(*) AS n, count(*) - count({c}) AS n_null,
        count(DISTINCT {c}) AS n_distinct FROM lineitem""" for c, kind in _LINEITEM.items()))
def column_profile(t):
    return columns.column_profile(t.lineitem, exact_distinct=True)


@query("parse_ts", "SELECT o_orderkey, o_orderdate AS ts FROM orders ORDER BY ts, o_orderkey")
def parse_ts(t):
    text = F.date_format("o_orderdate", "dd.MM.yyyy HH:mm:ss")
    parsed = t.orders.select("o_orderkey", text.alias("ts")).withColumn("ts", day_first_timestamp(F.col("ts")))
    return parsed.orderBy("ts", "o_orderkey").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("replace_sentinel", """
    SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def replace_sentinel(t):
    broken = F.when(F.col("c_mktsegment") == "BUILDING", -9999.0).otherwise(F.col("c_acctbal"))
    customers = t.customer.select("c_custkey", broken.alias("c_acctbal"))
    return cleaning.replace_sentinel(customers, ["c_acctbal"], -9999.0, 0.0)


# events with holes: no type where the value is small, no value for signups
_HOLES = """holes AS (
    SELECT event_id, CASE WHEN value < 20 THEN NULL ELSE event_type END AS event_type,
           CASE WHEN event_type = 'signup' THEN NULL ELSE value END AS value FROM events)"""


def _holes(t):
    return t.events.select(
        "event_id",
        F.when(F.col("value") >= 20, F.col("event_type")).alias("event_type"),
        F.when(F.col("event_type") != "signup", F.col("value")).alias("value"),
    )


def _rounded(df):
    return df.withColumn("value", clean_zero(F.col("value")))


@query("fill_cat_custom", f"""
    WITH {_HOLES} SELECT event_id, coalesce(event_type, 'Missing') AS event_type, value FROM holes""")
def fill_cat_custom(t):
    return cleaning.fill_text(_holes(t), "custom")


@query("fill_cat_mode", f"""
    WITH {_HOLES}, best AS (
        SELECT event_type FROM holes WHERE event_type IS NOT NULL
        GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)
    SELECT event_id, coalesce(event_type, (SELECT event_type FROM best)) AS event_type, value FROM holes""")
def fill_cat_mode(t):
    return cleaning.fill_text(_holes(t), "mode", ["event_type"])


def _fill_sql(value: str) -> str:
    return f"""
    WITH {_HOLES} SELECT event_id, event_type, round(coalesce(value, {value}), 6) + 0.0 AS value FROM holes"""


@query("fill_num_mean", _fill_sql("(SELECT avg(value) FROM holes)"))
def fill_num_mean(t):
    return _rounded(cleaning.fill_numbers(_holes(t), "mean", ["value"]))


@query("fill_num_median", _fill_sql("(SELECT quantile_cont(value, 0.5) FROM holes)"))
def fill_num_median(t):
    return _rounded(cleaning.fill_numbers(_holes(t), "median", ["value"]))


@query("fill_num_mode", _fill_sql("""(SELECT value FROM holes WHERE value IS NOT NULL
    GROUP BY value ORDER BY count(*) DESC, value LIMIT 1)"""))
def fill_num_mode(t):
    return _rounded(cleaning.fill_numbers(_holes(t), "mode", ["value"]))


@query("fill_num_const", _fill_sql("-1.5"))
def fill_num_const(t):
    return _rounded(cleaning.fill_numbers(_holes(t), "constant", ["value"], value=-1.5))


_COPIED = """copied AS (
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P')"""


def _copied(t):
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return orders.unionAll(orders.filter("o_orderstatus = 'P'"))


@query("dedup_rows", f"WITH {_COPIED} SELECT DISTINCT * FROM copied")
def dedup_rows(t):
    return cleaning.drop_duplicates(_copied(t))


@query("dedup_rows_first", """
    SELECT min(event_id) AS event_id, user_id, event_type, date_trunc('hour', ts) AS hour
    FROM events GROUP BY user_id, event_type, hour""")
def dedup_rows_first(t):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return cleaning.drop_duplicates(t.events.select("event_id", "user_id", "event_type", hour), row_id="event_id")


@query("dup_listing", f"""
    WITH {_COPIED} SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (
        SELECT *, count(*) OVER (PARTITION BY o_orderkey, o_custkey, o_orderstatus, o_totalprice) AS c FROM copied)
    WHERE c > 1""")
def dup_listing(t):
    return cleaning.duplicate_rows(_copied(t))


@query("dup_listing_ids", """
    SELECT event_id, user_id, event_type, hour FROM (
        SELECT event_id, user_id, event_type, date_trunc('hour', ts) AS hour,
               count(*) OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts)) AS c FROM events)
    WHERE c > 1""")
def dup_listing_ids(t):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")
    return cleaning.duplicate_rows(t.events.select("event_id", "user_id", "event_type", hour), row_id="event_id")


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("unpivot_long", " UNION ALL ".join(
    f"""SELECT '{c}' AS "Column", {c} AS "Standardized" FROM lineitem""" for c in _MEASURES))
def unpivot_long(t):
    return cleaning.unpivot_all(t.lineitem, columns=_MEASURES)


@query("step_audit", f"""
    WITH {_COPIED},
    kept AS (SELECT * FROM copied WHERE o_totalprice > 1000),
    once AS (SELECT DISTINCT * FROM kept)
    SELECT 1 AS step_no, 'filter' AS step, 4 AS n_columns,
           (SELECT count(*) FROM copied) AS rows_in, (SELECT count(*) FROM kept) AS rows_out
    UNION ALL
    SELECT 2, 'drop duplicates', 4, (SELECT count(*) FROM kept), (SELECT count(*) FROM once)""")
def step_audit(t):
    copied = _copied(t)
    kept = copied.filter("o_totalprice > 1000")
    return cleaning.step_audit([
        ("read", copied), ("filter", kept), ("drop duplicates", cleaning.drop_duplicates(kept)),
    ])


@query("join_row_id", """
    SELECT o_orderkey, o_totalprice, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'""")
def join_row_id(t):
    features = t.orders.select("o_orderkey", "o_totalprice", "o_orderdate")
    labels = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")
    return joins.join_on_row_id(features, labels, "o_orderkey")


@query("concat_columns", """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
           CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority
    FROM orders""")
def concat_columns(t):
    left = t.orders.filter("o_orderstatus <> 'P'").select("o_orderkey", "o_totalprice")
    right = t.orders.filter("o_orderstatus <> 'F'").select("o_orderkey", "o_orderpriority")
    return joins.concat_columns(left, right, "o_orderkey")


@query("semi_lookup", """
    SELECT c_custkey, c_acctbal FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def semi_lookup(t):
    wanted = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.rows_with_ids(t.customer.select("c_custkey", "c_acctbal"), wanted, "c_custkey")


@query("anti_lookup", """
    SELECT c_custkey, c_acctbal FROM customer
    WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def anti_lookup(t):
    wanted = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.rows_without_ids(t.customer.select("c_custkey", "c_acctbal"), wanted, "c_custkey")


@query("union_by_name", """
    SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS segment FROM orders
    UNION ALL SELECT c_custkey, c_acctbal, NULL, c_mktsegment FROM customer""")
def union_of_names(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    customers = t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"))
    return union_by_name([orders, customers])


@query("union_mixed_types", """
    SELECT o_orderkey AS id, CAST(o_orderkey % 7 AS BIGINT) AS part, o_totalprice AS amount FROM orders
    UNION ALL SELECT CAST(n_nationkey AS BIGINT), 9007199254740993, CAST(n_regionkey AS DOUBLE) FROM nation""")
def union_of_mixed_types(t):
    orders = t.orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7).cast("smallint").alias("part"),
        F.col("o_totalprice").alias("amount"))
    nations = t.nation.select(
        F.col("n_nationkey").alias("id"), F.lit(9007199254740993).alias("part"), F.col("n_regionkey").alias("amount"))
    return union_by_name([orders, nations])


@query("union_splits", """
    SELECT o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split
    FROM orders""")
def union_splits(t):
    parts = [
        t.orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice", F.lit(split).alias("split"))
        for status, split in (("F", "train"), ("O", "val"), ("P", "test"))
    ]
    return union_by_name(parts)
