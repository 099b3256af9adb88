"""Frequencies, moments, quartiles, histograms."""

from pyspark.sql import functions as F

from ..operators import stats
from ..plans.names import clean_zero
from .registry import query

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_SHORT = ["l_quantity", "l_linenumber", "l_discount", "l_one", "l_three"]


def rounded(df, *names):
    return df.withColumns({n: clean_zero(F.col(n)) for n in names})


@query("class_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n, event_type")
def class_counts(t):
    return stats.class_counts(t.events, "event_type")


@query("class_share", """
    SELECT count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS n_positive,
           round(avg(CASE WHEN toxic = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) + 0.0 AS share FROM labels""")
def class_share(t):
    return rounded(stats.class_share(t.labels, "toxic"), "share")


@query("moments", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) + 0.0 AS mean,
        round(stddev_samp({c}), 6) + 0.0 AS std_samp, round(stddev_pop({c}), 6) + 0.0 AS std_pop,
        min({c}) AS min, max({c}) AS max FROM lineitem""" for c in MEASURES))
def moments(t):
    return rounded(stats.moments(t.lineitem, MEASURES), "mean", "std_samp", "std_pop")


_QUARTILES = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(quantile_cont({c}, 0.25), 6) + 0.0 AS q1,
        round(quantile_cont({c}, 0.5), 6) + 0.0 AS median, round(quantile_cont({c}, 0.75), 6) + 0.0 AS q3
        FROM lineitem""" for c in MEASURES)


@query("quartiles", _QUARTILES)
def quartiles(t):
    return rounded(stats.quartiles(t.lineitem, MEASURES), "q1", "median", "q3")


@query("quartiles_bracketed", _QUARTILES)
def quartiles_bracketed(t):
    """The same by narrowing brackets, as on a table with too many values for one buffer."""
    found = stats.quartiles(t.lineitem, MEASURES, buffer_limit=1000, accuracy=1000)
    return rounded(found, "q1", "median", "q3")


@query("distinct_guard", """
    WITH d AS (SELECT l_quantity, l_linenumber, l_discount, 1 AS l_one,
               CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'A' THEN 1 ELSE 2 END AS l_three FROM lineitem)
    """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) >= 4 AS enough
        FROM d""" for c in _SHORT))
def distinct_guard(t):
    three = F.when(F.col("l_linestatus") != "O", F.when(F.col("l_returnflag") == "A", 1).otherwise(2))
    data = t.lineitem.select("l_quantity", "l_linenumber", "l_discount", F.lit(1).alias("l_one"), three.alias("l_three"))
    return stats.distinct_guard(data, _SHORT)


@query("split_counts", """
    WITH s AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders)
    SELECT split, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'total', count(*) FROM s""")
def split_counts(t):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    return stats.split_counts(t.orders.select(split.alias("split")))


def _bin(x: str, low: str, high: str) -> str:
    """Number of inner edges at or below the value."""
    return " + ".join(f"CAST({x} >= {low} + {i} * (({high} - {low}) / 50) AS INTEGER)" for i in range(1, 50))


@query("hist2d", f"""
    WITH v AS (SELECT value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.6::DOUBLE AS y FROM events),
    e AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM v)
    SELECT {_bin("x", "x0", "x1")} AS bx, {_bin("y", "y0", "y1")} AS "by", count(*) AS n
    FROM v, e GROUP BY bx, "by" """)
def hist2d(t):
    degrees = F.get_json_object("props", "$.k").cast("double") * 3.6
    return stats.histogram_2d(t.events.select("value", degrees.alias("degrees")), "value", "degrees")


@query("dist_summary", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) + 0.0 AS mean, min({c}) AS min, max({c}) AS max,
        round(quantile_cont({c}, 0.25), 6) + 0.0 AS q1, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median,
        round(quantile_cont({c}, 0.75), 6) + 0.0 AS q3 FROM lineitem""" for c in MEASURES))
def dist_summary(t):
    return rounded(stats.distribution_summary(t.lineitem, MEASURES), "mean", "q1", "median", "q3")


@query("column_histograms", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column",
        {_bin(c, "lo", "hi")} AS bin, count(*) AS n
        FROM lineitem, (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem) GROUP BY 1, 2""" for c in MEASURES))
def column_histograms(t):
    return stats.column_histograms(t.lineitem, MEASURES)


def _density_sql(c: str, points: int = 64) -> str:
    return f"""
    SELECT '{c}' AS "column", CAST(g AS INTEGER) AS point, round(start + g * step, 4) + 0.0 AS x,
           round(sum(w * CASE WHEN abs((g - p) * step / h) <= 4 THEN exp(-0.5 * ((g - p) * step / h) * ((g - p) * step / h)) ELSE 0 END)
                 / (n * h * sqrt(2 * pi())), 9) + 0.0 AS density
    FROM (
        SELECT p, sum(w) AS w FROM (
            SELECT unnest([l, l + 1]) AS p, unnest([1 - (q - l), q - l]) AS w FROM (
                SELECT q, least(floor(q), {points - 2}) AS l FROM (
                    SELECT ({c} - start) / step AS q FROM lineitem, ({_density_grid(c, points)}) WHERE {c} IS NOT NULL)))
        GROUP BY p), ({_density_grid(c, points)}), (SELECT unnest(range(0, {points})) AS g)
    GROUP BY g, start, step, n, h"""


def _density_grid(c: str, points: int) -> str:
    return f"""
        SELECT n, h, low - 4 * h AS start, (high - low + 8 * h) / {points - 1} AS step FROM (
            SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
                   stddev_samp({c}) * pow(CAST(count({c}) AS DOUBLE), -0.2) AS h FROM lineitem)"""


@query("density", " UNION ALL ".join(_density_sql(c) for c in MEASURES[:2]))
def density(t):
    found = stats.density(t.lineitem, MEASURES[:2], points=64)
    return found.select("column", "point", clean_zero(F.col("x"), 4).alias("x"), clean_zero(F.col("density"), 9).alias("density"))
