"""Scaling on training statistics."""

from pyspark.sql import functions as F

from ..operators import sampling, scaling
from ..plans.names import clean_zero
from .registry import query

_SPLIT = """d AS (
    SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 7 AS flat,
           CASE WHEN CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE < 0.3::DOUBLE
                THEN 'test' ELSE 'train' END AS split FROM events)"""


def split_events(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    data = t.events.select("event_id", "value", k.alias("k"), F.lit(7).alias("flat"))
    return sampling.random_split_by_hash(data, ["event_id"])


def _rounded(df, *names):
    return df.withColumns({n: clean_zero(F.col(n)) for n in names})


@query("standardize_pop", f"""
    WITH {_SPLIT}, s AS (SELECT avg(value) AS m, stddev_pop(value) AS sd FROM d WHERE split = 'train')
    SELECT event_id, split, flat, round((value - m) / sd, 6) + 0.0 AS scaled_value FROM d, s""")
def standardize_pop(t):
    scaled = scaling.standardize_amount(split_events(t), "value", "scaled_value", ["k"])
    return _rounded(scaled, "scaled_value")


@query("standardize_samp", f"""
    WITH {_SPLIT}, s AS (SELECT avg(value) AS mv, stddev_samp(value) AS sv, avg(k) AS mk, stddev_samp(k) AS sk
                         FROM d WHERE split = 'train')
    SELECT event_id, split, round((value - mv) / sv, 6) + 0.0 AS value, round((k - mk) / sk, 6) + 0.0 AS k,
           0.0::DOUBLE AS flat FROM d, s""")
def standardize_samp(t):
    return _rounded(scaling.standardize(split_events(t), exclude=["event_id"]), "value", "k", "flat")


@query("minmax_scale", f"""
    WITH {_SPLIT}, s AS (SELECT min(value) AS v0, max(value) AS v1, min(k) AS k0, max(k) AS k1
                         FROM d WHERE split = 'train')
    SELECT event_id, split, round((value - v0) / (v1 - v0), 6) + 0.0 AS value,
           round((k - k0) / CAST(k1 - k0 AS DOUBLE), 6) + 0.0 AS k, 0.0::DOUBLE AS flat FROM d, s""")
def minmax_scale(t):
    return _rounded(scaling.normalize(split_events(t), exclude=["event_id"]), "value", "k", "flat")


@query("scaler_params", f"""
    WITH {_SPLIT}
    SELECT 'value' AS "column", 'zscore' AS type, round(avg(value), 6) + 0.0 AS center,
           round(stddev_samp(value), 6) + 0.0 AS scale FROM d WHERE split = 'train'
    UNION ALL
    SELECT 'k', 'zscore', round(avg(k), 6) + 0.0, round(stddev_samp(k), 6) + 0.0 FROM d WHERE split = 'train'""")
def scaler_params(t):
    stats = scaling.standard_stats(split_events(t), ["value", "k", "flat"])
    return _rounded(scaling.scaler_table(stats, "zscore"), "center", "scale")
