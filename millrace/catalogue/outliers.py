"""Outlier reports and filters on events and line items."""

from pyspark.sql import functions as F

from ..operators import anomaly, outliers
from ..plans.names import clean_zero
from .registry import query

# value and the number inside props are the two measures of an event
_MEASURED = """m AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) * value AS load FROM events)"""


def measured(t):
    load = F.get_json_object("props", "$.k").cast("double") * F.col("value")
    return t.events.select("event_id", "value", load.alias("load"))


def _flat(report):
    return report.withColumns({
        "extreme_tag": F.array_join("extreme_tag", ","), "load": clean_zero(F.col("load")),
    })


_TAGGED = """tagged AS (
    SELECT event_id, value, load, value_out, load_out,
           concat_ws(',', CASE WHEN value_out THEN 'value' END, CASE WHEN load_out THEN 'load' END) AS extreme_tag,
           CAST(value_out AS BIGINT) + CAST(load_out AS BIGINT) AS abnormal_count
    FROM flags WHERE value_out OR load_out)
    SELECT value, round(load, 6) + 0.0 AS load, extreme_tag, abnormal_count, event_id AS original_index FROM tagged"""


@query("outlier_report_zscore", f"""
    WITH {_MEASURED},
    s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv, avg(load) AS ml, stddev_pop(load) AS sl FROM m),
    flags AS (SELECT m.*, abs((value - mv) / sv) >= 3 AS value_out, abs((load - ml) / sl) >= 3 AS load_out FROM m, s),
    {_TAGGED}""")
def outlier_report_zscore(t):
    return _flat(outliers.zscore_report(measured(t), "event_id", ["value", "load"], 3))


@query("outlier_report_iqr", f"""
    WITH {_MEASURED},
    s AS (SELECT quantile_cont(value, 0.25) AS v1, quantile_cont(value, 0.75) AS v3,
                 quantile_cont(load, 0.25) AS l1, quantile_cont(load, 0.75) AS l3 FROM m),
    flags AS (SELECT m.*, value < v1 - 1.5 * (v3 - v1) OR value > v3 + 1.5 * (v3 - v1) AS value_out,
                     load < l1 - 1.5 * (l3 - l1) OR load > l3 + 1.5 * (l3 - l1) AS load_out FROM m, s),
    {_TAGGED}""")
def outlier_report_iqr(t):
    return _flat(outliers.iqr_report(measured(t), "event_id", ["value", "load"], 1.5))


@query("outlier_report_merged", """
    WITH m AS (SELECT event_id, round(value) AS value FROM events),
    s AS (SELECT avg(value) AS mv, stddev_pop(value) AS sv FROM m)
    SELECT value, 'value' AS extreme_tag, count(*) AS abnormal_count, min(event_id) AS original_index, count(*) AS copies
    FROM m, s WHERE abs((value - mv) / sv) >= 3 GROUP BY value""")
def outlier_report_merged(t):
    data = t.events.select("event_id", F.round("value").alias("value"))
    merged = outliers.merge_report(outliers.zscore_report(data, "event_id", ["value"], 3))
    return merged.withColumn("extreme_tag", F.array_join("extreme_tag", ","))


@query("remove_zscore", """
    SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)
    WHERE abs((value - m) / s) < 3""")
def remove_zscore(t):
    return outliers.remove_zscore(t.events.select("event_id", "value"), "value", 3)


@query("remove_iqr", """
    SELECT event_id, value FROM events,
         (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def remove_iqr(t):
    return outliers.remove_iqr(t.events.select("event_id", "value"), "value", 1.5)


@query("iqr_clean_inclusive", """
    SELECT DISTINCT user_id, event_type, value FROM events,
         (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)
    WHERE value < q3 + 3 * (q3 - q1) AND value > q1 - 3 * (q3 - q1)""")
def iqr_clean_inclusive(t):
    return outliers.clean_amounts(t.events.select("user_id", "event_type", "value"), "value")


@query("isolation_forest")
def isolation_forest(t):
    found = anomaly.isolation_outliers(measured(t), "event_id", ["value", "load"])
    return found.filter("is_outlier").select("event_id", "value", clean_zero(F.col("score")).alias("score"))
