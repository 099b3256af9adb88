"""Resampling, windows, time features, forecasts that SQL can repeat."""

from pyspark.sql import functions as F

from ..operators import cleaning, forecast, metrics, ordering, timeseries
from ..plans.names import clean_zero
from ..plans.ranking import row_index
from .registry import query


def _spine(unit: str, step: str) -> str:
    """Buckets of each user from the first to the last, with and without events."""
    return f"""b AS (SELECT user_id, ts, event_id, value, date_trunc('{unit}', ts) AS bucket FROM events),
    ends AS (SELECT user_id, min(bucket) AS lo, max(bucket) AS hi FROM b GROUP BY user_id),
    spine AS (SELECT user_id, unnest(generate_series(lo, hi, INTERVAL {step})) AS bucket FROM ends)"""


def _resample_sql(unit: str, step: str, value: str, shown: str = "bucket") -> str:
    return f"""
    WITH {_spine(unit, step)},
    a AS (SELECT user_id, bucket, {value} FROM b GROUP BY user_id, bucket)
    SELECT user_id, {shown} AS ts, a.* EXCLUDE (user_id, bucket)
    FROM spine LEFT JOIN a USING (user_id, bucket)"""


def _user_events(t):
    return t.events.select("user_id", "ts", "event_id", "value")


@query("resample_hour_mean", _resample_sql("hour", "1 HOUR", "round(avg(value), 6) + 0.0 AS value"))
def resample_hour_mean(t):
    hourly = timeseries.resample(_user_events(t), "ts", ["value"], "H", "mean", keys=["user_id"])
    return hourly.withColumn("value", clean_zero(F.col("value")))


@query("resample_day_sum", f"""
    WITH {_spine("day", "1 DAY")},
    a AS (SELECT user_id, bucket, sum(value) AS value FROM b GROUP BY user_id, bucket)
    SELECT user_id, bucket AS ts, round(coalesce(value, 0), 6) + 0.0 AS value
    FROM spine LEFT JOIN a USING (user_id, bucket)""")
def resample_day_sum(t):
    daily = timeseries.resample(_user_events(t), "ts", ["value"], "D", "sum", keys=["user_id"])
    return daily.withColumn("value", clean_zero(F.col("value")))


@query("resample_day_firstlast", _resample_sql(
    "day", "1 DAY", "arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value"))
def resample_day_firstlast(t):
    ends = {"first_value": ("value", "first"), "last_value": ("value", "last")}
    return timeseries.resample(_user_events(t), "ts", ends, "D", keys=["user_id"], tie_break=["event_id"])


@query("resample_week_max", _resample_sql(
    "week", "7 DAYS", "max(value) AS value", "CAST(bucket + INTERVAL 6 DAYS AS TIMESTAMP)"))
def resample_week_max(t):
    return timeseries.resample(_user_events(t), "ts", ["value"], "W", "max", keys=["user_id"])


@query("cyclic_time", """
    WITH s AS (SELECT event_id, epoch_us(ts) / 1e6::DOUBLE AS s FROM events)
    SELECT event_id,
        round(sin(s * (2 * pi() / 86400)), 6) + 0.0 AS "Day sin", round(cos(s * (2 * pi() / 86400)), 6) + 0.0 AS "Day cos",
        round(sin(s * (2 * pi() / (365.2425::DOUBLE * 86400))), 6) + 0.0 AS "Year sin",
        round(cos(s * (2 * pi() / (365.2425::DOUBLE * 86400))), 6) + 0.0 AS "Year cos"
    FROM s""")
def cyclic_time(t):
    parts = timeseries.cyclic_time(t.events.select("event_id", "ts"), "ts")
    return parts.withColumns({c: clean_zero(F.col(c)) for c in parts.columns if c != "event_id"})


@query("polar_to_xy", """
    WITH v AS (SELECT event_id, value, value * 1.5::DOUBLE AS gust,
                      radians(CAST(json_extract_string(props, '$.k') AS DOUBLE) * 3.6::DOUBLE) AS a FROM events)
    SELECT event_id, round(value * cos(a), 6) + 0.0 AS "Wx", round(value * sin(a), 6) + 0.0 AS "Wy",
           round(gust * cos(a), 6) + 0.0 AS "max Wx", round(gust * sin(a), 6) + 0.0 AS "max Wy" FROM v""")
def polar_to_xy(t):
    degrees = F.get_json_object("props", "$.k").cast("double") * 3.6
    wind = t.events.select(
        "event_id", F.col("value").alias("wv"), (F.col("value") * 1.5).alias("max. wv"), degrees.alias("wd"))
    parts = timeseries.wind_vectors(wind)
    return parts.withColumns({c: clean_zero(F.col(c)) for c in parts.columns if c != "event_id"})


_WINDOWS = """idx AS (
        SELECT event_id, value, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_idx FROM events),
    w AS (
        SELECT row_idx AS start_idx,
               list(event_id) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS in_ids,
               list(value) OVER (ORDER BY row_idx ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS in_values,
               list(value) OVER (ORDER BY row_idx ROWS BETWEEN 25 FOLLOWING AND 29 FOLLOWING) AS out_values,
               list(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY row_idx ROWS BETWEEN 25 FOLLOWING AND 29 FOLLOWING)
                   AS out_cents
        FROM idx)"""


def event_windows(t, chunk_rows=timeseries.WINDOW_CHUNK_ROWS):
    indexed = row_index(t.events.select("event_id", "ts", "value"), ["ts", "event_id"])
    return timeseries.sliding_windows(indexed, ["event_id", "value"], ["value"], chunk_rows=chunk_rows)


_WINDOW_SQL = f"""
    WITH {_WINDOWS}
    SELECT start_idx, array_to_string(in_ids, ',') AS input_ids,
           round(list_sum(in_values), 6) + 0.0 AS input_sum,
           array_to_string(out_cents, ',') AS label_cents
    FROM w WHERE len(out_values) = 5"""


@query("sliding_window", _WINDOW_SQL)
def sliding_window(t):
    return _shown(event_windows(t))


@query("sliding_window_chunks", _WINDOW_SQL)
def sliding_window_chunks(t):
    """The same cut into many small chunks, as a long series is."""
    return _shown(event_windows(t, chunk_rows=300))


def _shown(windows):
    total = F.aggregate("inputs", F.lit(0.0), lambda a, row: a + row["value"])
    cents = F.transform("labels", lambda row: F.round(row["value"] * 100).cast("bigint").cast("string"))
    ids = F.transform("inputs", lambda row: row["event_id"].cast("string"))
    return windows.select(
        "start_idx", F.array_join(ids, ",").alias("input_ids"), clean_zero(total).alias("input_sum"),
        F.array_join(cents, ",").alias("label_cents"))


@query("window_long", f"""
    WITH {_WINDOWS}
    SELECT start_idx, CAST(unnest(generate_series(0, 5)) AS INTEGER) AS step, 'input' AS kind, unnest(in_values) AS value
    FROM w WHERE len(out_values) = 5
    UNION ALL
    SELECT start_idx, CAST(unnest(generate_series(25, 29)) AS INTEGER), 'label', unnest(out_values)
    FROM w WHERE len(out_values) = 5""")
def window_long(t):
    return timeseries.window_series(event_windows(t), "value")


TARGETS = ["T", "p"]


def hourly_series(t):
    """All events as an hourly series of two measures, without holes."""
    k = F.get_json_object("props", "$.k").cast("double")
    events = t.events.select("ts", F.col("value").alias("T"), k.alias("p"))
    return cleaning.fill_numbers(timeseries.resample(events, "ts", TARGETS, "H", "mean"), "mean", TARGETS)


def hourly_windows(t):
    """Windows that stay inside their chronological split."""
    split = ordering.split_by_position(row_index(hourly_series(t), ["ts"]))
    return timeseries.sliding_windows(split, TARGETS, TARGETS, within=["split"])


_HOURLY = """h AS (
        SELECT ts, avg(value) AS "T", avg(k) AS p FROM (
            SELECT date_trunc('hour', ts) AS ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
        GROUP BY ts),
    spine AS (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), INTERVAL 1 HOUR)) AS ts),
    series AS (
        SELECT ts, coalesce("T", (SELECT avg("T") FROM h)) AS "T", coalesce(p, (SELECT avg(p) FROM h)) AS p,
               row_number() OVER (ORDER BY ts) - 1 AS row_idx, count(*) OVER () AS n
        FROM spine LEFT JOIN h USING (ts)),
    cut AS (
        SELECT *, CASE WHEN row_idx < floor(n * 0.7::DOUBLE) THEN 'train'
                       WHEN row_idx < floor(n * (0.7::DOUBLE + 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM series),
    long AS (SELECT row_idx, split, 'T' AS target, "T" AS y FROM cut UNION ALL SELECT row_idx, split, 'p', p FROM cut),
    {pairs}"""


def _pairs(back: str) -> str:
    """Label and forecast of every window; ``back`` tells how far after its start the forecast is read."""
    steps = " UNION ALL ".join(
        f"""SELECT row_idx AS start_idx, split, target, {h} AS horizon, lead(y, {24 + h}) OVER w AS y,
            lead(y, {back.format(h=h)}) OVER w AS y_hat, lead(row_idx, 29) OVER w AS last
        FROM long WINDOW w AS (PARTITION BY split, target ORDER BY row_idx)""" for h in range(1, 6))
    return _HOURLY.format(pairs=f"pairs AS (SELECT * FROM ({steps}) WHERE last IS NOT NULL)")


@query("forecast_persistence", f"""
    WITH {_pairs("5")}
    SELECT start_idx, split, target, CAST(horizon AS INTEGER) AS horizon, round(y, 6) + 0.0 AS y,
           round(y_hat, 6) + 0.0 AS y_hat FROM pairs""")
def forecast_persistence(t):
    rows = forecast.forecast_rows(forecast.persistence(hourly_windows(t), TARGETS), TARGETS, ["split"])
    return rows.withColumns({"y": clean_zero(F.col("y")), "y_hat": clean_zero(F.col("y_hat"))})


@query("forecast_seasonal", f"""
    WITH {_pairs("{h}")}
    SELECT start_idx, split, target, CAST(horizon AS INTEGER) AS horizon, round(y, 6) + 0.0 AS y,
           round(y_hat, 6) + 0.0 AS y_hat FROM pairs""")
def forecast_seasonal(t):
    rows = forecast.forecast_rows(forecast.seasonal_persistence(hourly_windows(t), TARGETS), TARGETS, ["split"])
    return rows.withColumns({"y": clean_zero(F.col("y")), "y_hat": clean_zero(F.col("y_hat"))})


@query("mae_by_horizon", f"""
    WITH {_pairs("5")}
    SELECT split, target, CAST(horizon AS INTEGER) AS horizon, count(*) AS n,
           round(avg(abs(y - y_hat)), 6) + 0.0 AS mae, round(avg((y - y_hat) * (y - y_hat)), 6) + 0.0 AS mse
    FROM pairs GROUP BY split, target, horizon""")
def mae_by_horizon(t):
    rows = forecast.forecast_rows(forecast.persistence(hourly_windows(t), TARGETS), TARGETS, ["split"])
    errors = metrics.forecast_errors(rows, "y", "y_hat", ["split", "target", "horizon"])
    return errors.withColumns({"mae": clean_zero(F.col("mae")), "mse": clean_zero(F.col("mse"))})
