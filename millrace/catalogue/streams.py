"""Table operators run as streams over the files of the events table."""

from pyspark.sql import functions as F

from ..plans.names import clean_zero
from ..streaming import operators as streaming
from .registry import query


@query("stream_resample", """
    SELECT date_trunc('day', ts) AS ts, event_type, round(avg(value), 6) + 0.0 AS value, count(*) AS n FROM events
    GROUP BY date_trunc('day', ts), event_type
    HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_resample(t):
    events = streaming.read_parquet_stream(t.spark, t.path("events") + "*").select("ts", "event_type", "value")
    daily = streaming.resample_stream(events, "ts", ["value"], "1 day", "1 hour", keys=["event_type"])
    return streaming.run_available(daily.withColumn("value", clean_zero(F.col("value"))), "stream-resample")


@query("stream_zscore_flag", """
    SELECT event_id, value, round((value - m) / s, 6) + 0.0 AS value_z,
           CASE WHEN abs((value - m) / s) >= 3 THEN 'value' ELSE '' END AS extreme_tag
    FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)""")
def stream_zscore_flag(t):
    stats = streaming.frozen_stats(t.events, ["value"])
    events = streaming.read_parquet_stream(t.spark, t.path("events") + "*").select("event_id", "value")
    scored = streaming.score_stream(events, stats)
    out = scored.withColumns({"value_z": clean_zero(F.col("value_z")), "extreme_tag": F.array_join("extreme_tag", ",")})
    return streaming.run_available(out, "stream-zscore")
