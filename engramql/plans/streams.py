"""Streaming queries, driven over the whole table as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramql.plans.registry import Registry
from engramql.storage import table
from engramql.streaming import pipelines as P

reg = Registry()


def _events(spark, d):
    """The events table as a stream of its file."""
    schema = table(spark, d, "events").schema
    # a glob, since the table may be one file and a file stream wants folders otherwise
    stream = spark.readStream.schema(schema).parquet(f"{d}/events[.]parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@reg.query("stream_hourly_events", "SELECT epoch_us(date_trunc('hour', ts)) // 1000 AS hour_ms, event_type, count(*) AS n, round(sum(value), 4) AS magnitude FROM events GROUP BY 1, 2")
def stream_hourly_events(spark, d):
    """ST2, ST5, tumbling window."""
    out = P.run_to_table(P.hourly_events(_events(spark, d)))
    return out.select(F.unix_millis("w.start").alias("hour_ms"), "event_type", "n", "magnitude")


@reg.query("stream_rolling_day", "WITH s AS (SELECT unnest([0, 1, 2, 3]) AS k) SELECT (epoch_us(ts) // 21600000000 - k) * 21600000 AS start_ms, count(*) AS n FROM events, s GROUP BY 1")
def stream_rolling_day(spark, d):
    """ST5, sliding window."""
    return P.run_to_table(P.rolling_day(_events(spark, d))).select(F.unix_millis("w.start").alias("start_ms"), "n")


@reg.query("stream_user_sessions", "WITH o AS (SELECT user_id, ts, coalesce(ts >= lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k")
def stream_user_sessions(spark, d):
    """ST10: session windows as an extension."""
    return P.run_to_table(P.user_sessions(_events(spark, d))).select("user_id", F.unix_millis("w.start").alias("start_ms"), "n")


queries = lambda: dict(reg.functions)
oracle_sql = lambda: dict(reg.sql)
