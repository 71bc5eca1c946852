"""Event-time queries; the same functions run on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from .registry import query


@query("event_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    """Events of each type in windows of five minutes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return streaming.windowed_counts(e, "ts", ["event_type"]).select(F.col("window.start").alias("start"), "event_type", "n")


@query(
    "event_sessions",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new
FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s
FROM e) SELECT user_id, min(ts) AS start, count(*) AS n FROM s
GROUP BY user_id, s"""
)
def event_sessions(spark, sf):
    """Events of each user, cut where half an hour passes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    return streaming.sessions(e, "ts", "user_id").select("user_id", F.col("session.start").alias("start"), "n")


@query("event_properties", "SELECT event_id, event_type, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events WHERE value > 0")
def event_properties(spark, sf):
    """The first property of events with a positive value."""
    e = spark.read.parquet(f"{sf}/events.parquet").where("value > 0")
    m = F.from_json("props", "map<string,string>")
    return e.select("event_id", "event_type", F.get(F.map_values(m), F.lit(0)).alias("first_value"))
