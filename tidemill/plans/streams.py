"""Queries with the semantics of the streaming operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.plans.registry import query
from tidemill.sources.tables import table
from tidemill.streaming import admission as A


@query("rate_limit_admission")
def rate_limit_admission(spark, d):
    return A.admitted(table(spark, d, "events"), limit=3, window=86_400.0).select("event_id", "user_id", "event_type", "retry_after")


@query("online_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def online_dedup(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_counts(spark, d):
    return table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", "total")
