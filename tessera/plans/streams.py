"""Queries over the run log as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.registry import query
from tessera.streaming import requests, runs


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Tumbling windows of a drained stream."""
    out = runs.drain(runs.windowed(runs.events(spark, sf_dir)), "update", ["window", "event_type"])
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, min(ts) AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def stream_sessions(spark, sf_dir):
    out = runs.drain(runs.sessions(runs.events(spark, sf_dir)), "complete")
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def stream_distinct(spark, sf_dir):
    out = runs.drain(runs.distinct(runs.events(spark, sf_dir), ["event_type", "user_id"], "400 days"), "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query()
def stream_rate_limit(spark, sf_dir):
    """Requests that a per-user token bucket lets through; held against brute force in the tests."""
    out = runs.drain(runs.limited(runs.events(spark, sf_dir), burst=2, per_second=1 / 86400), "append")
    return out.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count("*").alias("n"))


@query()
def request_states(spark, sf_dir):
    """What became of run requests: one open at a time in a queue, claims and completions, limits and time-outs by timers;
    held against a replay in the tests."""
    kind = F.when(F.col("event_type").isin("click", "signup"), "request").when(F.col("event_type") == "view", "claim").otherwise("complete")
    stream = runs.events(spark, sf_dir).select((F.col("user_id") % 2).cast("int").alias("queue"), F.col("event_id").alias("request_id"), kind.alias("kind"), "ts")
    return runs.drain(requests.request_states(stream), "append")
