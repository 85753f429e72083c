"""Streams over the event table, run to their end; each has a batch twin in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirework.streaming import streams as S


def stream_daily_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.finished(S.daily_counts(S.event_stream(spark, folder)), "complete")


def stream_first_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return S.finished(S.first_deliveries(S.event_stream(spark, folder))).select("event_id", "user_id", "event_type")


def stream_job_states(spark: SparkSession, folder: str) -> DataFrame:
    return S.finished(S.job_states(S.event_stream(spark, folder)), "complete")


def stream_budget(spark: SparkSession, folder: str) -> DataFrame:
    return S.finished(S.admitted_spend(S.event_stream(spark, folder), 100.0))


QUERIES = {f.__name__: f for f in (stream_daily_counts, stream_first_deliveries, stream_job_states, stream_budget)}

ORACLES = {
    "stream_daily_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "stream_first_deliveries": "SELECT DISTINCT event_id, user_id, event_type FROM events",
    "stream_job_states": """WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT user_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS state,
               (SELECT count(*) FROM events e WHERE e.user_id = l.user_id AND e.event_type IN ('click', 'view')) AS heartbeats FROM l""",
}
