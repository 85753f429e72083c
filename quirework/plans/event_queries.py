"""Usage, budget, log and queue queries over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import events as E
from quirework.sources.tables import read_table


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events")


def usage_by_type(spark: SparkSession, folder: str) -> DataFrame:
    return E.usage_report(_events(spark, folder).withColumn("hit", F.get_json_object("props", "$.k").cast("int") % 2 == 0), "event_type")


def usage_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    hours = _events(spark, folder).groupBy("event_type", F.date_trunc("hour", "ts").alias("hour"))
    return hours.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("total"))


def budget_rolling_hour(spark: SparkSession, folder: str) -> DataFrame:
    return E.rolling_spend(_events(spark, folder), "user_id", "value").select("event_id", "user_id", "spent")


def event_replay(spark: SparkSession, folder: str) -> DataFrame:
    return E.replay(_events(spark, folder), "user_id", 20, 10, "ts", "event_id").select("user_id", "seq", "event_id", "event_type")


def latest_state(spark: SparkSession, folder: str) -> DataFrame:
    return E.latest(_events(spark, folder), ["user_id"], F.struct("ts", "event_id"), "event_id", "event_type", "value")


def activity_runs(spark: SparkSession, folder: str) -> DataFrame:
    return E.islands(_events(spark, folder), "user_id", 4 * 3600)


def enqueue_once(spark: SparkSession, folder: str) -> DataFrame:
    """The first event of each (user, k); events without a k are all kept."""
    rows = _events(spark, folder).withColumn("dedup_key", F.concat_ws(":", "user_id", F.get_json_object("props", "$.k")))
    return E.first_with_key(rows, "dedup_key", "ts", "event_id").select("event_id", "dedup_key")


def json_path_filter(spark: SparkSession, folder: str) -> DataFrame:
    return _events(spark, folder).where(F.get_json_object("props", "$.k").cast("int") == 42).select("event_id", "user_id", "ts")


def cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    hits = E.cached_answers(_events(spark, folder), ["user_id", "event_type"], 24 * 3600)
    return hits.groupBy("event_type").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("int")).alias("hits"))


def retry_state(spark: SparkSession, folder: str) -> DataFrame:
    fails = _events(spark, folder).groupBy("user_id").agg(F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("attempts"))
    return E.retried(fails, 15)


def queue_depth(spark: SparkSession, folder: str) -> DataFrame:
    """How many jobs are open after each day: signups open them, purchases close them."""
    from pyspark.sql import Window

    days = _events(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.when(F.col("event_type") == "signup", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)).alias("change"))
    return days.select(F.col("day").cast("string").alias("day"), F.sum("change").over(Window.orderBy("day")).alias("open_jobs"))


QUERIES = {f.__name__: f for f in (usage_by_type, usage_by_hour, budget_rolling_hour, event_replay, latest_state, activity_runs, enqueue_once, json_path_filter, cache_hits, retry_state, queue_depth)}

_K = "(props::JSON->>'$.k')"
ORACLES = {
    "usage_by_type": f"""SELECT event_type, count(*) AS calls, round(sum(coalesce(value, 0)), 2) AS total, sum(CASE WHEN {_K}::INT % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS hits,
        round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ROLLUP (event_type)""",
    "usage_by_hour": "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS calls, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "budget_rolling_hour": """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW), 6) AS spent FROM events""",
    "event_replay": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type FROM events QUALIFY seq > 20 AND seq <= 30",
    "latest_state": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "activity_runs": """WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 4 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM f)
        SELECT user_id, run::BIGINT AS run, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM r GROUP BY user_id, run""",
    "enqueue_once": f"SELECT event_id, user_id || ':' || {_K} AS dedup_key FROM events QUALIFY row_number() OVER (PARTITION BY user_id || ':' || {_K} ORDER BY ts, event_id) = 1",
    "json_path_filter": f"SELECT event_id, user_id, ts FROM events WHERE {_K}::INT = 42",
    "cache_hits": """WITH h AS (SELECT event_type, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 24 HOUR, false) AS hit FROM events)
        SELECT event_type, count(*) AS requests, sum(hit::INT)::BIGINT AS hits FROM h GROUP BY 1""",
    "retry_state": "SELECT user_id, sum((event_type = 'error')::INT)::BIGINT AS attempts, CASE WHEN sum((event_type = 'error')::INT) >= 15 THEN 'failed' ELSE 'pending' END AS status FROM events GROUP BY 1",
    "queue_depth": """WITH d AS (SELECT ts::DATE AS day, sum(CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) AS change FROM events GROUP BY 1)
        SELECT day::VARCHAR AS day, sum(change) OVER (ORDER BY day)::BIGINT AS open_jobs FROM d""",
}
