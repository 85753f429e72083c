"""Operators on event logs: usage reports, rolling budgets, replay, state folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usage_report(events: DataFrame, by: str) -> DataFrame:
    """Calls, total and hit counts, median and 95th percentile per group, with the total over all groups (null group)."""
    return events.rollup(by).agg(
        F.count("*").alias("calls"),
        F.round(F.sum(F.coalesce("value", F.lit(0.0))), 2).alias("total"),
        F.sum(F.when(F.col("hit"), 1).otherwise(0)).alias("hits"),
        F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"),
        F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"),
    )


def rolling_spend(events: DataFrame, key: str, amount: str, seconds: int = 3600) -> DataFrame:
    """Spend of the last hour at every event, the exact boundary included."""
    order = Window.partitionBy(key).orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return events.withColumn("spent", F.round(F.sum(amount).over(order), 6))


def numbered(events: DataFrame, key: str, *order: str) -> DataFrame:
    """Every event with its sequence number within its key, from 1."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def replay(events: DataFrame, key: str, after: int, limit: int, *order: str) -> DataFrame:
    """The events after a sequence number, ``limit`` per key at most: a page of the log."""
    return numbered(events, key, *order).where((F.col("seq") > after) & (F.col("seq") <= after + limit))


def latest(rows: DataFrame, key: list[str], order: Column, *columns: str) -> DataFrame:
    """The columns of the row with the greatest ``order`` of each key, aggregated on both sides of the shuffle."""
    newest = F.max(F.struct(order.alias("o"), *columns)).alias("newest")
    return rows.groupBy(*key).agg(newest).select(*key, *(f"newest.{c}" for c in columns))


def islands(events: DataFrame, key: str, gap_seconds: int) -> DataFrame:
    """Runs of events that follow one another within the gap: key, run, start, stop, n."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    fresh = F.coalesce((micros - F.lag(micros).over(order) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    runs = events.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(order))
    return runs.groupBy(key, "run").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n"))


def first_with_key(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each non-null key and every row without one: later ones are dropped as already queued."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.where(F.col(key).isNotNull()).withColumn("rank", rank).where("rank = 1").drop("rank").unionByName(rows.where(F.col(key).isNull()))


def cached_answers(requests: DataFrame, key: list[str], seconds: int) -> DataFrame:
    """Whether an equal request was answered within the time to live before each request."""
    order = Window.partitionBy(*key).orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return requests.withColumn("hit", F.coalesce(micros - F.lag(micros).over(order) <= seconds * 1_000_000, F.lit(False)))


def retried(jobs: DataFrame, most: int = 3) -> DataFrame:
    """State of each job after its failures: pending again, or failed once they reach ``most``."""
    return jobs.withColumn("status", F.when(F.col("attempts") >= most, "failed").otherwise("pending"))
