"""Structured Streaming forms of the log, queue and budget operators.

Each function takes a streaming DataFrame of events (``ts`` a timestamp). The
``finished`` helper runs a stream over all files that are there and returns the
table it leaves.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirework.plans.storage import shared_folder


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The event table as a stream of files, its time as a timestamp in the session's zone."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    # a pattern, as a stream takes no path of a single file
    return spark.readStream.schema(schema).parquet(f"{folder}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there, into a table in the shared folder, and reads it.

    In append mode the rows go to a parquet sink, whose log makes them exactly
    once. In the other modes each batch replaces the table of the batch before.
    """
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/quirework-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{path}-log").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def daily_counts(events: DataFrame) -> DataFrame:
    """Events and their value per type and day."""
    counted = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return counted.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


def first_deliveries(events: DataFrame, delay: str = "60 days") -> DataFrame:
    """Every event id once, however often it is delivered within the delay."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def admitted_spend(events: DataFrame, cap: float, seconds: int = 3600) -> DataFrame:
    """Which requests a budget of ``cap`` per hour admits: each looks back on those admitted before it.

    The state of a key holds the admitted requests of the last hour only, with
    amounts in millionths, so that their running sum is exact. Requests of a
    batch are taken in the order of their time and id. A null value costs
    nothing.
    """

    def admit(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(zip(*state.get)) if state.exists else deque()
        spent = sum(amount for _, amount in held)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        admitted = []
        for ts, value in zip(rows["ts"], rows["value"]):
            now = ts.timestamp()
            while held and held[0][0] < now - seconds:
                spent -= held.popleft()[1]
            amount = 0 if pd.isna(value) else round(value * 1_000_000)
            fits = spent + amount <= cap * 1_000_000
            if fits:
                held.append((now, amount))
                spent += amount
            admitted.append(fits)
        state.update(([time for time, _ in held], [amount for _, amount in held]))
        yield rows.assign(admitted=admitted)[["event_id", "user_id", "admitted"]]

    return events.select("event_id", "user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(
        admit, "event_id bigint, user_id bigint, admitted boolean", "times array<double>, amounts array<bigint>", "append", GroupStateTimeout.NoTimeout
    )


def job_states(events: DataFrame) -> DataFrame:
    """Last known state of each job and how many heartbeats it had, as the log is read.

    A signup opens a user's job, clicks and views are heartbeats, a purchase
    completes it and an error fails it.
    """
    state = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")
    beats = F.sum(F.when(F.col("event_type").isin("click", "view"), 1).otherwise(0))
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", state.alias("state"))).alias("last"), beats.alias("heartbeats")).select("user_id", "last.state", "heartbeats")


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands every batch to ``sink``: the hook for pushing frames to clients."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
