"""Keeping stored tables: upserts, transitions, cascades, sweeps and incremental batches as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_write_wins(known: DataFrame, arrived: DataFrame, key: list[str], order: str) -> DataFrame:
    """Both tables as one, the row with the greatest ``order`` of each key; ties go to the greatest row."""
    rest = [c for c in known.columns if c not in key and c != order]
    both = known.unionByName(arrived.select(*known.columns))
    newest = F.max(F.struct(order, *rest)).alias("n")
    return both.groupBy(*key).agg(newest).select(*key, *(F.col(f"n.{c}").alias(c) for c in [order, *rest]))


def accumulated(state: DataFrame, batch: DataFrame, key: str, counter: str, last: str) -> DataFrame:
    """State after a batch: counters add up, the last id is the batch's where it has one."""
    rows = state.select(key, F.col(counter).alias("old_n"), F.col(last).alias("old_last")).join(batch.select(key, F.col(counter).alias("new_n"), F.col(last).alias("new_last")), key, "full_outer")
    return rows.select(key, (F.coalesce("old_n", F.lit(0)) + F.coalesce("new_n", F.lit(0))).alias(counter), F.coalesce("new_last", "old_last").alias(last))


def transitioned(rows: DataFrame, moves: dict[str, str], when: Column | None = None) -> DataFrame:
    """Rows with ``status`` moved on where it is the expected one (and ``when`` holds), and whether it was."""
    moved = F.create_map(*(F.lit(x) for pair in moves.items() for x in pair))[F.col("status")]
    due = moved.isNotNull() & (when if when is not None else F.lit(True))
    return rows.withColumn("moved", F.coalesce(due, F.lit(False))).withColumn("status", F.when(due, moved).otherwise(F.col("status")))


def rebuilt(containers: DataFrame, blocks: DataFrame, edited: DataFrame) -> DataFrame:
    """id, text, n_blocks of the containers that hold an edited block, their text rebuilt from all their blocks in order.

    ``containers`` has id and block_ids, ``blocks`` block_id and text; a block
    without a row counts as empty. What is rebuilt needs a new vector, and the
    citations of it are stale.
    """
    due = containers.select("id", F.explode("block_ids").alias("block_id")).join(edited.select("block_id").distinct(), "block_id", "left_semi").select("id").distinct()
    parts = containers.join(due, "id", "left_semi").select("id", F.posexplode("block_ids").alias("place", "block_id")).join(blocks.select("block_id", "text"), "block_id", "left")
    lines = F.array_sort(F.collect_list(F.struct("place", F.coalesce("text", F.lit("")).alias("text"))))
    whole = F.array_join(F.transform(lines, lambda x: x["text"]), "\n")
    return parts.groupBy("id").agg(F.regexp_replace(whole, r"(?U)^\s+|\s+$", "").alias("text"), F.count("*").alias("n_blocks"))


def overdue(rows: DataFrame, done: str, created: str, now: Column, seconds: int, most: int) -> DataFrame:
    """The ``most`` oldest rows that are older than ``seconds`` and not done yet: one sweep."""
    return rows.where(F.col(done).isNull() & (F.col(created) < now - F.make_dt_interval(secs=F.lit(seconds)))).orderBy(created, *(c for c in rows.columns if c.endswith("_id"))).limit(most)


def since_last_run(rows: DataFrame, runs: DataFrame, key: str, now: Column, days: int = 30) -> DataFrame:
    """Rows newer than the last run of their key, or than ``days`` where it never ran, of its last three versions."""
    newest = rows.groupBy(key).agg(F.max("template_version").alias("newest"))
    floor = F.coalesce("last_run_at", now - F.make_dt_interval(days=F.lit(days)))
    joined = rows.join(newest, key).join(runs.select(key, "last_run_at"), key, "left")
    return joined.where((F.col("created_at") > floor) & (F.col("template_version") >= F.greatest(F.lit(1), F.col("newest") - 2))).drop("newest", "last_run_at")


def still_to_do(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that no earlier run has finished: a job that starts again takes these only."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def oldest_of(rows: DataFrame, key: str, order: str, of: str) -> DataFrame:
    """The first row in line of each key."""
    return rows.groupBy(key).agg(F.min(F.struct(order, of)).alias("f")).select(key, F.col(f"f.{of}").alias(of))


def reclaimed(beats: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Jobs that run without a heartbeat within the lease, back in line: job_id, last_beat, status."""
    last = beats.groupBy("job_id").agg(F.max(F.struct("ts", "event_id", "status")).alias("l"), F.max("ts").alias("last_beat"))
    late = F.col("last_beat") < now - F.make_dt_interval(secs=F.lit(seconds))
    return last.where((F.col("l.status") == "running") & late).select("job_id", "last_beat", F.lit("pending").alias("status"))


def page_numbers(rows: DataFrame, ranges: str) -> DataFrame:
    """Every row with each page that a text like 1-3,7 names, sorted and once; parts that are no range give none."""
    parts = F.filter(F.transform(F.split(ranges, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^\d+(\s*-\s*\d+)?$"))
    ends = F.transform(parts, lambda p: F.struct(F.split_part(p, F.lit("-"), F.lit(1)).cast("int").alias("low"), F.coalesce(F.nullif(F.trim(F.split_part(p, F.lit("-"), F.lit(2))), F.lit("")), p).cast("int").alias("high")))
    pages = F.flatten(F.transform(F.filter(ends, lambda e: e["low"] <= e["high"]), lambda e: F.sequence(e["low"], e["high"])))
    return rows.withColumn("page", F.explode(F.array_sort(F.array_distinct(pages))))


def resume_after(header: Column) -> Column:
    """The sequence number to go on after: 0 for what is no number or negative."""
    return F.greatest(F.coalesce(header.try_cast("bigint"), F.lit(0)), F.lit(0))


def lines_by_mean(spans: DataFrame, tolerance: float) -> DataFrame:
    """doc, page, line, n: lines of each page, a span joining the last one if it is near the mean height of its spans so far."""
    rows = spans.groupBy("doc", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", "span_id"))).alias("spans"))
    zero = F.struct(F.array().cast("array<int>").alias("sizes"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))

    def take(state: Column, span: Column) -> Column:
        near = (state["n"] > 0) & (F.abs(span["y0"] - state["sum"] / F.greatest(state["n"], F.lit(1))) <= tolerance)
        return F.when(near, F.struct(state["sizes"].alias("sizes"), (state["sum"] + span["y0"]).alias("sum"), (state["n"] + 1).alias("n"))).otherwise(
            F.struct(F.when(state["n"] > 0, F.array_append(state["sizes"], state["n"])).otherwise(state["sizes"]).alias("sizes"), span["y0"].alias("sum"), F.lit(1).alias("n"))
        )

    sizes = F.aggregate("spans", zero, take, lambda state: F.array_append(state["sizes"], state["n"]))
    return rows.select("doc", "page", F.posexplode(sizes).alias("line", "n"))


def append_log(rows: DataFrame, path: str) -> None:
    """Rows appended to a log table; nothing there is ever changed."""
    rows.write.mode("append").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metrics as JSON lines."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def block_type(label: Column) -> Column:
    """Block type of a layout model's label, by the word in it; others are paragraphs."""
    low = F.lower(label)
    result = F.when(low.contains("section") | low.contains("title"), "header")
    for word in ("table", "list", "figure"):
        result = result.when(low.contains(word), word)
    return result.otherwise("paragraph")
