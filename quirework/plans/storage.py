"""Cutting lineage through the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes of them written as JSON, that a side of a join may have to be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20


@functools.cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one on a local master only (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _local_folder(spark.sparkContext.applicationId)
    return folder.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written as parquet into the shared folder and read back.

    Later steps start from the files, so neither a second use nor a lost
    executor makes Spark compute ``df`` again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quirework-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its rows and bytes are few, else as it is (a shuffle join)."""
    size = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    n, n_bytes = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and n_bytes <= BROADCAST_BYTES else df
