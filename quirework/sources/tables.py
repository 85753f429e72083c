"""Readers of the engine's parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Key of each table that is spread by it when it comes in too few files.
KEYS = {"documents": "doc_id", "page_extractions": "extraction_id", "ocr_spans": "span_id", "draft_sections": "section_id", "drafts": "draft_id", "few_shot_store": "edit_id"}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a folder of files) under ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_spread(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table for work that is heavy per row: spread by its key if it has fewer partitions than there are cores.

    A table of many files, as any large one is, is read as it is.
    """
    table = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores, KEYS[name])
