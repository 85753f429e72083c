"""The queries of the numbered problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.llm import encode_corpus, leaked_items, near_duplicates, personal_data, scan_repair, shared_spans, similar_vectors, split_pieces, sql, stuffed_pages
from quirework.sources.tables import read_spread, read_table


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_pieces.split_oversized(read_spread(spark, folder, "page_extractions"), read_table(spark, folder, "section_specs"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return split_pieces.found(read_spread(spark, folder, "page_extractions"), read_table(spark, folder, "section_specs"))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.redact(read_spread(spark, folder, "ocr_spans"), read_spread(spark, folder, "draft_sections"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.found(read_spread(spark, folder, "ocr_spans"), read_spread(spark, folder, "draft_sections"))


def p3_pages(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.clean_pages(read_spread(spark, folder, "ocr_spans"), read_spread(spark, folder, "page_extractions"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scan_repair.found(read_spread(spark, folder, "ocr_spans"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.classes_with_links(read_spread(spark, folder, "page_extractions"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.found(read_spread(spark, folder, "page_extractions"))


def p5_spans(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.shared_spans(read_spread(spark, folder, "page_extractions"), read_spread(spark, folder, "draft_sections"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return shared_spans.found(read_spread(spark, folder, "page_extractions"), read_spread(spark, folder, "draft_sections"))


def p7_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.nearest_vectors(read_spread(spark, folder, "few_shot_store")).select("edit_id", "rank", "other_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors.found(read_spread(spark, folder, "few_shot_store"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus.encode_corpus(read_spread(spark, folder, "documents"))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items.leaked_passages(read_spread(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items.found(read_spread(spark, folder, "documents"), read_table(spark, folder, "eval_items"))


def p10_labels(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages.page_shares(read_spread(spark, folder, "documents"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages.found(read_spread(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
