"""Page, line and block queries over recognised spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import layout as L
from quirework.sources.tables import read_table


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "ocr_spans")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    return L.page_texts(_spans(spark, folder)).where("document_id is not null").withColumn("text", F.sha2("text", 256))


def page_confidence(spark: SparkSession, folder: str) -> DataFrame:
    return L.page_confidence(_spans(spark, folder), 12)


def dominant_source(spark: SparkSession, folder: str) -> DataFrame:
    return L.dominant_sources(_spans(spark, folder))


def source_summary(spark: SparkSession, folder: str) -> DataFrame:
    spans = L.distinct_spans(_spans(spark, folder)).select(F.coalesce("source", F.lit("unknown")).alias("source"), "document_id", "page_number")
    return spans.groupBy("source").agg(F.count("*").alias("n_spans"), F.count_distinct("document_id", "page_number").alias("n_pages"))


def layout_blocks(spark: SparkSession, folder: str) -> DataFrame:
    blocks = L.gap_blocks(_spans(spark, folder))
    return blocks.select("document_id", "page_number", "block", "block_type", "n_lines", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1")), F.length("text").alias("n_chars"))


def merged_orphans(spark: SparkSession, folder: str) -> DataFrame:
    return L.orphans_merged(L.gap_blocks(_spans(spark, folder))).withColumn("text", F.sha2("text", 256))


def column_split(spark: SparkSession, folder: str) -> DataFrame:
    return L.column_splits(_spans(spark, folder))


def bbox_containment(spark: SparkSession, folder: str) -> DataFrame:
    spans = _spans(spark, folder)
    return L.contained_spans(spans, L.gap_blocks(spans))


def text_layer(spark: SparkSession, folder: str) -> DataFrame:
    return L.text_layers(read_table(spark, folder, "page_extractions"))


QUERIES = {f.__name__: f for f in (page_text, page_confidence, dominant_source, source_summary, layout_blocks, merged_orphans, column_split, bbox_containment, text_layer)}

_S = "s AS (SELECT DISTINCT ON (span_id) * FROM ocr_spans)"
_BLOCKS = f"""{_S},
    m AS (SELECT *, y1 - y0 AS height, quantile_cont(y1 - y0, 0.5) OVER (PARTITION BY document_id, page_number) AS median FROM s WHERE document_id IS NOT NULL AND page_number IS NOT NULL),
    f AS (SELECT *, CASE WHEN y0 - lag(y1) OVER w <= 1.5 * median THEN 0 ELSE 1 END AS fresh FROM m WINDOW w AS (PARTITION BY document_id, page_number ORDER BY y0, x0, span_id)),
    b AS (SELECT *, (sum(fresh) OVER (PARTITION BY document_id, page_number ORDER BY y0, x0, span_id))::INT AS block FROM f),
    blocks AS (SELECT document_id, page_number, block, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_lines, round(avg(height), 9) AS height, any_value(median) AS median,
               string_agg(coalesce(text, ''), ' ' ORDER BY y0, x0, span_id) AS text FROM b GROUP BY 1, 2, 3),
    typed AS (SELECT *, CASE WHEN height > 1.35 * median AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 12 THEN 'header' ELSE 'paragraph' END AS block_type FROM blocks)"""
ORACLES = {
    "page_text": f"WITH {_S} SELECT document_id, page_number, sha256(string_agg(coalesce(text, ''), ' ' ORDER BY y0, x0, span_id)) AS text, count(*) AS n_spans FROM s WHERE document_id IS NOT NULL GROUP BY 1, 2",
    "page_confidence": f"WITH {_S} SELECT document_id, page_number, round(coalesce(avg(confidence), 0), 12) AS mean_confidence, count(*) AS n_spans FROM s GROUP BY 1, 2",
    "dominant_source": f"""WITH {_S}, c AS (SELECT document_id, source, count(*) AS n FROM s WHERE source IS NOT NULL GROUP BY 1, 2)
        SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY n DESC, source) = 1""",
    "source_summary": f"WITH {_S} SELECT coalesce(source, 'unknown') AS source, count(*) AS n_spans, count(DISTINCT (document_id, page_number)) AS n_pages FROM s GROUP BY 1",
    "layout_blocks": f"WITH {_BLOCKS} SELECT document_id, page_number, block, block_type, n_lines, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, length(text)::INT AS n_chars FROM typed",
    "merged_orphans": f"""WITH {_BLOCKS},
        o AS (SELECT *, CASE WHEN block_type = 'paragraph' AND len(list_filter(string_split(text, ' '), lambda w: w <> '')) <= 1 AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS own FROM typed WINDOW w AS (PARTITION BY document_id, page_number ORDER BY block)),
        t AS (SELECT *, sum(own) OVER (PARTITION BY document_id, page_number ORDER BY block) AS "to" FROM o)
        SELECT document_id, page_number, ("to" - 1)::INT AS reading_order, sha256(string_agg(text, ' ' ORDER BY block)) AS text, sum(n_lines)::BIGINT AS n_lines FROM t GROUP BY 1, 2, 3""",
    "column_split": f"""WITH {_S},
        m AS (SELECT document_id, page_number, (x0 + x1) / 2 AS mid, span_id FROM s WHERE document_id IS NOT NULL),
        w AS (SELECT *, count(*) OVER p AS n, min(mid) OVER p AS low, max(mid) OVER p AS high, lag(mid) OVER (PARTITION BY document_id, page_number ORDER BY mid, span_id) AS before FROM m WINDOW p AS (PARTITION BY document_id, page_number))
        SELECT document_id, page_number, round(min((before + mid) / 2), 6) AS split FROM w WHERE n >= 10 AND mid - before > 0.2 AND (before + mid) / 2 - low > 0.1 AND high - (before + mid) / 2 > 0.1 GROUP BY 1, 2""",
    "bbox_containment": f"""WITH {_BLOCKS} SELECT s.span_id, max(t.block) AS block FROM s JOIN typed t ON s.document_id = t.document_id AND s.page_number = t.page_number
        AND s.x0 >= t.x0 AND s.y0 >= t.y0 AND s.x1 <= t.x1 AND s.y1 <= t.y1 GROUP BY 1""",
    "text_layer": """WITH p AS (SELECT document_id, page_num, max(length(coalesce(full_text, ''))) AS size FROM page_extractions WHERE page_num <= 5 GROUP BY 1, 2)
        SELECT document_id, coalesce(bool_and(size >= 50), false) AS has_text_layer FROM p GROUP BY 1""",
}
