"""Document table and chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import catalogs as C
from quirework.operators import chunking
from quirework.sources import files
from quirework.sources.tables import read_spread, read_table

NOW = "2024-02-15 00:00:00"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return C.newest_rows(read_table(spark, folder, "source_documents"))


def ready_page(spark: SparkSession, folder: str) -> DataFrame:
    return C.page_of(_files(spark, folder), "ready", 20, 20).select("document_id", "filename", "created_at")


def has_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with whether it has pages at all."""
    pages = read_table(spark, folder, "page_extractions").select("document_id").distinct().withColumn("has_pages", F.lit(True))
    return _files(spark, folder).select("document_id", "status").join(pages, "document_id", "left").fillna(False, ["has_pages"])


def empty_output(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with pages but without a single recognised line."""
    pages = read_table(spark, folder, "page_extractions").select("document_id").distinct()
    spans = read_table(spark, folder, "ocr_spans").where("trim(text) <> ''").select("document_id").distinct()
    return pages.where("document_id is not null").join(spans, "document_id", "left_anti")


def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that rest in a stage and that no unfinished draft waits for."""
    jobs = read_table(spark, folder, "drafts").where("status = 'generating'").select(F.explode("document_ids").alias("document_id")).distinct()
    return C.stuck_jobs(_files(spark, folder), jobs, F.lit(NOW).cast("timestamp_ntz"))


def upsert_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Uploads up to a day as known, all later ones as arriving."""
    files = _files(spark, folder).where("sha256 is not null")
    known = files.where("created_at < timestamp_ntz'2024-01-20 00:00:00'").groupBy("sha256").agg(F.max("status").alias("status"))
    return C.upserted(known, files.where("created_at >= timestamp_ntz'2024-01-15 00:00:00'"))


def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Lines left per document after the failed documents are deleted."""
    failed = _files(spark, folder).where("status = 'failed'")
    left = C.without_documents(read_table(spark, folder, "ocr_spans").dropDuplicates(["span_id"]), failed)
    return left.groupBy("document_id").agg(F.count("*").alias("n_spans"))


def pages_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and characters per document after the pages of the visual model are taken over."""
    pages = read_table(spark, folder, "page_extractions").where("source = 'vlm' and document_id is not null").dropDuplicates(["extraction_id"])
    spans = read_table(spark, folder, "ocr_spans").where("document_id is not null").dropDuplicates(["span_id"])
    return C.pages_replaced(spans, pages).groupBy("document_id").agg(F.count("*").alias("n_lines"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("n_chars"))


def typed_files(spark: SparkSession, folder: str) -> DataFrame:
    return C.typed_files(_files(spark, folder))


def dedup_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents by the hash of their text: the first id and how many there are."""
    docs = read_table(spark, folder, "documents").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def text_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of plain texts as lines with boxes."""
    spans = files.text_spans(read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text"))
    return spans.select("id", "place", F.round("y0", 9).alias("y0"), F.round("y1", 9).alias("y1"), F.length("text").alias("n_chars"))


def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").where("text is not null").select("doc_id", T.token_count(F.col("text")).alias("tokens"))


def entity_list(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.entities_of(read_spread(spark, folder, "documents")).select("doc_id", "entity").distinct()


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(T.sentences(F.col("text"))).alias("sentences"))


def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_blocks(chunking.paragraph_blocks(read_spread(spark, folder, "documents"))).withColumn("section_path", F.array_join("section_path", " > "))


def chunk_offsets(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.running_offsets(chunking.paragraph_blocks(read_table(spark, folder, "documents")))


def line_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    groups = chunking.list_windows(docs, "doc_id", "lines")
    return groups.select("doc_id", "group", F.size("items").alias("n"), F.length(F.array_join("items", "\n")).alias("n_chars"))


def order_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Parents with their number of children, as a join of aggregates."""
    items = read_table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", F.coalesce("n", F.lit(0)).alias("n"), "total")


QUERIES = {
    f.__name__: f
    for f in (
        ready_page, has_pages, empty_output, reconcile, upsert_uploads, cascade_delete, pages_replaced, typed_files, text_spans, dedup_texts, token_counts, entity_list, sentence_counts,
        chunk_documents, chunk_offsets, line_windows, order_edit_counts,
    )
}

_FILES = "f AS (SELECT * FROM source_documents WHERE document_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY updated_at DESC NULLS LAST) = 1)"
_BLANK = r"[\s\x1c-\x1f\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_JOBS = ", ".join(f"('{k}', '{v}')" for k, v in C.NEXT_JOB.items())
_TYPES = ", ".join(f"('{k}', '{v}')" for k, v in C.TYPES.items())
_LINES = r"""l AS (SELECT doc_id::VARCHAR AS doc, unnest(t) AS text, unnest(range(len(t))) AS reading_order FROM (SELECT doc_id, regexp_split_to_array(text, '\n+') AS t FROM documents WHERE text IS NOT NULL))"""
from quirework.plans.retrieval_queries import NAMED_ENTITIES  # noqa: E402
ORACLES = {
    "entity_list": f"WITH {NAMED_ENTITIES} SELECT id AS doc_id, entity FROM named",
    "text_spans": """WITH p AS (SELECT doc_id AS id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p)), lambda p: p <> '') AS t FROM documents WHERE text IS NOT NULL),
        r AS (SELECT id, len(t) AS n, unnest(t) AS text, unnest(range(len(t))) AS place FROM p)
        SELECT id, place::INT AS place, round(place / n, 9) AS y0, round((place + 1 - CASE WHEN n > 1 THEN 0.2::DOUBLE ELSE 0 END) / n, 9) AS y1, length(text)::INT AS n_chars FROM r""",
    "ready_page": f"WITH {_FILES} SELECT document_id, filename, created_at FROM f WHERE status = 'ready' ORDER BY created_at DESC, document_id LIMIT 20 OFFSET 20",
    "has_pages": f"WITH {_FILES} SELECT document_id, status, document_id IN (SELECT document_id FROM page_extractions WHERE document_id IS NOT NULL) AS has_pages FROM f",
    "empty_output": "SELECT DISTINCT document_id FROM page_extractions p WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ocr_spans s WHERE s.document_id = p.document_id AND trim(s.text) <> '')",
    "reconcile": f"""WITH {_FILES}, j(status, job) AS (VALUES {_JOBS}) SELECT document_id, job FROM f JOIN j USING (status) WHERE updated_at < TIMESTAMP '{NOW}' - INTERVAL 10 MINUTE
        AND document_id NOT IN (SELECT unnest(document_ids) FROM drafts WHERE status = 'generating')""",
    "upsert_uploads": f"""WITH {_FILES}, k AS (SELECT sha256, max(status) AS old FROM f WHERE sha256 IS NOT NULL AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1),
        a AS (SELECT DISTINCT sha256, true AS arrived FROM f WHERE sha256 IS NOT NULL AND created_at >= TIMESTAMP '2024-01-15')
        SELECT sha256, CASE WHEN old IS NULL OR (old = 'failed' AND arrived) THEN 'uploaded' ELSE old END AS status, old IS NULL AS inserted, coalesce(old = 'failed' AND arrived, false) AS was_failed FROM k FULL JOIN a USING (sha256)""",
    "cascade_delete": f"WITH {_FILES}, s AS (SELECT DISTINCT span_id, document_id FROM ocr_spans) SELECT document_id, count(*) AS n_spans FROM s WHERE document_id IS NULL OR document_id NOT IN (SELECT document_id FROM f WHERE status = 'failed') GROUP BY 1",
    "pages_replaced": """WITH p AS (SELECT DISTINCT ON (extraction_id) document_id, page_num, full_text FROM page_extractions WHERE source = 'vlm' AND document_id IS NOT NULL),
        s AS (SELECT DISTINCT ON (span_id) document_id, page_number, text FROM ocr_spans WHERE document_id IS NOT NULL),
        k AS (SELECT document_id, text FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.document_id = s.document_id AND p.page_num = s.page_number) UNION ALL SELECT document_id, full_text FROM p)
        SELECT document_id, count(*) AS n_lines, sum(length(coalesce(text, '')))::BIGINT AS n_chars FROM k GROUP BY 1""",
    "typed_files": f"WITH {_FILES}, t(ext, told) AS (VALUES {_TYPES}) SELECT document_id, filename, told, coalesce(told = mime_type, false) AS agrees FROM f LEFT JOIN t ON ext = lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1))",
    "dedup_texts": "SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "token_counts": f"SELECT doc_id, (len(list_filter(regexp_split_to_array(text, '{_BLANK}'), lambda w: w <> '')) * 13 // 10)::INT AS tokens FROM documents WHERE text IS NOT NULL",
    "sentence_counts": r"SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(text, '(\.)\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> ''))::INT AS sentences FROM documents WHERE text IS NOT NULL",
    "chunk_offsets": f"""WITH {_LINES}, k AS (SELECT * FROM l WHERE trim(text) <> ''),
        o AS (SELECT doc, reading_order, length(text) AS n, coalesce(sum(length(text)) OVER (PARTITION BY doc ORDER BY reading_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM k)
        SELECT doc, reading_order::INT AS reading_order, s::BIGINT AS char_start, (s + n)::BIGINT AS char_end FROM o""",
    "line_windows": r"""WITH l AS (SELECT doc_id, unnest(t) AS line, unnest(range(len(t))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents WHERE text IS NOT NULL))
        SELECT doc_id, (k // 10)::INT AS "group", count(*)::INT AS n, length(string_agg(line, chr(10) ORDER BY k))::INT AS n_chars FROM l GROUP BY 1, 2""",
    "order_edit_counts": "SELECT o_orderkey, o_orderstatus, count(l_orderkey) AS n, round(sum(l_extendedprice), 2) AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
}
