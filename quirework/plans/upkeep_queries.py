"""Queries on upserts, transitions, cascades, sweeps and incremental batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import catalogs, upkeep
from quirework.operators import events as E
from quirework.sources.tables import read_table

#: Where a stored state ends and a batch begins, in the queries below, and their present.
CUT, NOW = "2024-01-15", "2024-06-01"
MOVES = {"ocr_running": "ocr_done", "embedding": "ready", "failed": "uploaded"}


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return catalogs.newest_rows(read_table(spark, folder, "source_documents"))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "few_shot_store").drop("embedding").dropDuplicates(["edit_id"])


def cache_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The newest event of each user and type after a batch of later ones has come in."""
    events = read_table(spark, folder, "events").select("user_id", "event_type", "ts", "event_id")
    later = F.col("event_id") % 2 == 0
    return upkeep.last_write_wins(events.where(~later), events.where(later), ["user_id", "event_type"], "ts")


def extractor_state(spark: SparkSession, folder: str) -> DataFrame:
    """Edits seen of each template, and the last of them, after a batch."""
    edits = _edits(spark, folder)

    def of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("template_id").agg(F.count("*").alias("n_edits"), F.max(F.struct("created_at", "edit_id"))["edit_id"].alias("last_edit_id"))

    return upkeep.accumulated(of(edits.where(F.col("created_at") < CUT)), of(edits.where(F.col("created_at") >= CUT)), "template_id", "n_edits", "last_edit_id")


def moved_documents(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.transitioned(_documents(spark, folder), MOVES).select("document_id", "status", "moved")


def block_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts of failed documents, their text rebuilt from the names of all their documents."""
    documents = _documents(spark, folder)
    containers = E.latest(read_table(spark, folder, "drafts"), ["draft_id"], F.struct("edited_at", "created_at"), "document_ids").select(F.col("draft_id").alias("id"), F.col("document_ids").alias("block_ids"))
    blocks = documents.select(F.col("document_id").alias("block_id"), F.col("filename").alias("text"))
    edited = documents.where("status = 'failed'").select(F.col("document_id").alias("block_id"))
    return upkeep.rebuilt(containers, blocks, edited).select(F.col("id").alias("draft_id"), F.md5("text").alias("digest"), "n_blocks")


def unindexed_edits(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred oldest edits that have no vector yet: one sweep."""
    rows = _edits(spark, folder).select("edit_id", "created_at", "few_shot_indexed_at")
    return upkeep.overdue(rows, "few_shot_indexed_at", "created_at", F.lit(NOW).cast("timestamp_ntz"), 60, 100).select("edit_id", "created_at")


def edits_to_mine(spark: SparkSession, folder: str) -> DataFrame:
    """Edits since the last run of their template; templates without a run look back thirty days."""
    edits = _edits(spark, folder)
    runs = edits.where(F.col("template_id") < "d").groupBy("template_id").agg(F.lit(CUT).cast("timestamp_ntz").alias("last_run_at"))
    return upkeep.since_last_run(edits, runs, "template_id", F.lit("2024-02-10").cast("timestamp_ntz")).select("edit_id", "template_id")


def texts_without_vector(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return upkeep.still_to_do(read_table(spark, folder, "documents").select("doc_id"), vectors, "doc_id")


def next_in_line(spark: SparkSession, folder: str) -> DataFrame:
    return upkeep.oldest_of(_documents(spark, folder), "status", "created_at", "document_id")


def pages_asked_for(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that ranges like 1-3, 7 name, made of each document's page count."""
    ranges = F.concat(F.lit("1-"), F.least("page_count", F.lit(3)).cast("string"), F.lit(", "), F.col("page_count").cast("string"), F.lit(",x"))
    return upkeep.page_numbers(_documents(spark, folder).select("document_id", "page_count"), ranges).select("document_id", "page")


def first_file(spark: SparkSession, folder: str) -> DataFrame:
    """For each document type the first ready file whose name holds it."""
    types = read_table(spark, folder, "documents").where("doc_type is not null").select("doc_type").distinct()
    ready = _documents(spark, folder).where("status = 'ready'").select("document_id", F.regexp_extract("filename", r"^(.*)_\d+\.\w+$", 1).alias("doc_type"))
    return types.join(ready, "doc_type").groupBy("doc_type").agg(F.min("document_id").alias("document_id"))


def reclaimed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """A user's events as a job's log: jobs that have been silent for six hours are pending again."""
    events = read_table(spark, folder, "events").where("user_id is not null").select(F.col("user_id").alias("job_id"), "ts", "event_id", F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running").alias("status"))
    return upkeep.reclaimed(events, F.lit("2024-01-31").cast("timestamp_ntz"), 6 * 3_600)


def running_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of each page by the running mean of their height."""
    spans = read_table(spark, folder, "ocr_spans").where("span_id is not null and document_id is not null and y0 is not null").select(F.col("document_id").alias("doc"), F.coalesce("page_number", F.lit(-1)).alias("page"), "y0", "x0", "span_id").distinct()
    return upkeep.lines_by_mean(spans, 0.004)


QUERIES = {f.__name__: f for f in (cache_upsert, extractor_state, moved_documents, block_cascade, unindexed_edits, edits_to_mine, texts_without_vector, next_in_line, pages_asked_for, first_file, reclaimed_jobs, running_lines)}

_E = "e AS (SELECT DISTINCT ON (edit_id) * FROM few_shot_store)"
_D = "d AS (SELECT document_id, arg_max(struct_pack(s := status, f := filename, c := created_at, p := page_count), updated_at) AS r FROM source_documents WHERE document_id IS NOT NULL GROUP BY 1)"
ORACLES = {
    "cache_upsert": "SELECT user_id, event_type, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2",
    "extractor_state": f"WITH {_E} SELECT template_id, count(*) AS n_edits, arg_max(edit_id, (created_at, edit_id)) AS last_edit_id FROM e GROUP BY 1",
    "moved_documents": f"WITH {_D} SELECT document_id, CASE r.s WHEN 'ocr_running' THEN 'ocr_done' WHEN 'embedding' THEN 'ready' WHEN 'failed' THEN 'uploaded' ELSE r.s END AS status, coalesce(r.s IN ('ocr_running', 'embedding', 'failed'), false) AS moved FROM d",
    "block_cascade": f"""WITH {_D}, n AS (SELECT draft_id, document_ids AS b FROM drafts QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY edited_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1),
        x AS (SELECT draft_id, b[k] AS document_id, k FROM n, unnest(range(1, len(b) + 1)) AS u(k)), t AS (SELECT draft_id, k, coalesce(r.f, '') AS f, coalesce(r.s = 'failed', false) AS bad FROM x LEFT JOIN d USING (document_id))
        SELECT draft_id, md5(trim(string_agg(f, chr(10) ORDER BY k), ' ' || chr(10))) AS digest, count(*) AS n_blocks FROM t GROUP BY 1 HAVING bool_or(bad)""",
    "unindexed_edits": f"WITH {_E} SELECT edit_id, created_at FROM e WHERE few_shot_indexed_at IS NULL AND created_at < TIMESTAMP '{NOW}' - INTERVAL 60 SECOND ORDER BY created_at, edit_id LIMIT 100",
    "edits_to_mine": f"""WITH {_E} SELECT edit_id, template_id FROM e WHERE created_at > CASE WHEN template_id < 'd' THEN TIMESTAMP '{CUT}' ELSE TIMESTAMP '2024-02-10' - INTERVAL 30 DAY END
        AND template_version >= greatest(1, (SELECT max(template_version) FROM e m WHERE m.template_id = e.template_id) - 2)""",
    "texts_without_vector": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "next_in_line": f"WITH {_D} SELECT r.s AS status, arg_min(document_id, (r.c, document_id)) AS document_id FROM d GROUP BY 1",
    "pages_asked_for": f"WITH {_D} SELECT DISTINCT document_id, page::INT AS page FROM (SELECT document_id, unnest(list_append(range(1, least(r.p, 3) + 1), r.p::BIGINT)) AS page FROM d WHERE r.p IS NOT NULL)",
    "reclaimed_jobs": """WITH l AS (SELECT user_id AS job_id, ts AS last_beat, event_type FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT job_id, last_beat, 'pending' AS status FROM l WHERE event_type NOT IN ('purchase', 'error') AND last_beat < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR""",
    "first_file": f"WITH {_D} SELECT t.doc_type, min(document_id) AS document_id FROM (SELECT DISTINCT doc_type FROM documents WHERE doc_type IS NOT NULL) t JOIN d ON r.s = 'ready' AND regexp_extract(r.f, '^(.*)_\\d+\\.\\w+$', 1) = t.doc_type GROUP BY 1",
}
