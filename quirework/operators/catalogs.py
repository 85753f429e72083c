"""Document tables: states, upserts, cascades and replacements as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stages of a document and the job that takes it on from each.
NEXT_JOB = {"uploaded": "ocr", "ocr_pending": "ocr", "ocr_running": "ocr", "ocr_done": "layout", "layout_running": "layout", "layout_done": "chunking", "chunking_running": "chunking", "chunking_done": "embedding", "embedding": "embedding", "embedding_running": "embedding"}
#: File types by extension.
TYPES = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain", "md": "text/markdown", "json": "application/json"}


def newest_rows(documents: DataFrame) -> DataFrame:
    """The row of each document with the latest update."""
    rest = [c for c in documents.columns if c != "document_id"]
    newest = F.max(F.struct(F.col("updated_at").alias("by_update"), *rest)).alias("newest")
    return documents.where("document_id is not null").groupBy("document_id").agg(newest).select("document_id", *(F.col(f"newest.{c}").alias(c) for c in rest))


def page_of(documents: DataFrame, status: str | None, limit: int, offset: int) -> DataFrame:
    """A page of documents, newest first, of one status or of all."""
    rows = documents if status is None else documents.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "document_id").offset(offset).limit(limit)


def stuck_jobs(documents: DataFrame, open_jobs: DataFrame, now, minutes: int = 10) -> DataFrame:
    """document_id, job of every document that rests in a stage without an open job."""
    job = F.create_map(*(F.lit(x) for pair in NEXT_JOB.items() for x in pair))[F.col("status")]
    idle = documents.where(job.isNotNull() & (F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")))
    return idle.join(open_jobs.select("document_id"), "document_id", "left_anti").select("document_id", job.alias("job"))


def upserted(known: DataFrame, arrived: DataFrame) -> DataFrame:
    """Known and arrived uploads merged by hash: inserted, touched or, where the known one failed, tried again."""
    both = known.select("sha256", F.col("status").alias("old")).join(arrived.select("sha256").distinct().withColumn("arrived", F.lit(True)), "sha256", "full_outer")
    status = F.when(F.col("old").isNull(), "uploaded").when((F.col("old") == "failed") & F.col("arrived"), "uploaded").otherwise(F.col("old"))
    return both.select("sha256", status.alias("status"), F.col("old").isNull().alias("inserted"), F.coalesce((F.col("old") == "failed") & F.col("arrived"), F.lit(False)).alias("was_failed"))


def without_documents(children: DataFrame, removed: DataFrame) -> DataFrame:
    """A child table after its documents were deleted."""
    return children.join(removed.select("document_id").distinct(), "document_id", "left_anti")


def pages_replaced(spans: DataFrame, pages: DataFrame) -> DataFrame:
    """Lines of the accepted pages replaced by the pages' own text as one line each."""
    accepted = pages.select("document_id", F.col("page_num").alias("page_number")).distinct()
    kept = spans.join(accepted, ["document_id", "page_number"], "left_anti").select("document_id", "page_number", "text")
    return kept.unionByName(pages.select("document_id", F.col("page_num").alias("page_number"), F.col("full_text").alias("text")))


def typed_files(documents: DataFrame) -> DataFrame:
    """The file type that a name's extension tells, and whether the stored one agrees."""
    extension = F.lower(F.regexp_extract("filename", r"\.([A-Za-z0-9]+)$", 1))
    told = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))[extension]
    return documents.select("document_id", "filename", told.alias("told"), F.coalesce(told == F.col("mime_type"), F.lit(False)).alias("agrees"))
