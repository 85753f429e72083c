"""Claims by citation tag, their verdicts, and what follows from them for citations, drafts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.drafting import SEVERITY

_BETWEEN = r"(?U)(?<=[.!?])\s+"
_ONLY_MARKS = r"(?U)^[\s.,;:!?]+$"
#: Letters of a chunk that are given as evidence, and letters of a value, a block and a section in a search text.
EVIDENCE_CHARS, VALUE_CHARS, SECTION_CHARS, BLOCK_CHARS = 1000, 1500, 800, 3500


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def claims_by_tag(sections: DataFrame) -> DataFrame:
    """section_id, draft_id, claim_no, claim, chunk_id: one claim for each citation tag, then the sentences after the last one.

    The claim of a tag is the last piece of a sentence before it, empty if the
    sentence ended there; a text without tags is one claim without a chunk.
    """
    ids = T.citations(F.col("ai_text"))
    parts = F.split("ai_text", T.CITATION.replace("(", "(?:", 1))
    rows = sections.where("ai_text is not null and ai_text <> ''").select("section_id", "draft_id", "ai_text", ids.alias("ids"), parts.alias("parts"))
    tagged = F.transform("ids", lambda chunk, i: F.struct(_stripped(F.replace(F.element_at(F.split(F.concat(F.get("parts", i), F.lit("\x01")), _BETWEEN), -1), F.lit("\x01"), F.lit(""))).alias("claim"), chunk.alias("chunk_id")))
    rest = F.split(_stripped(F.element_at("parts", -1)), _BETWEEN)
    untagged = F.transform(F.filter(F.transform(rest, _stripped), lambda s: (s != "") & ~s.rlike(_ONLY_MARKS)), lambda s: F.struct(s.alias("claim"), F.lit(None).cast("string").alias("chunk_id")))
    whole = F.array(F.struct(_stripped(F.col("ai_text")).alias("claim"), F.lit(None).cast("string").alias("chunk_id")))
    both = F.when(F.size("ids") == 0, whole).otherwise(F.concat(tagged, untagged))
    return rows.select("section_id", "draft_id", F.posexplode(both).alias("claim_no", "c")).select("section_id", "draft_id", "claim_no", "c.claim", "c.chunk_id")


def claim_verdicts(claims: DataFrame, retrieved: DataFrame, judge: Column | None = None) -> DataFrame:
    """The claims with ``status`` and ``reason``: without a citation or with an unknown chunk unsupported, else as the judge says.

    ``judge`` is an expression over the claim and the chunk (such as a pandas
    UDF on a model); a null verdict is unsupported, and without a judge every
    known citation is taken for support.
    """
    known = retrieved.select("draft_id", "chunk_id").distinct().withColumn("known", F.lit(True))
    pairs = claims.join(known, ["draft_id", "chunk_id"], "left")
    verdict = F.coalesce(judge if judge is not None else F.lit("supported"), F.lit("unsupported"))
    status = F.when(F.col("known").isNull(), "unsupported").otherwise(verdict)
    reason = F.when(F.col("chunk_id").isNull(), "claim has no citation").when(F.col("known").isNull(), "chunk_id not in retrieved set")
    return pairs.select("section_id", "draft_id", "claim_no", "claim", "chunk_id", status.alias("status"), reason.alias("reason"))


def citation_statuses(verdicts: DataFrame) -> DataFrame:
    """section_id, chunk_id, status of each cited chunk: that of the first claim that cites it."""
    first = F.min(F.struct("claim_no", "status")).alias("first")
    return verdicts.where("chunk_id is not null").groupBy("section_id", "draft_id", "chunk_id").agg(first).select("section_id", "draft_id", "chunk_id", "first.status")


def revalidated(citations: DataFrame, stored: DataFrame) -> DataFrame:
    """n of each status that stale and unchecked citations of ``stored`` (section_id, chunk_id, validation_status) get now; one that no claim cites is unsupported."""
    due = stored.where(F.col("validation_status").isin("stale", "unchecked")).select("section_id", "chunk_id").distinct()
    now = due.join(citations.select("section_id", "chunk_id", "status"), ["section_id", "chunk_id"], "left")
    return now.groupBy(F.coalesce("status", F.lit("unsupported")).alias("status")).agg(F.count("*").alias("n"))


def validity_metrics(verdicts: DataFrame, high: float = 0.8) -> DataFrame:
    """Share of supported claims, share of sections at or over ``high``, fabricated citations and totals; null without rows."""
    supported = F.sum(F.when(F.col("status") == "supported", 1).otherwise(0))
    per = verdicts.groupBy("section_id").agg(F.count("*").alias("claims"), supported.alias("supported"), F.sum(F.when(F.col("reason").startswith("chunk_id"), 1).otherwise(0)).alias("fabricated"))
    sections_high = F.sum(F.when(F.col("supported") >= high * F.col("claims"), 1).otherwise(0))
    return per.agg(
        F.round(F.try_divide(F.sum("supported"), F.sum("claims")), 6).alias("supported_share"), F.round(F.try_divide(sections_high, F.count("*")), 6).alias("high_share"),
        F.sum("fabricated").alias("fabricated"), F.sum("claims").alias("claims"), F.count("*").alias("sections"),
    )


def without_dangling(sections: DataFrame, retrieved: DataFrame) -> DataFrame:
    """section_id, text, n_dangling: the text without the tags of chunks that its draft did not retrieve."""
    known = retrieved.groupBy("draft_id").agg(F.collect_set("chunk_id").alias("known"))
    rows = sections.where("ai_text is not null").select("section_id", "draft_id", "ai_text").join(known, "draft_id", "left")
    ids = T.citations(F.col("ai_text"))
    dangling = F.filter(ids, lambda c: ~F.coalesce(F.array_contains("known", c), F.lit(False)))
    text = F.aggregate(F.array_distinct("dangling"), F.col("ai_text"), lambda t, c: F.replace(t, F.concat(F.lit("[chunk:"), c, F.lit("]"))))
    return rows.withColumn("dangling", dangling).select("section_id", text.alias("text"), F.size("dangling").alias("n_dangling"))


def section_replaced(sections: DataFrame, replaced: DataFrame) -> DataFrame:
    """Sections with the new text of those in ``replaced`` (section_id, text), each with its citations made anew."""
    rows = sections.select("section_id", "draft_id", "ai_text").join(replaced.select("section_id", F.col("text").alias("new_text")), "section_id", "left")
    text = F.coalesce("new_text", "ai_text")
    return rows.select("section_id", "draft_id", text.alias("ai_text"), T.citations(text).alias("chunk_ids"), F.col("new_text").isNotNull().alias("replaced"))


def evidence(chunks: DataFrame, keep: int = 8) -> DataFrame:
    """name, evidence of each field or section: its first ``keep`` chunks by rank, each cut and led by its tag."""
    line = F.concat(F.lit("[chunk:"), "id", F.lit("] "), F.left("text", F.lit(EVIDENCE_CHARS)))
    rows = chunks.where(F.col("rank") <= keep).groupBy("name").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    return rows.select("name", F.array_join(F.transform("lines", lambda x: x["line"]), "\n\n").alias("evidence"))


def coerced_fields(fields: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Fields with ``value``, ``confidence`` and ``n_support`` as they are stored: the text null is none, an absent value has no support.

    A value without named chunks is supported by all that its draft retrieved;
    a confidence that is absent or 0 is 0.8.
    """
    everything = retrieved.groupBy("draft_id").agg(F.count_distinct("chunk_id").alias("n_all"))
    value = F.when(F.lower(F.trim("value")) != "null", F.col("value"))
    rows = fields.withColumn("value", value).join(everything, "draft_id", "left")
    confidence = F.when(F.col("value").isNull(), 0.0).when(F.coalesce("confidence", F.lit(0.0)) == 0, 0.8).otherwise(F.col("confidence"))
    support = F.when(F.col("value").isNull(), 0).when(F.coalesce("n_named", F.lit(0)) == 0, F.coalesce("n_all", F.lit(0))).otherwise(F.col("n_named"))
    return rows.select("draft_id", "name", "value", confidence.alias("confidence"), support.cast("bigint").alias("n_support"))


def merged_fields(fields: DataFrame, edits: DataFrame) -> DataFrame:
    """draft_id, name, value, origin: a draft's fields with the user's newest value, be it null, over the drafted one."""
    newest = F.max(F.struct("created_at", "edit_id", "user_value")).alias("e")
    users = edits.groupBy("draft_id", "name").agg(newest).select("draft_id", "name", F.col("e.user_value").alias("user_value"), F.lit(True).alias("edited"))
    rows = fields.join(users, ["draft_id", "name"], "full_outer")
    edited = F.coalesce("edited", F.lit(False))
    return rows.select("draft_id", "name", F.when(edited, F.col("user_value")).otherwise(F.col("value")).alias("value"), F.when(edited, "user").otherwise("ai").alias("origin"))


def filled_edit_counts(specs: DataFrame, edits: DataFrame) -> DataFrame:
    """Every section of each template's newest version with its number of edits, 0 included."""
    last = specs.groupBy("template_id").agg(F.max("template_version").alias("template_version"))
    names = specs.join(last, ["template_id", "template_version"]).select("template_id", "name").distinct()
    counts = edits.where("field_type = 'section'").groupBy("template_id", F.col("field_or_section_name").alias("name")).agg(F.count("*").alias("edited_count"))
    return names.join(counts, ["template_id", "name"], "left").fillna(0, ["edited_count"])


def improvement(baseline: DataFrame, later: DataFrame) -> DataFrame:
    """ratio: mean of 1 - later / baseline over the (template, field) pairs with a baseline above 0; a pair without a later score has not changed."""
    rows = baseline.where("score > 0").join(later.select("template_id", "name", F.col("score").alias("post")), ["template_id", "name"], "left")
    return rows.agg(F.round(F.coalesce(F.avg(1 - F.coalesce("post", "score") / F.col("score")), F.lit(0.0)), 6).alias("ratio"), F.count("*").alias("n"))


def search_texts(edits: DataFrame) -> DataFrame:
    """edit_id, text: the lines by which an edit is found again, each cut and the whole cut."""
    size = F.when(F.col("field_type") == "section", F.lit(SECTION_CHARS)).otherwise(F.lit(VALUE_CHARS))
    lines = F.concat_ws("\n", "template_id", "field_or_section_name", F.left("ai_value", size), F.left("user_value", size))
    return edits.select("edit_id", F.left(lines, F.lit(BLOCK_CHARS)).alias("text"))


def kept_retries(old: DataFrame, new: DataFrame, needs_citations: DataFrame) -> DataFrame:
    """section_id, score, retried: a retried section stays if its score is no lower and its section must cite."""
    rows = old.select("section_id", F.col("score").alias("before")).join(new.select("section_id", F.col("score").alias("after")), "section_id", "left")
    rows = rows.join(needs_citations.select("section_id").distinct().withColumn("cites", F.lit(True)), "section_id", "left")
    better = F.coalesce(F.col("cites") & (F.col("after") >= F.col("before")), F.lit(False))
    return rows.select("section_id", F.when(better, F.col("after")).otherwise(F.col("before")).alias("score"), better.alias("retried"))


def gravest(verdicts: DataFrame) -> DataFrame:
    """section_id, status: the gravest status over all claims of a section."""
    rank = F.create_map(*(F.lit(x) for pair in SEVERITY.items() for x in pair))
    back = F.create_map(*(F.lit(x) for k, v in SEVERITY.items() for x in (v, k)))
    return verdicts.groupBy("section_id").agg(F.max(rank[F.col("status")]).alias("r")).select("section_id", back[F.col("r")].alias("status"))
