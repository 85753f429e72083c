"""Page routing, grounding, diff and rule queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.operators import mining as M
from quirework.operators import nested
from quirework.operators import recognition as R
from quirework.plans.nested_queries import NEWEST
from quirework.sources.tables import read_table


def page_routing(spark: SparkSession, folder: str) -> DataFrame:
    """Pages by how they would be read: native ones have a layer, files whose type was forced an override."""
    pages = read_table(spark, folder, "page_extractions").dropDuplicates(["extraction_id"])
    chars = F.length(F.coalesce("full_text", F.lit("")))
    rows = pages.select(
        F.col("extraction_id").alias("page_id"), "document_id", "page_num", F.when(F.col("source") == "docling", "docling").alias("override"),
        F.when(F.col("source") == "pdfplumber", chars).otherwise(0).alias("layer_chars"), F.col("mean_confidence").alias("confidence"), chars.alias("chars"),
    )
    return R.page_routes(rows).select("page_id", "route")


def grounded_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Scalar fields of drafts with whether one of the draft's sections holds them."""
    fields = nested.flat_table(nested.shred(read_table(spark, folder, "drafts")), "field").where("doc = 'ai' and p_value is not null and not p_value rlike '^[\\\\[{]'")
    values = fields.select(F.concat_ws("/", "draft_id", "name").alias("value_id"), "draft_id", F.col("p_value").alias("value"))
    sections = read_table(spark, folder, "draft_sections").where("ai_text is not null").dropDuplicates(["section_id"])
    return M.grounded_values(values, sections.select("draft_id", F.col("ai_text").alias("text")), "draft_id")


def signal_terms(spark: SparkSession, folder: str) -> DataFrame:
    sections = read_table(spark, folder, "draft_sections").dropDuplicates(["section_id"])
    return sections.where("ai_text is not null").select("section_id", F.explode(M.signal_terms(F.regexp_replace("ai_text", r"\[chunk:[^\]]*\]", ""))).alias("term"))


def section_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Word changes from the drafted to the final text of each section."""
    rows = read_table(spark, folder, "draft_sections").dropDuplicates(["section_id"]).where("final_text is not null and ai_text is not null")
    return M.word_changes(rows.select(F.col("section_id").alias("pair_id"), F.col("ai_text").alias("old_text"), F.col("final_text").alias("new_text")))


def cut_sections(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "draft_sections").dropDuplicates(["section_id"]).where("ai_text is not null")
    return M.cut_texts(rows.select(F.col("section_id").alias("key"), F.col("ai_text").alias("text"), F.col("target_length_max").alias("most"))).select("key", "cut", F.length("text").alias("n_chars"))


def new_values(spark: SparkSession, folder: str) -> DataFrame:
    """Corrected values of a template that no earlier version of it was given."""
    edits = read_table(spark, folder, "few_shot_store").where("field_type = 'field'").select("template_id", "template_version", F.get_json_object("user_value", "$.value").alias("rule")).where("trim(rule) <> ''")
    return M.new_rules(edits.where("template_version >= 2"), edits.where("template_version < 2"))


QUERIES = {f.__name__: f for f in (page_routing, grounded_fields, signal_terms, section_changes, cut_sections, new_values)}

_SEC = "s AS (SELECT DISTINCT ON (section_id) * FROM draft_sections WHERE ai_text IS NOT NULL)"
_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
ORACLES = {
    "page_routing": """WITH p AS (SELECT DISTINCT ON (extraction_id) *, length(coalesce(full_text, '')) AS n FROM page_extractions),
        w AS (SELECT *, source IS DISTINCT FROM 'docling' AND (CASE WHEN source = 'pdfplumber' THEN n ELSE 0 END) < 50 AND coalesce(mean_confidence, 0) < 0.7 AS wanted FROM p),
        t AS (SELECT *, sum(wanted::INT) OVER (PARTITION BY document_id ORDER BY page_num, extraction_id) AS turn FROM w)
        SELECT extraction_id AS page_id, CASE WHEN source = 'docling' THEN 'docling' WHEN source = 'pdfplumber' AND n >= 50 THEN 'text_layer' WHEN NOT wanted THEN 'keep'
               WHEN turn <= 20 THEN CASE WHEN n < 50 THEN 'describe' ELSE 'transcribe' END ELSE 'visual_budget_exceeded' END AS route FROM t""",
    "grounded_fields": rf"""WITH {NEWEST}, {_SEC},
        f AS (SELECT draft_id, draft_id || '/' || name AS value_id, v->>'$' AS value FROM fields WHERE doc = 'ai' AND json_type(v) NOT IN ('NULL', 'OBJECT', 'ARRAY') AND NOT regexp_matches(v->>'$', '^[\[{{]')),
        a AS (SELECT value_id, draft_id, {_NORMAL.format('value')} AS v, list_distinct(list_filter(regexp_split_to_array(lower(value), '[^\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3)) AS w FROM f),
        p AS (SELECT a.*, {_NORMAL.format('s.ai_text')} AS t FROM a LEFT JOIN s USING (draft_id))
        SELECT value_id, bool_or(coalesce((contains(t, v) AND v <> '') OR (len(w) > 0 AND len(list_filter(w, lambda x: contains(t, x))) / len(w) >= 0.6), false)) AS grounded FROM p GROUP BY 1""",
    "signal_terms": rf"""WITH {_SEC}, c AS (SELECT section_id, regexp_replace(regexp_replace(ai_text, '\[chunk:[^\]]*\]', '', 'g'), '[\x{{AA}}\x{{B5}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{1FFF}}\x{{2C00}}-\x{{2FEF}}\x{{3040}}-\x{{D7FF}}\x{{F900}}-\x{{FDFF}}]', '_', 'g') AS t FROM s)
        SELECT section_id, unnest(list_distinct(list_concat(regexp_extract_all(t, '\b[A-Z][a-z]{{2,}}\b'), regexp_extract_all(t, '\b\d[\d,./-]*\d\b')))) AS term FROM c""",
    "new_values": """WITH e AS (SELECT template_id, template_version, user_value->>'$.value' AS rule FROM few_shot_store WHERE field_type = 'field' AND trim(user_value->>'$.value') <> '')
        SELECT template_id, min(rule) AS rule FROM e WHERE template_version >= 2 AND NOT EXISTS (SELECT 1 FROM e k WHERE k.template_version < 2 AND k.template_id = e.template_id AND lower(trim(k.rule)) = lower(trim(e.rule)))
        GROUP BY template_id, lower(trim(rule))""",
}
