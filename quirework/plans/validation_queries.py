"""Queries on claims by citation tag and what follows from their verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirework.operators import nested
from quirework.operators import validation as V
from quirework.plans.draft_queries import CITE, WHITE
from quirework.plans.nested_queries import NEWEST
from quirework.sources.tables import read_table


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "draft_sections").dropDuplicates(["section_id"])


def _flat(spark: SparkSession, folder: str, tag: str) -> DataFrame:
    return nested.flat_table(nested.shred(read_table(spark, folder, "drafts")), tag)


def _retrieved(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(spark, folder, "chunk").select("draft_id", F.col("p_chunk_id").alias("chunk_id"))


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "few_shot_store").drop("embedding").dropDuplicates(["edit_id"])


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return V.claim_verdicts(V.claims_by_tag(_sections(spark, folder)), _retrieved(spark, folder))


def tag_claims(spark: SparkSession, folder: str) -> DataFrame:
    return V.claims_by_tag(_sections(spark, folder)).select("section_id", "claim_no", "claim", "chunk_id")


def claim_support(spark: SparkSession, folder: str) -> DataFrame:
    """Claims of each draft by status and reason."""
    return _verdicts(spark, folder).groupBy("draft_id", "status", "reason").agg(F.count("*").alias("n"))


def citation_status(spark: SparkSession, folder: str) -> DataFrame:
    return V.citation_statuses(_verdicts(spark, folder)).select("section_id", "chunk_id", "status")


def section_status(spark: SparkSession, folder: str) -> DataFrame:
    return V.gravest(_verdicts(spark, folder))


def citation_validity(spark: SparkSession, folder: str) -> DataFrame:
    return V.validity_metrics(_verdicts(spark, folder))


def revalidation(spark: SparkSession, folder: str) -> DataFrame:
    """What citations become whose draft was edited since; those of other drafts are left as they are."""
    verdicts = _verdicts(spark, folder)
    edited = read_table(spark, folder, "drafts").groupBy("draft_id").agg(F.bool_or(F.col("edited_at").isNotNull()).alias("edited"))
    stored = verdicts.where("chunk_id is not null").select("section_id", "draft_id", "chunk_id").join(edited, "draft_id")
    stored = stored.withColumn("validation_status", F.when(F.col("edited"), "stale").otherwise("supported"))
    return V.revalidated(V.citation_statuses(verdicts), stored)


def stripped_texts(spark: SparkSession, folder: str) -> DataFrame:
    return V.without_dangling(_sections(spark, folder), _retrieved(spark, folder)).select("section_id", "n_dangling", F.md5("text").alias("digest"))


def replaced_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections with their final text in place of the drafted one, where there is one."""
    sections = _sections(spark, folder)
    texts = sections.where("final_text is not null").select("section_id", F.col("final_text").alias("text"))
    return V.section_replaced(sections, texts).select("section_id", "replaced", F.coalesce(F.size("chunk_ids"), F.lit(0)).alias("n_citations"), F.md5("ai_text").alias("digest"))


def retried_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Share of claims with a known chunk, against the share with any chunk as the retry's score."""
    rows = _verdicts(spark, folder)
    old = rows.groupBy("section_id").agg(F.round(F.avg(F.when(F.col("status") == "supported", 1.0).otherwise(0.0)), 6).alias("score"))
    new = rows.groupBy("section_id").agg(F.round(F.avg(F.when(F.col("chunk_id").isNotNull(), 1.0).otherwise(0.0)), 6).alias("score"))
    return V.kept_retries(old, new, rows.where("chunk_id is not null").select("section_id"))


def field_coercion(spark: SparkSession, folder: str) -> DataFrame:
    named = _flat(spark, folder, "chunk").groupBy("draft_id", "name").agg(F.count("*").alias("n_named"))
    fields = _flat(spark, folder, "field").where("doc = 'ai'").select("draft_id", "name", F.col("p_value").alias("value"), F.col("p_confidence").alias("confidence"))
    return V.coerced_fields(fields.join(named, ["draft_id", "name"], "left"), _retrieved(spark, folder)).select("draft_id", "name", F.col("value").isNotNull().alias("has_value"), F.round("confidence", 6).alias("confidence"), "n_support")


def merged_outputs(spark: SparkSession, folder: str) -> DataFrame:
    fields = _flat(spark, folder, "field").where("doc = 'ai'").select("draft_id", "name", F.col("p_value").alias("value"))
    edits = _edits(spark, folder).where("field_type = 'field'").withColumnRenamed("field_or_section_name", "name")
    return V.merged_fields(fields, edits).select("draft_id", "name", "origin")


def template_edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return V.filled_edit_counts(read_table(spark, folder, "section_specs"), _edits(spark, folder))


def improvement_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """How much shorter changes got: mean change in letters of the edits of older against those of newest template versions."""
    edits = _edits(spark, folder)
    newest = edits.groupBy("template_id").agg(F.max("template_version").alias("newest"))
    change = F.abs(F.length(F.coalesce("user_value", F.lit(""))) - F.length(F.coalesce("ai_value", F.lit(""))))
    rows = edits.join(newest, "template_id").select("template_id", F.col("field_or_section_name").alias("name"), (F.col("template_version") == F.col("newest")).alias("late"), change.alias("change"))
    score = F.round(F.avg("change"), 6).alias("score")
    return V.improvement(rows.where("not late").groupBy("template_id", "name").agg(score), rows.where("late").groupBy("template_id", "name").agg(score))


def edit_search_texts(spark: SparkSession, folder: str) -> DataFrame:
    return V.search_texts(_edits(spark, folder)).select("edit_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def page_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The first pages of each document as evidence."""
    pages = read_table(spark, folder, "page_extractions").where("full_text is not null and document_id is not null").select("extraction_id", "document_id", "page_num", "full_text").distinct()
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("page_num", "extraction_id"))
    chunks = pages.select(F.col("document_id").alias("name"), F.col("extraction_id").alias("id"), F.col("full_text").alias("text"), rank.alias("rank"))
    return V.evidence(chunks).select(F.col("name").alias("document_id"), F.md5("evidence").alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_claims, claim_support, citation_status, section_status, citation_validity, revalidation, stripped_texts, replaced_sections, retried_sections, field_coercion, merged_outputs,
        template_edit_counts, improvement_ratio, edit_search_texts, page_evidence,
    )
}


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WHITE}|{WHITE}$', '', 'g')"


def _pieces(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?]){WHITE}', '\\1' || chr(1), 'g'), chr(1))"


_S = "s AS (SELECT DISTINCT ON (section_id) * FROM draft_sections)"
_E = "e AS (SELECT DISTINCT ON (edit_id) * FROM few_shot_store)"
_SUP = """sup AS (SELECT draft_id, e.value->>'$' AS chunk_id, name FROM fields, json_each(m, '$.supporting_chunk_ids') e WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') = 'ARRAY' AND json_type(e.value) <> 'NULL'
        UNION ALL SELECT draft_id, m->>'$.supporting_chunk_ids', name FROM fields WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') NOT IN ('ARRAY', 'NULL'))"""
_CLAIMS = f"""{_S},
    x AS (SELECT section_id, draft_id, ai_text, regexp_extract_all(ai_text, '{CITE}', 1) AS ids, string_split_regex(ai_text, '{CITE}') AS parts FROM s WHERE ai_text IS NOT NULL AND ai_text <> ''),
    tagged AS (SELECT section_id, draft_id, k AS claim_no, {_strip(f"replace({_pieces('parts[k + 1] || chr(2)')}[-1], chr(2), '')")} AS claim, ids[k + 1] AS chunk_id FROM x, unnest(range(len(ids))) AS r(k)),
    rest AS (SELECT section_id, draft_id, len(ids) AS n, list_filter(list_transform({_pieces(_strip('parts[-1]'))}, lambda p: {_strip('p')}), lambda p: p <> '' AND NOT regexp_matches(p, '^[\\s.,;:!?]+$')) AS c FROM x WHERE len(ids) > 0),
    claims AS (SELECT * FROM tagged UNION ALL SELECT section_id, draft_id, n + j, c[j + 1], NULL FROM rest, unnest(range(len(c))) AS r(j)
               UNION ALL SELECT section_id, draft_id, 0, {_strip('ai_text')}, NULL FROM x WHERE len(ids) = 0)"""
_VERDICTS = f"""{NEWEST}, {_SUP}, {_CLAIMS},
    v AS (SELECT c.*, chunk_id IS NOT NULL AND (draft_id, chunk_id) IN (SELECT (draft_id, chunk_id) FROM sup) AS ok FROM claims c),
    verdicts AS (SELECT *, CASE WHEN ok THEN 'supported' ELSE 'unsupported' END AS status, CASE WHEN chunk_id IS NULL THEN 'claim has no citation' WHEN NOT ok THEN 'chunk_id not in retrieved set' END AS reason FROM v)"""
ORACLES = {
    "tag_claims": f"WITH {_CLAIMS} SELECT section_id, claim_no::INT AS claim_no, claim, chunk_id FROM claims",
    "claim_support": f"WITH {_VERDICTS} SELECT draft_id, status, reason, count(*) AS n FROM verdicts GROUP BY ALL",
    "citation_status": f"WITH {_VERDICTS} SELECT section_id, chunk_id, arg_min(status, claim_no) AS status FROM verdicts WHERE chunk_id IS NOT NULL GROUP BY 1, 2",
    "section_status": f"WITH {_VERDICTS} SELECT section_id, max(status) AS status FROM verdicts GROUP BY 1",
    "citation_validity": f"""WITH {_VERDICTS}, p AS (SELECT section_id, count(*) AS n, sum(ok::INT) AS k, sum((reason LIKE 'chunk%')::INT) AS f FROM verdicts GROUP BY 1)
        SELECT round(sum(k) / sum(n), 6) AS supported_share, round(avg((k >= 0.8::DOUBLE * n)::INT), 6) AS high_share, sum(coalesce(f, 0))::BIGINT AS fabricated, sum(n)::BIGINT AS claims, count(*) AS sections FROM p""",
    "revalidation": f"""WITH {_VERDICTS}, d AS (SELECT draft_id FROM drafts GROUP BY 1 HAVING bool_or(edited_at IS NOT NULL)), c AS (SELECT section_id, chunk_id, arg_min(status, claim_no) AS status FROM verdicts WHERE chunk_id IS NOT NULL AND draft_id IN (FROM d) GROUP BY 1, 2)
        SELECT status, count(*) AS n FROM c GROUP BY 1""",
    "stripped_texts": f"""WITH {NEWEST}, {_SUP}, {_S}, known AS (SELECT draft_id, list(DISTINCT chunk_id) AS known FROM sup GROUP BY 1),
        t AS (SELECT section_id, ai_text, list_filter(regexp_extract_all(ai_text, '{CITE}', 1), lambda c: NOT coalesce(list_contains(known, c), false)) AS d FROM s LEFT JOIN known USING (draft_id) WHERE ai_text IS NOT NULL)
        SELECT section_id, len(d)::INT AS n_dangling, md5(CASE WHEN len(d) = 0 THEN ai_text ELSE regexp_replace(ai_text, '\\[chunk:(?:' || array_to_string(d, '|') || ')\\]', '', 'g') END) AS digest FROM t""",
    "replaced_sections": f"WITH {_S} SELECT section_id, final_text IS NOT NULL AS replaced, coalesce(len(regexp_extract_all(coalesce(final_text, ai_text), '{CITE}', 1)), 0)::INT AS n_citations, md5(coalesce(final_text, ai_text)) AS digest FROM s",
    "retried_sections": f"""WITH {_VERDICTS}, p AS (SELECT section_id, round(avg(ok::INT), 6) AS b, round(avg((chunk_id IS NOT NULL)::INT), 6) AS a FROM verdicts GROUP BY 1)
        SELECT section_id, CASE WHEN a > 0 THEN a ELSE b END AS score, a > 0 AS retried FROM p""",
    "field_coercion": f"""WITH {NEWEST}, {_SUP}, al AS (SELECT draft_id, count(DISTINCT chunk_id) AS n FROM sup GROUP BY 1), nm AS (SELECT draft_id, name, count(*) AS n FROM sup GROUP BY 1, 2),
        f AS (SELECT draft_id, name, coalesce(json_type(v), 'NULL') <> 'NULL' AND lower(trim(v->>'$')) <> 'null' AS has, CASE WHEN json_type(m) = 'OBJECT' AND (listed OR json_exists(m, '$.value')) AND json_type(m, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN (m->>'$.confidence')::DOUBLE END AS c FROM fields WHERE doc = 'ai')
        SELECT f.draft_id, f.name, has AS has_value, round(CASE WHEN NOT has THEN 0 WHEN coalesce(c, 0) = 0 THEN 0.8 ELSE c END, 6)::DOUBLE AS confidence, CASE WHEN NOT has THEN 0 ELSE coalesce(nm.n, al.n, 0) END AS n_support
        FROM f LEFT JOIN nm ON f.draft_id = nm.draft_id AND f.name = nm.name LEFT JOIN al ON f.draft_id = al.draft_id""",
    "merged_outputs": f"""WITH {NEWEST}, {_E}, u AS (SELECT DISTINCT draft_id, field_or_section_name AS name FROM e WHERE field_type = 'field'), f AS (SELECT draft_id, name FROM fields WHERE doc = 'ai')
        SELECT coalesce(f.draft_id, u.draft_id) AS draft_id, coalesce(f.name, u.name) AS name, CASE WHEN u.name IS NOT NULL THEN 'user' ELSE 'ai' END AS origin FROM f FULL JOIN u ON f.draft_id = u.draft_id AND f.name = u.name""",
    "template_edit_counts": f"""WITH {_E}, n AS (SELECT DISTINCT template_id, name FROM section_specs s WHERE template_version = (SELECT max(template_version) FROM section_specs t WHERE t.template_id = s.template_id)),
        c AS (SELECT template_id, field_or_section_name AS name, count(*) AS k FROM e WHERE field_type = 'section' GROUP BY 1, 2) SELECT n.template_id, n.name, coalesce(k, 0) AS edited_count FROM n LEFT JOIN c ON n.template_id = c.template_id AND n.name = c.name""",
    "improvement_ratio": f"""WITH {_E}, r AS (SELECT template_id, field_or_section_name AS name, template_version = max(template_version) OVER (PARTITION BY template_id) AS late, abs(length(coalesce(user_value, '')) - length(coalesce(ai_value, ''))) AS d FROM e),
        b AS (SELECT template_id, name, round(avg(d), 6) AS s FROM r WHERE NOT late GROUP BY 1, 2), p AS (SELECT template_id, name, round(avg(d), 6) AS s FROM r WHERE late GROUP BY 1, 2)
        SELECT round(coalesce(avg(1 - coalesce(p.s, b.s) / b.s), 0), 6) AS ratio, count(*) AS n FROM b LEFT JOIN p ON b.template_id = p.template_id AND b.name = p.name WHERE b.s > 0""",
    "edit_search_texts": f"""WITH {_E}, t AS (SELECT edit_id, left(concat_ws(chr(10), template_id, field_or_section_name, left(ai_value, CASE WHEN field_type = 'section' THEN 800 ELSE 1500 END), left(user_value, CASE WHEN field_type = 'section' THEN 800 ELSE 1500 END)), 3500) AS t FROM e)
        SELECT edit_id, length(t)::INT AS n_chars, md5(t) AS digest FROM t""",
    "page_evidence": """WITH p AS (SELECT DISTINCT extraction_id, document_id, page_num, full_text FROM page_extractions WHERE full_text IS NOT NULL AND document_id IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num NULLS FIRST, extraction_id) AS k FROM p QUALIFY k <= 8)
        SELECT document_id, md5(string_agg('[chunk:' || extraction_id || '] ' || left(full_text, 1000), chr(10) || chr(10) ORDER BY k)) AS digest FROM r GROUP BY 1""",
}
