"""Draft, section, template and edit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import drafting as D
from quirework.operators import events as E
from quirework.operators import nested
from quirework.sources.tables import read_table


def _sections(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "draft_sections").dropDuplicates(["section_id"])


def _edits(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "few_shot_store").drop("embedding").dropDuplicates(["edit_id"])


def _drafts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "drafts")


def citations_parse(spark: SparkSession, folder: str) -> DataFrame:
    return D.cited_chunks(_sections(spark, folder)).select("section_id", "place", "chunk_id")


def claims_segment(spark: SparkSession, folder: str) -> DataFrame:
    return D.claims(_sections(spark, folder)).select("section_id", "claim_no", F.size("chunk_ids").alias("n_chunks"), F.length("claim").alias("n_chars"))


def dangling_citations(spark: SparkSession, folder: str) -> DataFrame:
    chunks = nested.flat_table(nested.shred(_drafts(spark, folder)), "chunk").select("draft_id", F.col("p_chunk_id").alias("chunk_id"))
    return D.dangling_citations(_sections(spark, folder), chunks).groupBy("draft_id").agg(F.count_distinct("chunk_id").alias("n_dangling"))


def groundedness_scores(spark: SparkSession, folder: str) -> DataFrame:
    return D.groundedness(_sections(spark, folder))


def section_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of the sections' stored scores of each draft, nulls left out."""
    rows = nested.flat_table(nested.shred(_drafts(spark, folder)), "section").where("doc = 'ai'")
    return rows.groupBy("draft_id").agg(F.round(F.avg("p_groundedness"), 6).alias("mean_score"), F.count("p_groundedness").alias("n_scored"))


def section_checks(spark: SparkSession, folder: str) -> DataFrame:
    return D.length_checks(_sections(spark, folder))


def latest_template(spark: SparkSession, folder: str) -> DataFrame:
    return D.newest_versions(read_table(spark, folder, "section_specs")).withColumn("sections", F.array_join("sections", ","))


def template_changes(spark: SparkSession, folder: str) -> DataFrame:
    rows = D.version_changes(read_table(spark, folder, "section_specs"))
    return rows.withColumn("added", F.array_join("added", ",")).withColumn("removed", F.array_join("removed", ","))


def edit_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return D.edit_rates(_edits(spark, folder), _drafts(spark, folder))


def rule_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return D.rule_groups(_edits(spark, folder))


def edit_changes(spark: SparkSession, folder: str) -> DataFrame:
    """All edits, whatever their letters and nulls. DuckDB counts the distance in bytes, so that a test compares it with brute force instead."""
    return D.value_changes(_edits(spark, folder))


def edit_kinds(spark: SparkSession, folder: str) -> DataFrame:
    return D.value_changes(_edits(spark, folder)).select("edit_id", "kind")


def edit_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every draft with its number of edits, 0 included."""
    counts = _edits(spark, folder).groupBy("draft_id").agg(F.count("*").alias("n_edits"))
    return _drafts(spark, folder).select("draft_id").distinct().join(counts, "draft_id", "left").fillna(0, ["n_edits"])


def draft_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens, cost and mean score of the newest row of each draft, by model."""
    rows = E.latest(_drafts(spark, folder), ["draft_id"], F.struct("edited_at", "created_at"), "model_used", "tokens_in", "tokens_out", "cost_usd", "groundedness_score")
    return rows.groupBy("model_used").agg(F.count("*").alias("n"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("cost_usd").cast("double").alias("cost"), F.round(F.avg(F.col("groundedness_score").cast("double")), 6).alias("mean_score"))


def draft_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts whose documents are all ready, with how many they have."""
    rows = E.latest(_drafts(spark, folder), ["draft_id"], F.struct("edited_at", "created_at"), "document_ids")
    ready = read_table(spark, folder, "source_documents").where("status = 'ready'").select("document_id").distinct()
    pairs = rows.select("draft_id", F.explode("document_ids").alias("document_id")).distinct()
    return pairs.join(ready.withColumn("ready", F.lit(1)), "document_id", "left").groupBy("draft_id").agg(F.count("*").alias("n_documents"), F.bool_and(F.col("ready").isNotNull()).alias("all_ready"))


def draft_assembly(spark: SparkSession, folder: str) -> DataFrame:
    """Each draft with its sections in order of time and their citation counts, in one pass."""
    s = _sections(spark, folder).select("draft_id", "created_at", "section_id", "name", F.size(T.citations(F.coalesce("ai_text", F.lit("")))).alias("n"))
    parts = F.array_sort(F.collect_list(F.struct("created_at", "section_id", "name", "n")))
    return s.groupBy("draft_id").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["name"], F.lit(":"), p["n"].cast("string"))), ";").alias("sections"))


def parties_changed(spark: SparkSession, folder: str) -> DataFrame:
    """Parties by name that the final output of a draft adds to or drops from the drafted one."""
    rows = nested.flat_table(nested.shred(_drafts(spark, folder)), "party").withColumn("party", D.party_key("p_name"))
    sides = rows.groupBy("draft_id", "name").agg(F.collect_set(F.when(F.col("doc") == "ai", F.col("party"))).alias("ai"), F.collect_set(F.when(F.col("doc") == "final", F.col("party"))).alias("final"))
    diff = D.list_diff(sides, "ai", "final")
    return diff.select("draft_id", "name", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed"))


def validator_status(spark: SparkSession, folder: str) -> DataFrame:
    rows = nested.flat_table(nested.shred(_drafts(spark, folder)), "validator")
    return rows.groupBy(F.col("p_validator_id").alias("validator_id"), F.col("p_status").alias("status")).agg(F.count("*").alias("n"))


def template_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """A hash of each template version's sections, limits and validators; it does not depend on the order of rows."""
    line = F.concat_ws("|", "name", F.coalesce(F.col("target_length_min").cast("string"), F.lit("")), F.coalesce(F.col("target_length_max").cast("string"), F.lit("")), F.array_join("validators", ","))
    return read_table(spark, folder, "section_specs").groupBy("template_id", "template_version").agg(F.sha2(F.array_join(F.array_sort(F.collect_set(line)), "\n"), 256).alias("fingerprint"))


def claim_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The gravest verdict of each section's name over its validators' statuses."""
    rows = nested.flat_table(nested.shred(_drafts(spark, folder)), "validator").where("name is not null")
    status = F.when(F.col("p_status") == "ok", "supported").when(F.col("p_status") == "warn", "partial").when(F.col("p_status") == "fail", "unsupported")
    return D.merged_status(rows.select(F.concat_ws("/", "draft_id", "name").alias("claim_id"), status.alias("status")))


QUERIES = {
    f.__name__: f
    for f in (
        citations_parse, claims_segment, dangling_citations, groundedness_scores, section_scores, section_checks, latest_template, template_changes, edit_metrics, rule_candidates,
        edit_changes, edit_kinds, edit_counts, draft_usage, draft_documents, draft_assembly, parties_changed, validator_status, template_fingerprints, claim_verdicts,
    )
}

from quirework.plans.nested_queries import NEWEST  # noqa: E402

_SEC = "s AS (SELECT DISTINCT ON (section_id) * FROM draft_sections)"
CITE = r"\[chunk:([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\]"
WHITE = r"[\s\x{a0}\x{85}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_PARTS = r"list_filter(list_transform(string_split(regexp_replace(regexp_replace(ai_text, '([.!?])\s*((?:\[chunk:[^\]]+\]\s*)+)', '\1\2' || chr(1), 'g'), '([.!?])\s+([^\[])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda p: trim(p)), lambda p: p <> '')"
_CLAIMS = rf"""{_SEC},
    p AS (SELECT section_id, draft_id, unnest({_PARTS}) AS part, unnest(range(len({_PARTS}))) AS claim_no FROM s WHERE ai_text IS NOT NULL),
    claims AS (SELECT section_id, draft_id, claim_no, trim(regexp_replace(part, '\s*\[chunk:[^\]]*\]', '', 'g')) AS claim, len(regexp_extract_all(part, '{CITE}', 1)) AS n FROM p)"""
_EDITS = "e AS (SELECT DISTINCT ON (edit_id) * FROM few_shot_store)"
_LATEST = "d AS (SELECT * FROM drafts QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY edited_at DESC NULLS LAST, created_at DESC NULLS LAST) = 1)"
_VALIDATORS = f"WITH {NEWEST}, v AS (SELECT draft_id, e.value AS v FROM outputs, json_each(j, '$.validators') e WHERE doc = 'ai' AND json_type(j, '$.validators') = 'ARRAY' AND json_type(e.value) = 'OBJECT')"
ORACLES = {
    "citations_parse": f"WITH {_SEC} SELECT section_id, unnest(c) AS chunk_id, unnest(range(len(c)))::INT AS place FROM (SELECT section_id, regexp_extract_all(ai_text, '{CITE}', 1) AS c FROM s)",
    "claims_segment": f"WITH {_CLAIMS} SELECT section_id, claim_no::INT AS claim_no, n::INT AS n_chunks, length(claim)::INT AS n_chars FROM claims WHERE claim <> ''",
    "dangling_citations": f"""WITH {NEWEST}, {_SEC},
        sup AS (SELECT draft_id, e.value->>'$' AS chunk_id FROM fields, json_each(m, '$.supporting_chunk_ids') e WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') = 'ARRAY'
                UNION SELECT draft_id, m->>'$.supporting_chunk_ids' FROM fields WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') = 'VARCHAR'),
        c AS (SELECT draft_id, unnest(regexp_extract_all(ai_text, '{CITE}', 1)) AS chunk_id FROM s)
        SELECT draft_id, count(DISTINCT chunk_id) AS n_dangling FROM c WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.draft_id = c.draft_id AND sup.chunk_id = c.chunk_id) GROUP BY 1""",
    "groundedness_scores": f"""WITH {_CLAIMS}, x AS (SELECT draft_id, section_id, count(*) AS claims, sum((n > 0)::INT) AS cited FROM claims WHERE claim <> '' GROUP BY 1, 2)
        SELECT draft_id, sum(claims)::BIGINT AS claims, sum(cited)::BIGINT AS cited, round(sum(cited) / sum(claims), 3) AS by_claim, round(avg(cited / claims), 3) AS by_section FROM x GROUP BY 1""",
    "section_checks": f"""WITH {_SEC}, n AS (SELECT *, len(list_filter(regexp_split_to_array(coalesce(ai_text, ''), '{WHITE}'), lambda w: w <> '')) AS n FROM s)
        SELECT section_id, name, n::INT AS n_words, CASE WHEN n = 0 THEN 'fail' WHEN n BETWEEN coalesce(target_length_min, 0) AND coalesce(target_length_max, 2147483647) THEN 'ok' ELSE 'warn' END AS length_between,
               CASE WHEN regexp_matches(coalesce(ai_text, ''), '{CITE}') THEN 'ok' ELSE 'fail' END AS cites_at_least_one FROM n""",
    "section_scores": f"""WITH {NEWEST}, x AS (SELECT o.draft_id, m.name, TRY_CAST(json_extract_string(o.j, '$.sections_groundedness."' || m.name || '"') AS DOUBLE) AS g FROM outputs o JOIN members m ON o.draft_id = m.draft_id AND o.doc = m.doc WHERE o.doc = 'ai' AND m.part <> 'fields')
        SELECT draft_id, round(avg(g), 6) AS mean_score, count(g) AS n_scored FROM x GROUP BY 1""",
    "latest_template": "SELECT template_id, template_version, string_agg(DISTINCT name, ',' ORDER BY name) AS sections FROM section_specs s WHERE template_version = (SELECT max(template_version) FROM section_specs t WHERE t.template_id = s.template_id) GROUP BY 1, 2",
    "template_changes": """WITH n AS (SELECT template_id, template_version, list_sort(list_distinct(list(name))) AS names FROM section_specs GROUP BY 1, 2),
        b AS (SELECT *, coalesce(lag(names) OVER (PARTITION BY template_id ORDER BY template_version), []) AS before FROM n)
        SELECT template_id, template_version, array_to_string(list_filter(names, lambda x: NOT list_contains(before, x)), ',') AS added, array_to_string(list_filter(before, lambda x: NOT list_contains(names, x)), ',') AS removed FROM b""",
    "edit_metrics": f"""WITH {_EDITS}, t AS (SELECT template_id, count(DISTINCT draft_id) AS drafts FROM drafts GROUP BY 1),
        c AS (SELECT template_id, field_or_section_name, field_type, count(DISTINCT draft_id) AS edited FROM e GROUP BY 1, 2, 3)
        SELECT c.*, drafts, round(edited / drafts, 6) AS rate FROM c LEFT JOIN t USING (template_id)""",
    "rule_candidates": f"""WITH {_EDITS}, r AS (SELECT template_id, field_or_section_name, field_type, edit_id, row_number() OVER (PARTITION BY template_id, field_or_section_name, field_type ORDER BY created_at DESC, edit_id) AS k FROM e QUALIFY k <= 12)
        SELECT template_id, field_or_section_name, field_type, count(*) AS n, greatest(2, ceil(count(*) * 6 / 10))::INT AS min_evidence, string_agg(edit_id, ',' ORDER BY k) AS edit_ids FROM r GROUP BY 1, 2, 3 HAVING count(*) >= 3""",
    "edit_kinds": f"""WITH {_EDITS}, v AS (SELECT edit_id, trim(CASE field_type WHEN 'section' THEN ai_value->>'$.text' ELSE ai_value->>'$.value' END) AS a,
            trim(CASE field_type WHEN 'section' THEN user_value->>'$.text' ELSE user_value->>'$.value' END) AS u FROM e)
        SELECT edit_id, CASE WHEN a IS NOT DISTINCT FROM u THEN 'same' WHEN a IS NULL THEN 'added' WHEN u IS NULL THEN 'removed' ELSE 'modified' END AS kind FROM v""",
    "edit_counts": f"WITH {_EDITS}, c AS (SELECT draft_id, count(*) AS n FROM e GROUP BY 1) SELECT d.draft_id, coalesce(n, 0) AS n_edits FROM (SELECT DISTINCT draft_id FROM drafts) d LEFT JOIN c USING (draft_id)",
    "draft_usage": f"WITH {_LATEST} SELECT model_used, count(*) AS n, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, sum(cost_usd)::DOUBLE AS cost, round(avg(groundedness_score::DOUBLE), 6) AS mean_score FROM d GROUP BY 1",
    "draft_documents": f"""WITH {_LATEST}, p AS (SELECT DISTINCT draft_id, unnest(document_ids) AS document_id FROM d)
        SELECT draft_id, count(*) AS n_documents, bool_and(document_id IN (SELECT document_id FROM source_documents WHERE status = 'ready')) AS all_ready FROM p GROUP BY 1""",
    "draft_assembly": f"WITH {_SEC} SELECT draft_id, string_agg(name || ':' || len(regexp_extract_all(coalesce(ai_text, ''), '{CITE}', 1)), ';' ORDER BY created_at, section_id) AS sections FROM s GROUP BY 1",
    "validator_status": f"{_VALIDATORS} SELECT v->>'$.validator_id' AS validator_id, v->>'$.status' AS status, count(*) AS n FROM v GROUP BY 1, 2",
    "claim_verdicts": f"""{_VALIDATORS} SELECT draft_id || '/' || (v->>'$.field_or_section') AS claim_id,
        CASE coalesce(max(CASE v->>'$.status' WHEN 'ok' THEN 0 WHEN 'warn' THEN 1 WHEN 'fail' THEN 2 END), 2) WHEN 0 THEN 'supported' WHEN 1 THEN 'partial' ELSE 'unsupported' END AS status
        FROM v WHERE v->>'$.field_or_section' IS NOT NULL GROUP BY 1""",
    "template_fingerprints": """SELECT template_id, template_version, sha256(string_agg(DISTINCT concat_ws('|', name, coalesce(target_length_min::VARCHAR, ''), coalesce(target_length_max::VARCHAR, ''), array_to_string(validators, ',')), chr(10)
        ORDER BY concat_ws('|', name, coalesce(target_length_min::VARCHAR, ''), coalesce(target_length_max::VARCHAR, ''), array_to_string(validators, ',')))) AS fingerprint FROM section_specs GROUP BY 1, 2""",
    "parties_changed": f"""WITH {NEWEST}, p AS (SELECT draft_id, doc, name, lower(trim(v->>'$.name')) AS party FROM elements WHERE json_type(v) = 'OBJECT'),
        s AS (SELECT draft_id, name, list_distinct(list(party) FILTER (doc = 'ai')) AS a, list_distinct(list(party) FILTER (doc = 'final')) AS f FROM p GROUP BY 1, 2)
        SELECT draft_id, name, array_to_string(list_sort(list_filter(coalesce(f, []), lambda x: NOT list_contains(coalesce(a, []), x))), '|') AS added,
               array_to_string(list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(f, []), x))), '|') AS removed FROM s""",
}
