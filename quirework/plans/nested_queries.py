"""Queries over nested draft outputs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quirework.operators import nested
from quirework.plans.storage import shared_folder
from quirework.sources.tables import read_spread


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.found(read_spread(spark, folder, "drafts"), f"{shared_folder(spark)}/quirework-{uuid.uuid4().hex}")


def p6_parties(spark: SparkSession, folder: str) -> DataFrame:
    """Parties with the field each belongs to, from the written flat tables."""
    path = f"{shared_folder(spark)}/quirework-{uuid.uuid4().hex}"
    nested.write_tables(nested.shred(read_spread(spark, folder, "drafts")), path)
    parties, fields = nested.read_flat(spark, path, "party"), nested.read_flat(spark, path, "field")
    parent = fields.select("draft_id", "doc", "row_key").withColumnRenamed("row_key", "parent_key")
    return parties.join(parent, ["draft_id", "doc", "parent_key"]).select("draft_id", "doc", "name", "pos", "p_name", "p_role").distinct()


QUERIES = {"p6_found": p6_found, "p6_parties": p6_parties}

NEWEST = """
    newest AS (SELECT draft_id, ai_output, final_output FROM drafts WHERE draft_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY draft_id ORDER BY edited_at DESC NULLS LAST, created_at DESC NULLS LAST,
                                          ai_output DESC NULLS LAST, final_output DESC NULLS LAST) = 1),
    texts AS (SELECT draft_id, 'ai' AS doc, ai_output AS t FROM newest UNION ALL SELECT draft_id, 'final', final_output FROM newest),
    once AS (SELECT draft_id, doc, CASE WHEN json_valid(t) THEN t::JSON END AS j FROM texts),
    twice AS (SELECT draft_id, doc, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN (j->>'$')::JSON END ELSE j END AS j FROM once),
    outputs AS (SELECT * FROM twice WHERE json_type(j) = 'OBJECT'),
    members AS (
        SELECT draft_id, doc, part, key AS name, value AS m, false AS listed
        FROM outputs, (VALUES ('fields'), ('sections_text'), ('sections')) AS p(part), json_each(j, '$.' || part) e
        WHERE json_type(j, '$.' || part) = 'OBJECT'
        UNION ALL
        SELECT draft_id, doc, part, value->>'$.name', value, true
        FROM outputs, (VALUES ('fields'), ('sections_text'), ('sections')) AS p(part), json_each(j, '$.' || part) e
        WHERE json_type(j, '$.' || part) = 'ARRAY' AND value->>'$.name' IS NOT NULL),
    fields AS (SELECT draft_id, doc, name, m, listed,
                      CASE WHEN listed OR (json_type(m) = 'OBJECT' AND json_exists(m, '$.value')) THEN m->'$.value' ELSE m END AS v
               FROM members WHERE part = 'fields'),
    elements AS (SELECT draft_id, doc, name, e.rowid AS r, e.key::BIGINT AS pos, e.value AS v FROM fields, json_each(v) e WHERE json_type(v) = 'ARRAY'
                 UNION ALL SELECT draft_id, doc, name, 0, 0, v FROM fields WHERE json_type(v) = 'OBJECT')
"""

ORACLES = {
    "p6_parties": f"WITH {NEWEST} SELECT DISTINCT draft_id, doc, name, pos, v->>'$.name' AS p_name, v->>'$.role' AS p_role FROM elements WHERE json_type(v) = 'OBJECT'",
    "p6_found": f"""
    WITH {NEWEST}
    SELECT DISTINCT * FROM (
        SELECT draft_id, doc, 'field' AS kind, name, 0::BIGINT AS pos FROM fields
        UNION ALL SELECT draft_id, doc, CASE WHEN json_type(v) = 'OBJECT' THEN 'party' ELSE 'item' END, name, pos FROM elements WHERE json_type(v) <> 'NULL'
        UNION ALL SELECT draft_id, doc, 'chunk', name, e.key::BIGINT FROM fields, json_each(m, '$.supporting_chunk_ids') e
                  WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') = 'ARRAY' AND json_type(e.value) <> 'NULL'
        UNION ALL SELECT draft_id, doc, 'chunk', name, 0 FROM fields
                  WHERE doc = 'ai' AND json_type(m) = 'OBJECT' AND json_type(m, '$.supporting_chunk_ids') NOT IN ('ARRAY', 'NULL')
        UNION ALL SELECT draft_id, doc, 'section', name, 0 FROM members WHERE part <> 'fields'
        UNION ALL SELECT draft_id, doc, 'validator', e.value->>'$.field_or_section', e.key::BIGINT FROM outputs, json_each(j, '$.validators') e
                  WHERE doc = 'ai' AND json_type(j, '$.validators') = 'ARRAY' AND json_type(e.value) = 'OBJECT')
    """,
}
