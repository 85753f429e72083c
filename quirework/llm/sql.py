"""DuckDB statements that state the numbered problems' results plainly."""

from __future__ import annotations

#: White space as a class of RE2, which has only ASCII in \s.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def words(column: str) -> str:
    """The list of a text's words."""
    return f"list_filter(regexp_split_to_array({column}, '{BLANK}'), lambda w: w <> '')"


def plain_words(column: str) -> str:
    """The list of a text's words in lower case with letters and digits only."""
    return f"list_filter(list_transform({words(f'lower({column})')}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


_SHARED = f"""
        WITH t AS (SELECT 'page_extractions' AS src, extraction_id AS row_id, full_text AS t FROM page_extractions
                   UNION SELECT 'draft_sections', section_id, ai_text FROM draft_sections),
             r AS (SELECT src, row_id, {words('t')} AS w FROM t WHERE t IS NOT NULL),
             g AS (SELECT src, row_id, k, array_to_string(w[k : k + 39], ' ') AS g FROM r, unnest(range(1, len(w) - 38)) AS u(k)),
             m AS (SELECT g FROM g GROUP BY g HAVING min(src || row_id) <> max(src || row_id)),
             x AS (SELECT DISTINCT src, row_id, k + d AS pos FROM g SEMI JOIN m USING (g), range(40) AS o(d))"""
_SIMILAR = f"""
        WITH p AS (SELECT DISTINCT extraction_id AS id, {words('lower(full_text)')} AS w FROM page_extractions),
             s AS (SELECT DISTINCT id, array_to_string(w[k : k + 2], ' ') AS g FROM p, unnest(range(1, len(w) - 1)) AS r(k) WHERE len(w) >= 30),
             k AS (SELECT id, md5(string_agg(g, chr(1) ORDER BY g)) AS own FROM s GROUP BY id),
             n AS (SELECT own, min(id) AS class_id FROM k GROUP BY own),
             f AS (SELECT s.id, s.g FROM s SEMI JOIN n ON n.class_id = s.id), z AS (SELECT id, count(*) AS n FROM f GROUP BY id),
             c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM f a JOIN f b ON a.g = b.g AND a.id <> b.id GROUP BY 1, 2),
             l AS (SELECT a, count(*) AS n_links FROM c JOIN z x ON x.id = a JOIN z y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.7 GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "p4_classes": f"{_SIMILAR} SELECT k.id AS extraction_id, class_id, coalesce(n_links, 0) AS n_links FROM k JOIN n USING (own) LEFT JOIN l ON l.a = class_id",
    "p5_spans": f"""{_SHARED}, i AS (SELECT *, pos - row_number() OVER (PARTITION BY src, row_id ORDER BY pos) AS run FROM x)
        SELECT src, row_id, (min(pos) - 1)::INT AS start_word, max(pos)::INT AS end_word FROM i GROUP BY src, row_id, run""",
    "p1_found": f"""
        WITH newest AS (SELECT template_id, name, arg_max(struct_pack(m := target_length_max), template_version).m AS m
                        FROM section_specs GROUP BY 1, 2)
        SELECT DISTINCT extraction_id FROM page_extractions p
        JOIN newest n ON p.template_id = n.template_id AND p.section_name = n.name
        WHERE len({words('p.full_text')}) > n.m
    """,
    "p9_found": f"""
        WITH d AS (SELECT doc_id, {plain_words('text')} AS w FROM documents),
             i AS (SELECT item_id, {plain_words('text')} AS w FROM eval_items),
             dg AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 12], ' ') AS g FROM d, unnest(range(1, len(w) - 11)) AS r(k)),
             ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 12], ' ') AS g FROM i, unnest(range(1, len(w) - 11)) AS r(k))
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
    "p4_found": f"""
        WITH p AS (SELECT DISTINCT extraction_id AS id, {words('lower(full_text)')} AS w FROM page_extractions),
             s AS (SELECT DISTINCT id, array_to_string(w[k : k + 2], ' ') AS g FROM p, unnest(range(1, len(w) - 1)) AS r(k) WHERE len(w) >= 30),
             n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
             c AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2)
        SELECT a AS extraction_id_a, b AS extraction_id_b FROM c JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c / (x.n + y.n - c) >= 0.7
    """,
    "p5_found": f"""
        WITH t AS (SELECT 'page_extractions' AS src, extraction_id AS row_id, full_text AS t FROM page_extractions
                   UNION SELECT 'draft_sections', section_id, ai_text FROM draft_sections),
             r AS (SELECT src, row_id, {words('t')} AS w FROM t WHERE t IS NOT NULL),
             g AS (SELECT src, row_id, k, array_to_string(w[k : k + 39], ' ') AS g FROM r, unnest(range(1, len(w) - 38)) AS u(k)),
             m AS (SELECT g FROM g GROUP BY g HAVING min(src || row_id) <> max(src || row_id)),
             x AS (SELECT DISTINCT src, row_id, k + d AS pos FROM g SEMI JOIN m USING (g), range(40) AS o(d))
        SELECT src, row_id, count(*) AS shared_words FROM x GROUP BY 1, 2
    """,
}
