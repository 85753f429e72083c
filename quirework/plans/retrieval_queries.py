"""Search queries: documents are chunks, their source is the owning document, document types are the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators import catalogs, search
from quirework.sources.tables import read_spread, read_table


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("doc"), "text")


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    types = read_table(spark, folder, "documents").where("doc_type is not null").select("doc_type").distinct()
    return types.select(F.col("doc_type").alias("query_id"), F.translate("doc_type", "_", " ").alias("query"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "source_documents").select(F.col("document_id").alias("id"), F.col("filename").alias("text")).distinct()


def _items(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def fts_cover_density(spark: SparkSession, folder: str) -> DataFrame:
    return search.best(search.lexical_search(_chunks(spark, folder), _questions(spark, folder)), 50)


def trigram_similarity(spark: SparkSession, folder: str) -> DataFrame:
    return search.best(search.trigram_search(_files(spark, folder), _questions(spark, folder)), 20)


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.dense_search(rows, rows.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)


def few_shot_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The nearest indexed edits of the same template and field."""
    store = read_table(spark, folder, "few_shot_store").where("few_shot_indexed_at is not null and size(embedding) = 1024")
    rows = store.select(F.col("edit_id").alias("id"), "template_id", F.col("field_or_section_name").alias("name"), "embedding").dropDuplicates(["id"])
    asked = rows.where("conv(right(id, 4), 16, 10) % 50 = 0").withColumnRenamed("id", "query_id")
    same = (F.col("template_id") == F.col("q_template_id")) & (F.col("name") == F.col("q_name")) & (F.col("id") != F.col("q_query_id"))
    return search.dense_search(rows, asked, 3, same)


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    chunks, questions = _chunks(spark, folder), _questions(spark, folder)
    lists = [search.best(search.lexical_search(chunks, questions), 50), search.best(search.trigram_search(chunks, questions, 0.0), 50)]
    return search.best(search.fuse(lists), 50)


def per_document_cap(spark: SparkSession, folder: str) -> DataFrame:
    chunks = _chunks(spark, folder)
    return search.cap_per_document(search.lexical_search(chunks, _questions(spark, folder)), chunks)


def entity_overlap(spark: SparkSession, folder: str) -> DataFrame:
    return search.entity_bonus(_chunks(spark, folder), _items(spark, folder))


def hybrid_retrieve(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.hybrid_retrieve(_chunks(spark, folder).join(vectors, "id", "left"), _typed_questions(spark, folder))


def _typed_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Document types as titles, each with the vector of its first document."""
    first = read_table(spark, folder, "documents").where("doc_type is not null").groupBy("doc_type").agg(F.min("doc_id").alias("vec_id"))
    vectors = read_table(spark, folder, "embeddings").select("vec_id", "embedding")
    return first.join(vectors, "vec_id", "left").select(F.col("doc_type").alias("query_id"), F.initcap(F.translate("doc_type", "_", " ")).alias("query"), "embedding")


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "page_extractions").select(F.col("extraction_id").alias("id"), F.col("document_id").alias("doc"), F.col("full_text").alias("text")).distinct()


#: Questions of two, four and eight terms.
TOPICS = {"notice": "notice mortgagee", "survey": "survey found encroachment parcel", "panel": "the arbitration panel awarded plus interest basis points"}


def _topics(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOPICS.items()), "query_id string, query string")


def fts_long_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all terms of questions of up to eight terms."""
    return search.best(search.lexical_search(_chunks(spark, folder), _topics(spark)), 20)


def ready_page_search(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of ready documents that hold all terms of a question."""
    documents = catalogs.newest_rows(read_table(spark, folder, "source_documents"))
    return search.best(search.lexical_search(search.ready_only(_pages(spark, folder), documents), _topics(spark)), 20)


def drafted_page_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same over the documents that some draft names."""
    ids = read_table(spark, folder, "drafts").select(F.explode("document_ids").alias("document_id"))
    return search.best(search.lexical_search(search.in_documents(_pages(spark, folder), ids), _topics(spark)), 20)


def keyword_hits(spark: SparkSession, folder: str) -> DataFrame:
    """For each question's ten best pages: whether one holds all its words, and the reciprocal rank of the first that holds any."""
    ranked = ready_page_search(spark, folder).where("rank <= 10").join(F.broadcast(_topics(spark)), "query_id").join(_pages(spark, folder).select("id", F.lower("text").alias("text")), "id")
    ranked = ranked.withColumn("words", F.split("query", " "))
    rows = ranked.select("query_id", "rank", F.forall("words", lambda w: F.contains(F.col("text"), w)).alias("all"), F.exists("words", lambda w: F.contains(F.col("text"), w)).alias("any"))
    return rows.groupBy("query_id").agg(F.bool_or("all").alias("hit"), F.round(F.coalesce(1 / F.min(F.when(F.col("any"), F.col("rank"))), F.lit(0.0)), 6).alias("rr"))


def trigram_gate(spark: SparkSession, folder: str) -> DataFrame:
    items = read_table(spark, folder, "eval_items")
    return items.select("item_id", T.needs_trigrams(F.col("text")).alias("run_trigram"))


def retrieval_eval(spark: SparkSession, folder: str) -> DataFrame:
    """Recall at 5 and 10 and mean reciprocal rank of each question's own type among its results, by type and overall."""
    ranked = fts_cover_density(spark, folder).where("rank <= 10")
    own = read_table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "doc_type")
    good = ranked.join(own, "id").where(F.col("doc_type") == F.col("query_id")).groupBy("query_id").agg(F.min("rank").alias("first"))
    all_questions = _questions(spark, folder).select("query_id").join(good, "query_id", "left")
    hit = lambda k: F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6)
    by = all_questions.rollup("query_id").agg(hit(5).alias("recall_5"), hit(10).alias("recall_10"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"))
    return by


QUERIES = {f.__name__: f for f in (fts_cover_density, trigram_similarity, dense_topk, few_shot_topk, rrf_fusion, per_document_cap, entity_overlap, hybrid_retrieve, trigram_gate, retrieval_eval, fts_long_questions, ready_page_search, drafted_page_search, keyword_hits)}

_TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_QUESTIONS = "questions AS (SELECT DISTINCT doc_type AS query_id, replace(doc_type, '_', ' ') AS query FROM documents WHERE doc_type IS NOT NULL)"


def _lexical(chunks: str) -> str:
    """Cover density of ``chunks`` (id, text) for ``questions`` with any number of terms."""
    return f"""
    asked AS (SELECT query_id, unnest(range(len(t))) AS k, unnest(t) AS term, len(t) AS n FROM (SELECT query_id, list_distinct({_TERMS.format('query')}) AS t FROM questions)),
    toks AS (SELECT id, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT id, {_TERMS.format('text')} AS t FROM {chunks})),
    met AS (SELECT query_id, id, pos, k, n FROM toks JOIN asked USING (term)),
    hits AS (SELECT * FROM met WHERE (query_id, id) IN (SELECT (query_id, id) FROM met GROUP BY query_id, id, n HAVING count(DISTINCT k) = n)),
    lasts AS (SELECT a.query_id, a.id, a.pos, a.n, b.k, max(b.pos) AS last FROM hits a JOIN hits b ON a.query_id = b.query_id AND a.id = b.id AND b.pos <= a.pos GROUP BY ALL),
    starts AS (SELECT query_id, id, pos, min(last) AS s FROM lasts GROUP BY query_id, id, pos, n HAVING count(*) = n),
    covers AS (SELECT query_id, id, s, min(pos) AS e FROM starts GROUP BY ALL),
    held AS (SELECT c.query_id, c.id, s, e, count(*) AS h FROM covers c JOIN hits t ON c.query_id = t.query_id AND c.id = t.id AND t.pos BETWEEN s AND e GROUP BY ALL),
    lexical AS (SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + (e - s) - (h - 1))), 9) AS score FROM held GROUP BY ALL),
    lexical50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lexical QUALIFY rank <= 50)"""


_LEXICAL = _lexical("(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)")


def _trigrams(text: str) -> str:
    padded = f"list_transform({_TERMS.format(text)}, lambda w: '  ' || w || ' ')"
    return f"list_distinct(flatten(list_transform({padded}, lambda p: list_transform(range(1, length(p) - 1), lambda i: substring(p, i, 3)))))"


def _trigram_list(chunks: str, least: float) -> str:
    return f"""
    tq AS (SELECT query_id, unnest(t) AS g, len(t) AS nq FROM (SELECT query_id, {_trigrams('query')} AS t FROM questions)),
    tc AS (SELECT id, unnest(t) AS g, len(t) AS n FROM (SELECT id, {_trigrams('text')} AS t FROM {chunks})),
    trigram AS (SELECT query_id, id, round(count(*) / (n + nq - count(*)), 9) AS score FROM tc JOIN tq USING (g) GROUP BY query_id, id, n, nq HAVING round(count(*) / (n + nq - count(*)), 9) >= {least})"""


_BOTH = f"""{_QUESTIONS}, {_LEXICAL}, {_trigram_list('(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)', 0.0)},
    trigram50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM trigram QUALIFY rank <= 50),
    fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM lexical50 UNION ALL SELECT query_id, id, rank FROM trigram50) GROUP BY ALL)"""
_LETTERS_TO_BARS = r"regexp_replace(t, '[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2C00}-\x{2FEF}\x{3040}-\x{D7FF}\x{F900}-\x{FDFF}]', '_', 'g')"
_S = r"[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PATTERNS = rf"""list_concat(regexp_extract_all({_LETTERS_TO_BARS}, '\b\d+{_S}+U\.?S\.?C\.?{_S}*§?{_S}*\d+(?:\([a-z]\))?\b'),
    regexp_extract_all(t, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][\p{{L}}\p{{N}}_]+{_S}+v\.{_S}+[A-Z][\p{{L}}\p{{N}}_]+)', 1),
    regexp_extract_all(regexp_replace({_LETTERS_TO_BARS}, '\.({_S})([A-Z])', '.\1_\2', 'g'), '\b(?:[A-Z][a-z]+{_S}){{1,3}}[A-Z][a-z]+\b'), regexp_extract_all(t, '\$[\d,]+(?:\.\d{{2}})?'),
    regexp_extract_all({_LETTERS_TO_BARS}, '\b(?:January|February|March|April|May|June|July|August|September|October|November|December){_S}+\d{{1,2}},?{_S}+\d{{4}}\b'))"""
NAMED_ENTITIES = f"""named AS (SELECT id, unnest(list_distinct(list_transform({_PATTERNS}, lambda x: trim(x)))) AS entity FROM (SELECT doc_id AS id, text AS t FROM documents WHERE text IS NOT NULL))"""
_DENSE = "round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"

_TOPICS = "questions(query_id, query) AS (VALUES " + ", ".join(f"('{name}', '{query}')" for name, query in TOPICS.items()) + ")"
_READY = "newest AS (SELECT document_id, arg_max(status, updated_at) AS status FROM source_documents GROUP BY 1)"
_READY_PAGES = "(SELECT DISTINCT extraction_id AS id, full_text AS text FROM page_extractions JOIN newest USING (document_id) WHERE full_text IS NOT NULL AND newest.status = 'ready')"

ORACLES = {
    "fts_cover_density": f"WITH {_QUESTIONS}, {_LEXICAL} SELECT * FROM lexical50",
    "per_document_cap": f"""WITH {_QUESTIONS}, {_LEXICAL},
        capped AS (SELECT l.*, d.source AS doc FROM lexical l JOIN documents d ON d.doc_id = l.id QUALIFY row_number() OVER (PARTITION BY query_id, d.source ORDER BY score DESC, id) <= 3)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM capped QUALIFY rank <= 50""",
    "trigram_similarity": f"""WITH {_QUESTIONS}, {_trigram_list('(SELECT DISTINCT document_id AS id, filename AS text FROM source_documents WHERE filename IS NOT NULL)', 0.15)}
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM trigram QUALIFY rank <= 20""",
    "rrf_fusion": f"WITH {_BOTH} SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 50",
    "dense_topk": f"""SELECT q.vec_id AS query_id, c.vec_id AS id, {_DENSE} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DENSE} DESC, c.vec_id) AS rank
        FROM embeddings c, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 10""",
    "few_shot_topk": f"""WITH c AS (SELECT DISTINCT ON (edit_id) edit_id, template_id, field_or_section_name AS name, embedding FROM few_shot_store
            WHERE few_shot_indexed_at IS NOT NULL AND len(embedding) = 1024 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
        SELECT q.edit_id AS query_id, c.edit_id AS id, {_DENSE} AS score, row_number() OVER (PARTITION BY q.edit_id ORDER BY {_DENSE} DESC, c.edit_id) AS rank
        FROM c JOIN c q ON c.template_id = q.template_id AND c.name = q.name AND c.edit_id <> q.edit_id
        WHERE ('0x' || right(q.edit_id, 4))::INT % 50 = 0 QUALIFY rank <= 3""",
    "entity_overlap": f"""WITH {NAMED_ENTITIES}, asked AS (SELECT query_id, unnest(list_distinct(list_transform({_PATTERNS}, lambda x: lower(trim(x))))) AS entity FROM (SELECT item_id AS query_id, text AS t FROM eval_items WHERE item_id % 50 = 0))
        SELECT query_id, id, round(count(*) * 0.1::DOUBLE, 9) AS bonus FROM named JOIN asked ON lower(named.entity) = asked.entity GROUP BY 1, 2""",
    "fts_long_questions": f"""WITH {_TOPICS}, {_LEXICAL} SELECT * FROM lexical50 WHERE rank <= 20""",
    "ready_page_search": f"""WITH {_TOPICS}, {_READY}, {_lexical(_READY_PAGES)} SELECT * FROM lexical50 WHERE rank <= 20""",
    "drafted_page_search": f"""WITH {_TOPICS}, {_lexical("(SELECT DISTINCT extraction_id AS id, full_text AS text FROM page_extractions WHERE full_text IS NOT NULL AND document_id IN (SELECT unnest(document_ids) FROM drafts))")} SELECT * FROM lexical50 WHERE rank <= 20""",
    "keyword_hits": f"""WITH {_TOPICS}, {_READY}, {_lexical(_READY_PAGES)}, x AS (SELECT l.query_id, rank, string_split(q.query, ' ') AS w, lower(p.full_text) AS t FROM lexical50 l JOIN questions q USING (query_id) JOIN (SELECT DISTINCT extraction_id, full_text FROM page_extractions) p ON p.extraction_id = l.id WHERE rank <= 10),
        y AS (SELECT query_id, rank, len(list_filter(w, lambda k: NOT contains(t, k))) = 0 AS a, len(list_filter(w, lambda k: contains(t, k))) > 0 AS o FROM x)
        SELECT query_id, bool_or(a) AS hit, round(coalesce(1 / min(CASE WHEN o THEN rank END), 0), 6) AS rr FROM y GROUP BY 1""",
    "hybrid_retrieve": f"""WITH questions AS (SELECT doc_type AS query_id, array_to_string(list_transform(string_split(doc_type, '_'), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS query, min(doc_id) AS vec_id FROM documents WHERE doc_type IS NOT NULL GROUP BY 1),
        {_LEXICAL},
        dense AS (SELECT q.query_id, d.doc_id AS id, {_DENSE} AS score FROM questions q JOIN embeddings q0 ON q0.vec_id = q.vec_id, documents d JOIN embeddings c ON c.vec_id = d.doc_id, (SELECT 1) WHERE q0.embedding IS NOT NULL),
        dense50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM dense QUALIFY rank <= 50),
        {_trigram_list('(SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)', 0.15).replace('FROM questions', "FROM questions WHERE regexp_matches(query, '[A-Z][a-z]+ [A-Z][a-z]+')")},
        trigram50 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM trigram QUALIFY rank <= 50),
        parts AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM lexical50 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM dense50 UNION ALL SELECT query_id, id, 0.5::DOUBLE / (60 + rank) FROM trigram50),
        fused0 AS (SELECT query_id, id, round(sum(p), 9) AS score FROM parts GROUP BY ALL), {NAMED_ENTITIES},
        asked_e AS (SELECT query_id, unnest(list_distinct(list_transform({_PATTERNS}, lambda x: lower(trim(x))))) AS entity FROM (SELECT query_id, query AS t FROM questions)),
        bonus AS (SELECT query_id, id, round(count(*) * 0.1::DOUBLE, 9) AS b FROM named JOIN asked_e ON lower(named.entity) = asked_e.entity GROUP BY 1, 2),
        fused AS (SELECT query_id, id, round(score + coalesce(b, 0), 9) AS score FROM fused0 LEFT JOIN bonus USING (query_id, id)),
        capped AS (SELECT f.*, d.source AS doc FROM fused f JOIN documents d ON d.doc_id = f.id QUALIFY row_number() OVER (PARTITION BY query_id, d.source ORDER BY score DESC, id) <= 3)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM capped QUALIFY rank <= 8""".replace("q.embedding", "q0.embedding"),
    "trigram_gate": "SELECT item_id, regexp_matches(text, '[A-Z][a-z]+\\s+[A-Z][a-z]+') OR contains(text, '§') AS run_trigram FROM eval_items",
    "retrieval_eval": f"""WITH {_QUESTIONS}, {_LEXICAL},
        good AS (SELECT query_id, min(rank) AS first FROM lexical50 JOIN documents d ON d.doc_id = id AND d.doc_type = query_id WHERE rank <= 10 GROUP BY 1)
        SELECT query_id, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10,
               round(avg(coalesce(1 / first, 0)), 6) AS mrr, count(*) AS n FROM questions LEFT JOIN good USING (query_id) GROUP BY ROLLUP (query_id)""",
}
