"""Batched search: every operator takes all queries at once as a DataFrame.

Chunks have ``id``, ``doc`` and ``text``; queries have ``query_id`` and
``query``. Ranked lists have ``query_id``, ``id`` and ``score``. Every ranking is
a total order: the score rounded to nine places, then the id.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vector as V
from quirework.plans.storage import broadcast_if_small


#: Queries with a vector in one broadcast; more make several passes over the rows.
QUERIES_AT_ONCE = 5_000


def best(ranked: DataFrame, k: int, *, by: str = "query_id") -> DataFrame:
    """The ``k`` best of each query, with their 1-based rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ready_only(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents whose newest state is ready."""
    ready = documents.where(F.col("status") == "ready").select(F.col("document_id").alias("doc")).distinct()
    return chunks.join(broadcast_if_small(ready), "doc", "left_semi")


def in_documents(chunks: DataFrame, ids: DataFrame | list[str] | None) -> DataFrame:
    """Chunks of the documents named: None names all, an empty list none."""
    if ids is None:
        return chunks
    if isinstance(ids, list):
        return chunks.where(F.col("doc").isin(ids))
    return chunks.join(broadcast_if_small(ids.select(F.col("document_id").alias("doc")).distinct()), "doc", "left_semi")


def _with_cover(state: Column, hit: Column, at: Column) -> Column:
    """The fold of one hit: the last place of each term, and the gain of the cover that this hit ends, if it is a new one."""
    last = F.transform(state["last"], lambda place, k: F.when(k == hit["k"], F.struct(hit["pos"].alias("pos"), at.alias("at"))).otherwise(place))
    start = F.array_min(last)
    fresh = (start["pos"] >= 0) & (start["pos"] > state["start"])
    gain = F.lit(0.1) / (1 + (hit["pos"] - start["pos"]) - (at - start["at"]))
    return F.struct(last.alias("last"), F.when(fresh, start["pos"]).otherwise(state["start"]).alias("start"), (state["total"] + F.when(fresh, gain).otherwise(0.0)).alias("total"))


def lexical_search(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Chunks that hold all terms of a query, however many, scored by cover density.

    A cover is a shortest run of words that holds every term; it adds
    0.1 / (1 + number of other words in it). Queries without terms match
    nothing. A chunk's hits of one query are one row, folded in order.
    """
    asked = queries.select("query_id", F.array_distinct(T.terms(F.col("query"))).alias("terms")).where("size(terms) > 0")
    asked = asked.select("query_id", F.size("terms").alias("n"), F.posexplode("terms").alias("k", "term"))
    hits = chunks.select("id", F.posexplode(T.terms(F.col("text"))).alias("pos", "term")).join(broadcast_if_small(asked), "term")
    held = hits.groupBy("query_id", "id", "n").agg(F.array_sort(F.collect_list(F.struct("pos", "k"))).alias("hits"))
    held = held.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["k"]))) == F.col("n"))
    numbered = F.transform("hits", lambda h, at: F.struct(h.alias("hit"), at.alias("at")))
    nowhere = F.array_repeat(F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("at")), F.col("n"))
    zero = F.struct(nowhere.alias("last"), F.lit(-1).alias("start"), F.lit(0.0).alias("total"))
    score = F.aggregate(numbered, zero, lambda state, x: _with_cover(state, x["hit"], x["at"]), lambda state: state["total"])
    return held.select("query_id", "id", F.round(score, 9).alias("score"))


def trigram_search(chunks: DataFrame, queries: DataFrame, least: float = 0.15) -> DataFrame:
    """Chunks whose trigrams are at least ``least`` similar (intersection over union) to a query's.

    Only chunks that share a trigram with a query meet it.
    """
    asked = queries.select("query_id", T.trigrams(F.col("query")).alias("t")).select("query_id", F.size("t").alias("n_query"), F.explode("t").alias("trigram"))
    own = chunks.select("id", T.trigrams(F.col("text")).alias("t")).select("id", F.size("t").alias("n"), F.explode("t").alias("trigram"))
    common = own.join(broadcast_if_small(asked), "trigram").groupBy("query_id", "id", "n", "n_query").agg(F.count("*").alias("c"))
    score = F.round(F.col("c") / (F.col("n") + F.col("n_query") - F.col("c")), 9)
    return common.select("query_id", "id", score.alias("score")).where(F.col("score") >= least)


def dense_search(chunks: DataFrame, queries: DataFrame, k: int, on: Column | None = None) -> DataFrame:
    """The ``k`` chunks of largest cosine for each query; a stated set of queries against all rows.

    Chunks and queries have ``embedding``; rows without a usable one are left
    out. ``on`` restricts pairs, such as to one template and field. The queries
    are taken in blocks that are small enough to be broadcast; each block keeps
    its best chunks per partition before anything is shuffled.
    """
    asked = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns)).withColumn("q_norm", V.norm(F.col("q_embedding"))).where("q_norm > 0")
    rows = chunks.withColumn("c_norm", V.norm(F.col("embedding"))).where("c_norm > 0")
    blocks = max(1, -(-queries.count() // QUERIES_AT_ONCE))
    score = F.round(V.dot(F.col("embedding"), F.col("q_embedding")) / (F.col("c_norm") * F.col("q_norm")), 6)
    parts = []
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("q_query_id"), F.lit(blocks)) == block)
        pairs = rows.join(F.broadcast(some), on if on is not None else F.size("embedding") == F.size("q_embedding"))
        parts.append(best(pairs.select(F.col("q_query_id").alias("query_id"), "id", score.alias("score")).where("score is not null"), k))
    return reduce(DataFrame.unionByName, parts)


def fuse(lists: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists; three lists weigh 1, 1 and 0.5 by default."""
    weights = weights or ([1.0, 1.0, 0.5] if len(lists) == 3 else [1.0] * len(lists))
    parts = [one.select("query_id", "id", (F.lit(w) / (k + F.col("rank"))).alias("part")) for one, w in zip(lists, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"))


def entity_bonus(chunks: DataFrame, queries: DataFrame, each: float = 0.1) -> DataFrame:
    """query_id, id, bonus: ``each`` for every entity of a chunk that the query names too, whatever its case."""
    asked = queries.select("query_id", F.explode(F.array_distinct(F.transform(T.entities(F.col("query")), F.lower))).alias("entity"))
    own = chunks.select("id", F.explode(T.entities(F.col("text"))).alias("entity")).withColumn("entity", F.lower("entity"))
    return own.join(broadcast_if_small(asked), "entity").groupBy("query_id", "id").agg(F.round(F.count("*") * each, 9).alias("bonus"))


def cap_per_document(ranked: DataFrame, chunks: DataFrame, cap: int = 3, keep: int = 50) -> DataFrame:
    """At most ``cap`` chunks of a document in each query's list, and ``keep`` in all."""
    with_doc = ranked.join(chunks.select("id", "doc"), "id")
    order = Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "id")
    capped = with_doc.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).drop("n")
    return best(capped.drop("rank"), keep)


def rerank(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, k: int = 8) -> DataFrame:
    """The best ``k`` of each query by a model's score of (query, text), asked in Arrow batches; without a model the order stays."""
    if scorer is None:
        return best(ranked.drop("rank"), k)
    asked = ranked.join(chunks.select("id", "text"), "id").join(broadcast_if_small(queries.select("query_id", "query")), "query_id")
    return best(asked.select("query_id", "id", F.pandas_udf(scorer, "double")("query", "text").alias("score")), k)


def embed(texts: DataFrame, size: int = 1024) -> DataFrame:
    """``texts`` with a vector of unit length: trigrams hashed into ``size`` places, by built-in functions. A text without trigrams has a null vector."""
    places = F.transform(T.trigrams(F.col("text")), lambda t: F.pmod(F.xxhash64(t), F.lit(size)).cast("int"))
    counted = texts.withColumn("places", F.array_sort(places)).withColumn("counts", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter("places", lambda p: p == k)).cast("float")))
    length = F.sqrt(F.aggregate("counts", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))
    return counted.withColumn("embedding", F.when(F.size("places") > 0, F.transform("counts", lambda x: (x / length).cast("float")))).drop("places", "counts")


def hybrid_retrieve(chunks: DataFrame, queries: DataFrame, top: int = 8, fetch: int = 50, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Lexical, dense and trigram lists fused (1, 1, 0.5), entity bonus added, capped per document, reranked: the best ``top`` of each query.

    The dense list is made where chunks and queries have an ``embedding``;
    trigrams are only asked for queries that need them.
    """
    gated = queries.where(T.needs_trigrams(F.col("query")))
    lists, weights = [best(lexical_search(chunks, queries), fetch)], [1.0]
    if "embedding" in chunks.columns and "embedding" in queries.columns:
        lists.append(dense_search(chunks.select("id", "embedding"), queries.select("query_id", "embedding"), fetch))
        weights.append(1.0)
    lists.append(best(trigram_search(chunks, gated), fetch))
    weights.append(0.5)
    fused = fuse(lists, weights).join(entity_bonus(chunks, queries), ["query_id", "id"], "left")
    scored = fused.select("query_id", "id", F.round(F.col("score") + F.coalesce("bonus", F.lit(0.0)), 9).alias("score"))
    return rerank(cap_per_document(scored, chunks, keep=fetch), chunks, queries, scorer, top)
