"""Searches, validation and upkeep on small tables; lines by running mean against a plain fold."""

from __future__ import annotations

import json
import os
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirework.operators import nested, search, upkeep, validation
from quirework.plans.storage import shared_folder

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def test_all_terms_of_a_long_query_count(spark):
    chunks = spark.createDataFrame([("all", "d", " ".join(WORDS)), ("six", "d", " ".join(WORDS[:6])), ("apart", "d", " x ".join(WORDS)), ("none", "d", None), ("empty", "d", "")], "id string, doc string, text string")
    queries = spark.createDataFrame([("eight", " ".join(WORDS)), ("blank", " ,"), ("null", None)], "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in search.lexical_search(chunks, queries).collect()}
    assert got == {("eight", "all"): 0.1, ("eight", "apart"): 0.0125}


def test_gates_and_filters(spark):
    chunks = spark.createDataFrame([("a", "d1", "x"), ("b", "d2", "x"), ("c", None, "x")], "id string, doc string, text string")
    documents = spark.createDataFrame([("d1", "ready"), ("d2", "failed")], "document_id string, status string")
    assert [r.id for r in search.ready_only(chunks, documents).collect()] == ["a"]
    assert search.in_documents(chunks, None).count() == 3 and search.in_documents(chunks, []).count() == 0
    assert [r.id for r in search.in_documents(chunks, ["d2"]).collect()] == ["b"]
    assert [r.id for r in search.in_documents(chunks, documents.where("status = 'ready'")).collect()] == ["a"]


def test_rerank_and_embed(spark):
    chunks = spark.createDataFrame([("a", "d", "long text"), ("b", "d", "x"), ("c", "d", "")], "id string, doc string, text string")
    queries = spark.createDataFrame([("q", "text")], "query_id string, query string")
    ranked = spark.createDataFrame([("q", "b", 2.0), ("q", "a", 1.0)], "query_id string, id string, score double")
    assert [r.id for r in search.rerank(ranked, chunks, queries).orderBy("rank").collect()] == ["b", "a"]

    def by_length(query: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype(float)

    assert [r.id for r in search.rerank(ranked, chunks, queries, by_length).orderBy("rank").collect()] == ["a", "b"]
    got = {r.id: r.embedding for r in search.embed(chunks, 64).collect()}
    assert got["c"] is None and len(got["a"]) == 64 and sum(x * x for x in got["a"]) == pytest.approx(1, abs=1e-5)


def test_lines_by_mean_against_a_fold(spark):
    heights = [0.1, 0.101, 0.103, 0.106, 0.11, 0.2, 0.2, 0.204]
    rows = [("d", 1, y, 0.1, f"s{k}") for k, y in enumerate(heights)] + [("d", 2, 0.5, 0.1, "t")]
    spans = spark.createDataFrame(rows, "doc string, page int, y0 double, x0 double, span_id string")
    for tolerance in (0.0, 0.002, 0.004, 0.02):
        lines: list[list[float]] = []
        for y in sorted(heights):
            if lines and abs(y - sum(lines[-1]) / len(lines[-1])) <= tolerance:
                lines[-1].append(y)
            else:
                lines.append([y])
        got = [r.n for r in upkeep.lines_by_mean(spans, tolerance).where("page = 1").orderBy("line").collect()]
        assert got == list(map(len, lines))
    assert upkeep.lines_by_mean(spans.limit(0), 0.1).count() == 0


def test_page_numbers_headers_and_labels(spark):
    rows = spark.createDataFrame([("a", "1-3, 7,2"), ("b", "x,5-4"), ("c", None), ("d", "9 - 10")], "id string, pages string")
    got = [(r.id, r.page) for r in upkeep.page_numbers(rows, F.col("pages")).orderBy("id", "page").collect()]
    assert got == [("a", 1), ("a", 2), ("a", 3), ("a", 7), ("d", 9), ("d", 10)]
    frame = spark.createDataFrame([("17",), ("-3",), ("x",), (None,)], "header string")
    assert [r[0] for r in frame.select(upkeep.resume_after(F.col("header"))).collect()] == [17, 0, 0, 0]
    labels = spark.createDataFrame([("Section-header",), ("Table",), ("ListItem",), ("Figure",), (None,)], "label string")
    assert [r[0] for r in labels.select(upkeep.block_type(F.col("label"))).collect()] == ["header", "table", "list", "figure", "paragraph"]


def test_log_and_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "n int, t string")
    for _ in range(2):
        upkeep.append_log(rows, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    upkeep.write_report(rows, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().n == 1


def test_claims_follow_their_tags(spark):
    chunk = "018ce500-0025-7500-9de8-000000019547"
    tag = f"[chunk:{chunk}]"
    texts = {"inside": f"One. Two {tag} three. Four!", "after": f"One. {tag}", "none": " whole. text ", "marks": f"a {tag} ...", "empty": "", "null": None}
    sections = spark.createDataFrame([(k, "d", t) for k, t in texts.items()], "section_id string, draft_id string, ai_text string")
    claims = validation.claims_by_tag(sections)
    got: dict = {}
    for r in claims.orderBy("section_id", "claim_no").collect():
        got.setdefault(r.section_id, []).append((r.claim, r.chunk_id))
    assert got == {"inside": [("Two", chunk), ("three.", None), ("Four!", None)], "after": [("", chunk)], "none": [("whole. text", None)], "marks": [("a", chunk)]}
    known = spark.createDataFrame([("d", chunk)], "draft_id string, chunk_id string")
    judged = validation.claim_verdicts(claims, known, F.when(F.col("claim") == "Two", "contradicted"))
    status = {(r.section_id, r.claim_no): r.status for r in judged.collect()}
    assert status["inside", 0] == "contradicted" and status["inside", 1] == "unsupported" and status["after", 0] == "unsupported"
    assert {r.section_id: r.status for r in validation.gravest(judged).collect()}["inside"] == "contradicted"
    bare = {r.section_id: r.text for r in validation.without_dangling(sections, known.limit(0)).collect()}
    assert bare["inside"] == "One. Two  three. Four!" and "null" not in bare


def test_budget_against_a_loop(spark):
    from quirework.plans import stream_queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    events = spark.read.parquet(f"{folder}/events.parquet").toPandas().drop_duplicates("event_id").sort_values(["ts", "event_id"])
    expected, held = {}, {}
    for event, user, ts, value in zip(events.event_id, events.user_id, events.ts, events.value):
        own = [(t, v) for t, v in held.get(user, []) if t >= ts - pd.Timedelta(hours=1)]
        expected[event] = sum(v for _, v in own) + round(value * 1e6) <= 100e6
        held[user] = own + [(ts, round(value * 1e6))] * expected[event]
    got = {r.event_id: r.admitted for r in stream_queries.stream_budget(spark, folder).collect()}
    assert got == expected and 0 < sum(got.values())


def test_json_in_many_layers():
    text = json.dumps({"fields": {}})
    for _ in range(10):
        text = json.dumps(text)
    assert nested.parse_output(text) == {"fields": {}}
    assert nested.parse_output('"cut') is None and nested.parse_output('"3"') is None


def test_shared_folder_without_the_setting():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="local[2]", applicationId="here"))
    folder = shared_folder(session)
    assert folder and folder == shared_folder(session)
    session.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_folder(session)
