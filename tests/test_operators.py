"""Small cases worked out by hand, and plans."""

from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.functions import vector as V
from quirework.operators import catalogs, chunking, drafting, events, search
from quirework.sources import files
from quirework.streaming import streams


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_token_count_and_terms(spark):
    row = spark.createDataFrame([("a b  c-d",)], "t string").select(T.token_count(F.col("t")).alias("n"), T.terms(F.col("t")).alias("w")).first()
    assert (row.n, row.w) == (3, ["a", "b", "c", "d"])


def test_entities(spark):
    text = "Under 42 U.S.C. § 1983, Brown v. Board owes $75,000 since January 15, 2026. The Harvey Specter firm"
    found = spark.createDataFrame([(text,)], "t string").select(T.entities(F.col("t")).alias("e")).first().e
    assert found == ["42 U.S.C. § 1983", "Brown v. Board", "Harvey Specter", "$75,000", "January 15, 2026"]


def test_cosine_of_zero_and_null(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0])], "a array<float>, b array<float>")
    assert [r[0] for r in rows.select(V.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def chunks(spark, *texts):
    return spark.createDataFrame([(i, "d", t) for i, t in enumerate(texts)], "id int, doc string, text string")


def asked(spark, *queries):
    return spark.createDataFrame([(f"q{i}", q) for i, q in enumerate(queries)], "query_id string, query string")


def test_cover_density_by_hand(spark):
    # covers of "habeas corpus" in "habeas x corpus habeas": (0, 2) with one other word and (2, 3) with none
    scores = {r.id: r.score for r in search.lexical_search(chunks(spark, "habeas x corpus habeas", "habeas only", None, ""), asked(spark, "Habeas corpus", " ", None)).collect()}
    assert scores == {0: pytest.approx(0.1 / 2 + 0.1)}


def test_trigram_similarity_is_a_jaccard(spark):
    row = search.trigram_search(chunks(spark, "word", "unrelated"), asked(spark, "words")).first()
    assert (row.id, row.score) == (0, pytest.approx(4 / 7))


def test_fusion_and_cap(spark):
    ranked = lambda *ids: spark.createDataFrame([("q", i, k + 1) for k, i in enumerate(ids)], "query_id string, id int, rank int")
    fused = {r.id: r.score for r in search.fuse([ranked(0, 1, 2), ranked(1, 0, 3)]).collect()}
    assert fused[0] == fused[1] == pytest.approx(1 / 61 + 1 / 62)
    three = {r.id: r.score for r in search.fuse([ranked(0), ranked(0), ranked(0)]).collect()}
    assert three[0] == pytest.approx(2.5 / 61)
    many = spark.createDataFrame([("q", i, 1.0 - i / 10) for i in range(5)], "query_id string, id int, score double")
    assert [r.id for r in search.cap_per_document(many, chunks(spark, *"abcde")).orderBy("rank").collect()] == [0, 1, 2]


def test_vector_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)] + [(9, None), (8, [0.0, 0.0])], "id int, embedding array<float>")
    asked = rows.withColumnRenamed("id", "query_id")
    whole = {tuple(r) for r in search.dense_search(rows, asked, 2).collect()}
    monkeypatch.setattr(search, "QUERIES_AT_ONCE", 2)
    assert {tuple(r) for r in search.dense_search(rows, asked, 2).collect()} == whole and len(whole) == 12


def test_rankings_limit_groups_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(search.best(spark.createDataFrame([("q", 1, 1.0)], "query_id string, id int, score double"), 3))


def test_open_jobs_are_an_anti_join(spark):
    now = F.lit(dt.datetime(2024, 1, 1, 1))
    docs = spark.createDataFrame([("a", "ocr_running", dt.datetime(2024, 1, 1)), ("b", "ready", dt.datetime(2023, 1, 1)), ("c", "ocr_done", dt.datetime(2024, 1, 1, 0, 55))], "document_id string, status string, updated_at timestamp")
    jobs = spark.createDataFrame([], "document_id string")
    result = catalogs.stuck_jobs(docs, jobs, now)
    assert [tuple(r) for r in result.collect()] == [("a", "ocr")]
    assert "LeftAnti" in plan(result)


def test_rolling_hour_keeps_the_boundary(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 1, t, 0.5), (2, 1, t + dt.timedelta(hours=1), 0.25), (3, 1, t + dt.timedelta(hours=1, microseconds=1), 0.125)], "event_id int, user_id int, ts timestamp, value double")
    assert {r.event_id: r.spent for r in events.rolling_spend(rows, "user_id", "value").collect()} == {1: 0.5, 2: 0.75, 3: 0.375}


def test_latest_takes_null_as_earliest(spark):
    rows = spark.createDataFrame([("a", None, "x"), ("a", 1, "y"), ("b", None, "z")], "k string, o int, v string")
    assert {tuple(r) for r in events.latest(rows, ["k"], F.col("o"), "v").collect()} == {("a", "y"), ("b", "z")}


def test_first_with_key_keeps_rows_without_one(spark):
    rows = spark.createDataFrame([("k", 1), ("k", 2), (None, 3), (None, 4)], "k string, i int")
    assert sorted(r.i for r in events.first_with_key(rows, "k", "i").collect()) == [1, 3, 4]


def test_status_merge(spark):
    rows = spark.createDataFrame([("a", "supported"), ("a", "contradicted"), ("b", None), ("c", "partial")], "claim_id string, status string")
    assert {tuple(r) for r in drafting.merged_status(rows).collect()} == {("a", "contradicted"), ("b", "unsupported"), ("c", "partial")}


def test_claims(spark):
    tag = "[chunk:018ce500-3883-7500-97fb-000001877d61]"
    rows = spark.createDataFrame([("s", f"First. Second {tag}. Third! {tag}"), ("t", None), ("u", "")], "section_id string, ai_text string")
    found = [(r.claim, len(r.chunk_ids)) for r in drafting.claims(rows).orderBy("section_id", "claim_no").collect()]
    assert found == [("First.", 0), ("Second.", 1), ("Third!", 1)]


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(1, 30), max_size=20), st.integers(5, 40), st.integers(0, 60))
def test_packing_ends_and_keeps_every_sentence(sizes, most, overlap):
    text = " ".join(f"S{i}{' w' * (n - 1)}." for i, n in enumerate(sizes))
    pieces = chunking.packed(text, most, overlap)
    for i in range(len(sizes)):
        assert any(f"S{i} " in p or f"S{i}." in p for p in pieces)
    # tokens are counted by sentence
    assert all(sum(map(chunking.tokens, p.split(". "))) <= most or p.count(".") == 1 for p in pieces if sizes)


def test_heading_path():
    path = chunking.heading_path([], "One two")
    path = chunking.heading_path(path, "a b c d e f")
    assert path == ["One two", "a b c d e f"]
    assert chunking.heading_path(path, "a b c d e f g h i j k") == [*path, "a b c d e f g h i j k"]
    assert chunking.heading_path(path, "New") == ["New"]


def test_chunks_of_blocks(spark):
    rows = [("d", 0, "header", "Title here"), ("d", 1, "figure", "xx"), ("d", 2, "list", "\n".join("abcdefghijklmnopqrstuvwxy")), ("d", 3, "other", "text"), ("e", 0, "paragraph", None)]
    got = chunking.chunk_blocks(spark.createDataFrame(rows, "doc string, reading_order int, block_type string, text string")).orderBy("chunk_no").collect()
    assert [(c.chunk_type, c.section_path, c.char_start) for c in got] == [("header_region", ["Title here"], 0), ("list", ["Title here"], 12), ("list", ["Title here"], 31), ("list", ["Title here"], 50), ("paragraph", ["Title here"], 59)]


def test_upsert(spark):
    known = spark.createDataFrame([("a", "failed"), ("b", "ready")], "sha256 string, status string")
    got = {tuple(r) for r in catalogs.upserted(known, spark.createDataFrame([("a",), ("c",), ("c",)], "sha256 string")).collect()}
    assert got == {("a", "uploaded", False, True), ("b", "ready", False, False), ("c", "uploaded", True, False)}


def test_uploads_and_blobs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.txt", b"%PDF-1.7 x"), ("b.txt", b"plain"), ("c.txt", b"bin\x00ary"), ("d.png", b"\x89PNG\r\n\x1a\n"), ("e.md", b""), ("f.webp", b"RIFF0000WEBP")):
        (tmp_path / "in" / name).write_bytes(content)
    uploads = files.read_uploads(spark, str(tmp_path / "in"))
    assert {r.path.rsplit("/", 1)[1]: r.mime_type for r in uploads.collect()} == {"a.txt": "application/pdf", "b.txt": "text/plain", "c.txt": None, "d.png": "image/png", "f.webp": "image/webp"}
    files.write_blobs(uploads, str(tmp_path / "blobs"))
    assert spark.read.parquet(str(tmp_path / "blobs")).count() == 5


def test_text_spans(spark):
    rows = files.text_spans(spark.createDataFrame([(1, "a\n\n \n\nb"), (2, None), (3, "one")], "id int, text string")).orderBy("id", "place").collect()
    assert [(r.id, r.text, r.y0, round(r.y1, 3)) for r in rows] == [(1, "a", 0.0, 0.4), (1, "b", 0.5, 0.9), (3, "one", 0.0, 1.0)]


def test_new_template_versions(spark):
    known = spark.createDataFrame([("t", 1, "x"), ("t", 2, "y")], "template_id string, version int, fingerprint string")
    loaded = spark.createDataFrame([("t", "y"), ("t", "z"), ("u", "a")], "template_id string, fingerprint string")
    assert {tuple(r) for r in files.new_template_versions(known, loaded).select("template_id", "fingerprint", "version").collect()} == {("t", "z", 3), ("u", "a", 1)}


def test_budget_stream_against_a_loop(spark):
    folder = "/root/testdata/sf0.001"
    admitted = {r.event_id: r.admitted for r in streams.finished(streams.admitted_spend(streams.event_stream(spark, folder), 60.0, 86400)).collect()}
    rows = sorted(spark.read.parquet(f"{folder}/events.parquet").collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    spent: dict[int, list] = {}
    for r in rows:
        own = spent[r.user_id] = [(t, v) for t, v in spent.get(r.user_id, []) if (r.ts - t).total_seconds() <= 86400]
        fits = sum(v for _, v in own) + r.value <= 60.0
        if fits:
            own.append((r.ts, r.value))
        assert admitted[r.event_id] == fits
    assert len(admitted) == len(rows)
