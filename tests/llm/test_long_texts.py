"""Very long texts go through every text operator whole."""

from __future__ import annotations

import numpy as np
import pytest

from quirework.llm import encode_corpus, leaked_items, near_duplicates, personal_data, scan_repair, shared_spans, split_pieces, stuffed_pages

WORDS = [f"word{i}" for i in np.random.default_rng(0).integers(0, 50_000, size=60_000)]
LONG = " ".join(w + "." * (i % 19 == 18) for i, w in enumerate(WORDS))


def pages(spark, *rows):
    return spark.createDataFrame([(i, "t", "s", x) for i, x in rows], "extraction_id string, template_id string, section_name string, full_text string")


def test_split(spark):
    specs = spark.createDataFrame([("t", 1, "s", 200, None)], "template_id string, template_version int, name string, target_length_max int, created_at timestamp")
    rows = split_pieces.split_oversized(pages(spark, ("a", LONG)), specs).select("start_word", "end_word").orderBy("piece_no").collect()
    assert rows[0].start_word == 0 and rows[-1].end_word == len(WORDS) and all(r.end_word - r.start_word <= 200 for r in rows)


def test_near_duplicates_and_shared_spans(spark):
    other = " ".join(LONG.split()[100:])
    frame = pages(spark, ("a", LONG), ("b", other))
    assert [tuple(r) for r in near_duplicates.found(frame).collect()] == [("a", "b")]
    sections = spark.createDataFrame([], "section_id string, ai_text string")
    assert {r.row_id: r.shared_words for r in shared_spans.found(frame, sections).collect()} == {"a": len(WORDS) - 100, "b": len(WORDS) - 100}


def test_encoding_leaks_and_labels(spark):
    documents = spark.createDataFrame([(1, LONG)], "doc_id bigint, text string")
    ids = encode_corpus.encode_corpus(documents).first().ids
    twice = spark.createDataFrame([(1, LONG), (2, LONG), (1, LONG), (3, "")], "doc_id bigint, text string").repartition(3)
    assert sorted((r.doc_id, len(r.ids)) for r in encode_corpus.encode_corpus(twice).collect()) == [(1, len(ids)), (1, len(ids)), (2, len(ids)), (3, 0)]
    assert list(ids) == encode_corpus.encoder(open(encode_corpus.VOCABULARY, "rb").read()).encode_ordinary(LONG)
    items = spark.createDataFrame([(7, " ".join(WORDS[50_000:50_020]))], "item_id bigint, text string")
    assert leaked_items.leaked_passages(documents, items).first().doc_word == 50_000
    assert stuffed_pages.page_shares(documents).first().n_words == len(WORDS)


@pytest.mark.parametrize("copies", [1, 3])
def test_personal_data_in_one_line(spark, copies):
    line = "Signed by Wanda Huxberg for Marby Title LLC on 3 May 2020. "
    spans = spark.createDataFrame([(f"s{k}", "d", line * 2000, 1, 0.0, 0.0, 1.0, 1.0, "vlm") for k in range(copies)], "span_id string, document_id string, text string, page_number int, x0 double, y0 double, x1 double, y1 double, source string")
    sections = spark.createDataFrame([], "section_id string, draft_id string, final_text string")
    found = personal_data.find_personal_data(spans, sections).where("pii_type = 'name'")
    assert found.count() >= 1990 * copies
    assert scan_repair.found(spans).count() == 0
