from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quirework.operators import layout, mining
from quirework.operators import recognition as R


def test_parsed_lines_clamp_and_drop(spark):
    body = '{"lines": [{"text": "a", "bbox": [-1, 0.1, 2, 0.2]}, {"text": " ", "bbox": [0, 0, 1, 1]}, {"text": "b", "bbox": [0.5, 0, 0.5, 1]}, {"text": "c", "bbox": [0, 1]}, {"text": "d", "bbox": ["x", 0, 1, 1]}]}'
    quoted = '"' + body.replace('"', '\\"') + '"'
    rows = spark.createDataFrame([("p", body), ("q", quoted), ("r", "cut {"), ("s", None)], "page_id string, response string")
    got = {(r.page_id, r.text, r.x0, r.x1) for r in R.parsed_lines(rows).collect()}
    assert got == {("p", "a", 0.0, 1.0), ("q", "a", 0.0, 1.0)}


def test_polygon_box(spark):
    rows = spark.createDataFrame([([[10.0, 20.0], [250.0, 20.0], [50.0, 40.0]], 200.0, 100.0)], "p array<array<double>>, w double, h double")
    assert tuple(rows.select(R.polygon_box(F.col("p"), F.col("w"), F.col("h")).alias("b")).first().b) == (0.05, 0.2, 1.0, 0.4)


def test_page_classes_in_order(spark):
    rows = spark.createDataFrame([(60, 10.0, 0.9, 9.0, 0.9), (0, 10.0, 0.9, 0.0, 0.0), (0, 99.0, 0.9, 9.0, 0.0), (0, 99.0, 0.1, -4.0, 0.0), (0, 99.0, 0.1, 0.0, 0.1)], "layer_chars int, sharpness double, strokes double, skew double, speckle double")
    assert [r.page_class for r in R.page_classes(rows).collect()] == ["native", "blurry", "handwriting", "degraded", "clean"]


def test_routes_keep_to_the_cap(spark):
    rows = [(f"p{i:02}", "d", i, None, 0, 0.1, 100 if i else 10) for i in range(23)] + [("n", "d", 30, None, 80, None, 80), ("k", "d", 31, None, 0, 0.9, 80), ("o", "d", 32, "vlm", 0, 0.1, 80)]
    got = {r.page_id: r.route for r in R.page_routes(spark.createDataFrame(rows, "page_id string, document_id string, page_num int, override string, layer_chars int, confidence double, chars int")).collect()}
    assert (got["p00"], got["p01"], got["p19"], got["p20"], got["n"], got["k"], got["o"]) == ("describe", "transcribe", "transcribe", "visual_budget_exceeded", "text_layer", "keep", "vlm")


def test_grounding(spark):
    values = spark.createDataFrame([("a", 1, "Acme  Corp"), ("b", 1, "big red door handle"), ("c", 1, "nothing there"), ("d", 2, "x"), ("e", 1, "  ")], "value_id string, k int, value string")
    texts = spark.createDataFrame([(1, "The acme corp sold a red big door."), (1, "unrelated"), (1, None)], "k int, text string")
    assert {r.value_id: r.grounded for r in mining.grounded_values(values, texts, "k").collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}


def test_word_changes_rebuild_the_text(spark):
    rows = spark.createDataFrame([("p", "one two three", "one 2 three four"), ("q", None, "new"), ("r", "same", "same")], "pair_id string, old_text string, new_text string")
    got = {(r.pair_id, r.op, r.old, r.new) for r in mining.word_changes(rows).collect()}
    assert got == {("p", "replace", "two", "2"), ("p", "insert", "", " four"), ("q", "insert", "", "new")}


@pytest.mark.parametrize(("most", "text", "cut"), [(4, "One two. Three four. Five six. Seven.", "One two. Three four."), (1, "One two three. Four.", "One two three."), (5, "One two three four five six. End.", "One two three four five six. End."), (None, "a b c", "a b c")])
def test_cut_texts(spark, most, text, cut):
    assert mining.cut_texts(spark.createDataFrame([("k", text, most)], "key string, text string, most int")).first().text == cut


def test_rule_answers_and_new_rules(spark):
    rows = [("a", '{"rule": "Use dates", "evidence": ["1", "2"]}', 2), ("b", '{"rule": "NO_RULE", "evidence": ["1", "2"]}', 1), ("c", '{"rule": "x", "evidence": ["1"]}', 2), ("d", "cut {", 1), ("e", None, 1)]
    assert [r.rule for r in mining.rule_answers(spark.createDataFrame(rows, "group_id string, answer string, min_evidence int")).collect()] == ["Use dates"]
    found = spark.createDataFrame([("t", " Use Dates"), ("t", "use dates"), ("t", "new"), ("u", "new")], "template_id string, rule string")
    known = spark.createDataFrame([("t", "USE DATES ")], "template_id string, rule string")
    assert {tuple(r) for r in mining.new_rules(found, known).collect()} == {("t", "new"), ("u", "new")}


def spans(spark, *rows):
    return spark.createDataFrame([(i, "d", 1, t, x0, y0, x1, y1, c, s) for i, t, x0, y0, x1, y1, c, s in rows], "span_id string, document_id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, source string")


def test_blocks_follow_gaps_and_orphans_join(spark):
    rows = [("a", "First line", 0.1, 0.10, 0.9, 0.12, 0.8, "x"), ("b", "second line", 0.1, 0.13, 0.9, 0.15, None, "y"), ("c", "alone", 0.1, 0.30, 0.2, 0.32, 0.6, "y"), ("d", "New block here", 0.1, 0.50, 0.9, 0.52, 0.7, None)]
    frame = spans(spark, *rows, rows[0])
    blocks = layout.gap_blocks(frame).orderBy("block").collect()
    assert [(b.text, b.n_lines) for b in blocks] == [("First line second line", 2), ("alone", 1), ("New block here", 1)]
    merged = layout.orphans_merged(layout.gap_blocks(frame)).orderBy("reading_order").collect()
    assert [(m.reading_order, m.text) for m in merged] == [(0, "First line second line alone"), (1, "New block here")]
    assert layout.page_texts(frame).first().text == "First line second line alone New block here"
    assert layout.page_confidence(frame).first().mean_confidence == pytest.approx(0.7)
    assert {r.source for r in layout.dominant_sources(frame).collect()} == {"y"}
    assert {r.span_id: r.block for r in layout.contained_spans(frame, layout.gap_blocks(frame)).collect()} == {"a": 1, "b": 1, "c": 2, "d": 3}


def test_columns_split(spark):
    rows = [(f"l{i}", "t", 0.05, i / 20, 0.4, i / 20 + 0.01, None, "x") for i in range(6)] + [(f"r{i}", "t", 0.55, i / 20, 0.95, i / 20 + 0.01, None, "x") for i in range(6)]
    assert layout.column_splits(spans(spark, *rows)).first().split == pytest.approx((0.225 + 0.75) / 2)
    assert layout.column_splits(spans(spark, *rows[:9])).count() == 0
