from __future__ import annotations

import json
import tempfile

from quirework.operators import nested

SCHEMA = "draft_id string, ai_output string, final_output string, created_at timestamp, edited_at timestamp, payload string, tag int"


def drafts(spark, *rows):
    return spark.createDataFrame([(d, a, f, None, e, "clash", 1) for d, a, f, e in rows], SCHEMA)


def found(frame):
    return {tuple(r) for r in nested.found(frame, tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/tables").collect()}


def test_all_kinds_and_places(spark):
    ai = {
        "fields": {
            "parties": {"value": [None, {"name": "A"}, {"name": "B", "role": "x"}], "supporting_chunk_ids": "c1"},
            "claims": {"value": ["p", None, ""], "supporting_chunk_ids": [None, "c2", "c3"]},
            "date": {"value": "today", "supporting_chunk_ids": None},
            "single": {"value": {"name": "C"}},
        },
        "sections_text": {"facts": None},
        "validators": [{"field_or_section": "date", "validator_id": "is_date"}, None, {"field_or_section": None}],
    }
    final = {"fields": [{"name": "parties", "value": {"name": "A"}}], "sections": [{"name": "facts", "text": "t"}, {"text": "no name"}]}
    assert found(drafts(spark, ("d", json.dumps(ai), json.dumps(json.dumps(final)), None))) == {
        ("d", "ai", "field", "parties", 0), ("d", "ai", "field", "claims", 0), ("d", "ai", "field", "date", 0), ("d", "ai", "field", "single", 0),
        ("d", "ai", "party", "parties", 1), ("d", "ai", "party", "parties", 2), ("d", "ai", "party", "single", 0),
        ("d", "ai", "item", "claims", 0), ("d", "ai", "item", "claims", 2),
        ("d", "ai", "chunk", "parties", 0), ("d", "ai", "chunk", "claims", 1), ("d", "ai", "chunk", "claims", 2),
        ("d", "ai", "section", "facts", 0), ("d", "ai", "validator", "date", 0), ("d", "ai", "validator", None, 2),
        ("d", "final", "field", "parties", 0), ("d", "final", "party", "parties", 0), ("d", "final", "section", "facts", 0),
    }


def test_newest_row_counts_and_bad_outputs_give_nothing(spark):
    import datetime as dt

    good = lambda name: json.dumps({"fields": {name: 1}})
    early, late = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    frame = drafts(
        spark, ("d", good("old"), None, None), ("d", good("new"), None, late), ("d", good("mid"), None, early), ("d", good("new"), None, late),
        ("e", '{"fields": {"x"', None, early), ("f", '{"error_code": "X", "error_message": "m"}', "null", None), ("g", "", "[1]", None), (None, good("lost"), None, None),
    )
    assert found(frame) == {("d", "ai", "field", "new", 0)}


def test_empty_table(spark):
    assert found(drafts(spark).limit(0)) == set()


def test_written_tables_keep_parents(spark, tmp_path):
    ai = json.dumps({"fields": {"p": {"value": [{"name": "A", "role": "r"}]}}})
    path = str(tmp_path / "tables")
    nested.write_tables(nested.shred(drafts(spark, ("d", ai, None, None))), path)
    party = nested.read_flat(spark, path, "party").first()
    field = nested.read_flat(spark, path, "field").first()
    output = nested.read_flat(spark, path, "output").first()
    assert (party.p_name, party.p_role, party.parent_key) == ("A", "r", field.row_key)
    assert field.parent_key == output.row_key
