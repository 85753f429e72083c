"""Queries over rows that their statements leave out."""

from __future__ import annotations

import json

from quirework.plans import draft_queries


def distance(a: str, b: str) -> int:
    """Edit distance in characters, row by row."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_changes_keeps_accents_escapes_and_nulls(spark, tmp_path):
    values = {
        "accent": ("Müller & Söhne", "Muller & Söhne GmbH"), "escape": ("São Paulo", "Sao Paulo"), "emoji": ("ok 🙂", "ok 🙃🙃"), "same": (" café", "café "),
        "plain": ("lease", "leases"), "added": (None, "né"), "removed": ("né", None), "u00": ("u00 form", "u01 form"),
    }
    rows = [(k, "field", json.dumps({"value": a}, ensure_ascii=k == "escape"), json.dumps({"value": u}, ensure_ascii=False)) for k, (a, u) in values.items()]
    rows += [("no row", "section", json.dumps({"text": "é"}), None), ("no rows", "section", None, None), ("new", "section", None, json.dumps({"text": "é"}))]
    spark.createDataFrame(rows, "edit_id string, field_type string, ai_value string, user_value string").write.parquet(f"{tmp_path}/few_shot_store.parquet")
    got = {r.edit_id: (r.kind, r.distance, r.share) for r in draft_queries.edit_changes(spark, str(tmp_path)).collect()}
    for k, (a, u) in values.items():
        if a is None or u is None:
            assert got.pop(k) == (k, None, None)
        else:
            a, u = a.strip(), u.strip()
            d = distance(a, u)
            assert got.pop(k) == ("same" if a == u else "modified", d, round(d / max(len(a), len(u)), 6))
    assert got == {"no row": ("removed", None, None), "no rows": ("same", None, None), "new": ("added", None, None)}
