"""Near-duplicates, shared spans and vectors against brute force on small tables."""

from __future__ import annotations

import numpy as np

from quirework.llm import near_duplicates, shared_spans, similar_vectors


def edited_texts(seed: int = 5, bases: int = 12) -> list[str]:
    draw = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    texts = []
    for _ in range(bases):
        base = list(draw.choice(words, size=int(draw.integers(31, 120))))
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(int(draw.integers(0, 12))):
                copy[int(draw.integers(len(copy)))] = str(draw.choice(words))
            texts.append(" ".join(copy))
    return texts


def test_near_duplicates_against_all_pairs(spark):
    texts = edited_texts()
    rows = [(f"p{i:03}", t) for i, t in enumerate(texts)]
    rows += [("copy1", texts[0]), ("copy2", texts[0].upper()), rows[3], ("null", None), ("empty", ""), ("short", " ".join(texts[1].split()[:29])), ("short2", " ".join(texts[1].split()[:29]))]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "extraction_id string, full_text string, set_key string, band int")
    sets = {}
    for key, text in dict(rows).items():
        w = (text or "").lower().split()
        if len(w) >= 30:
            sets[key] = set(zip(w, w[1:], w[2:]))
    keys = sorted(sets)
    expected = {(a, b) for k, a in enumerate(keys) for b in keys[k + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [tuple(r) for r in near_duplicates.found(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(expected) > 20
    classes = {r.extraction_id: r for r in near_duplicates.classes_with_links(frame).collect()}
    assert classes["copy1"].class_id == classes["copy2"].class_id == classes["p000"].class_id and set(classes) == set(keys)
    assert near_duplicates.found(frame.limit(0)).count() == 0


def test_bands_that_many_share_are_cut(spark):
    keys = spark.createDataFrame([(1, k) for k in range(700)] + [(2, k) for k in range(650, 800)] + [(3, 5), (3, 6)], "band bigint, set_key bigint")
    got = {tuple(r) for r in near_duplicates.candidates(keys, hot=5).collect()}
    expected = {(a, b) for a in range(700) for b in range(a + 1, 700)} | {(a, b) for a in range(650, 800) for b in range(a + 1, 800)}
    assert got == expected
    assert got == {tuple(r) for r in near_duplicates.candidates(keys, hot=10_000).collect()}


def test_pruning_keeps_pairs_at_the_threshold():
    draw = np.random.default_rng(1)
    least = near_duplicates.least_matches()
    left = draw.integers(0, 256, size=(4000, near_duplicates.VALUES), dtype=np.uint8)
    right = np.where(draw.random(left.shape) < 0.7, left, draw.integers(0, 256, size=left.shape, dtype=np.uint8))
    assert near_duplicates.survivors(left, right, least).mean() > 0.998
    far = np.where(draw.random(left.shape) < 0.3, left, draw.integers(0, 256, size=left.shape, dtype=np.uint8))
    assert near_duplicates.survivors(left, far, least).mean() < 0.001


def test_shared_spans_beyond_the_last_place(spark):
    draw = np.random.default_rng(4)
    text = lambda n: " ".join(f"w{i}" for i in draw.integers(0, 10_000, size=n))
    passage, other = text(63), text(41)
    pages = spark.createDataFrame([("a", f"{text(150)} {passage} {text(300)} {other}"), ("b", f"{passage} {text(9)} {other} {text(200)}")], "extraction_id string, full_text string")
    sections = spark.createDataFrame([], "section_id string, ai_text string")
    few = {tuple(r) for r in shared_spans.shared_spans(pages, sections, most=100).collect()}
    assert few == {tuple(r) for r in shared_spans.shared_spans(pages, sections).collect()} and len(few) == 4


def test_shared_spans_against_all_windows(spark):
    draw = np.random.default_rng(3)
    text = lambda n: [f"w{i}" for i in draw.integers(0, 10_000, size=n)]
    passage, stock = text(63), text(40)
    pages = [("a", text(30) + passage + text(11)), ("b", passage[:50] + text(90)), ("c", text(200)), ("d", stock), ("e", text(7) + stock + text(40) + stock), ("f", passage[:39] + text(9)), ("twice", (own := text(45)) + ["x"] + own)]
    sections = [("s", stock + text(5)), ("t", text(3) + passage[20:63]), ("long", text(3000) + passage + text(2000))]
    records = {("page_extractions", k): w for k, w in pages} | {("draft_sections", k): w for k, w in sections}
    where: dict[tuple, set] = {}
    for key, w in records.items():
        for i in range(len(w) - 39):
            where.setdefault(tuple(w[i : i + 40]), set()).add(key)
    expected = {}
    for key, w in records.items():
        hit = {i + d for i in range(len(w) - 39) if len(where[tuple(w[i : i + 40])]) > 1 for d in range(40)}
        if hit:
            expected[key] = len(hit)
    p = spark.createDataFrame([(k, " \n".join(w), 1, "c") for k, w in pages + pages[:1]] + [("null", None, 1, "c"), ("empty", "", 1, "c")], "extraction_id string, full_text string, rec int, text string")
    s = spark.createDataFrame([(k, " ".join(w), 1) for k, w in sections + sections[:1]] + [("null", None, 1)], "section_id string, ai_text string, pos int")
    assert {(r.src, r.row_id): r.shared_words for r in shared_spans.found(p, s).collect()} == expected
    spans = {(r.start_word, r.end_word) for r in shared_spans.shared_spans(p, s).where("row_id = 'a'").collect()}
    assert spans == {(30, 93)}
    assert shared_spans.found(p.limit(0), s.limit(0)).count() == 0


def vectors(n: int, seed: int = 2) -> np.ndarray:
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(n // 12 + 1, 1024))
    return (centers[draw.integers(len(centers), size=n)] + 0.6 * draw.normal(size=(n, 1024))).astype(np.float32) * draw.uniform(0.5, 4, size=(n, 1)).astype(np.float32)


def store(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 1) for i, v in rows], "edit_id string, embedding array<float>, vector string, curve int")


def test_neighbours_recall(spark):
    x = vectors(3000)
    ids = [f"{i:05}" for i in range(len(x))]
    got = {}
    for r in similar_vectors.nearest_vectors(store(spark, [(i, v.tolist()) for i, v in zip(ids, x)])).collect():
        got.setdefault(r.edit_id, set()).add(r.other_id)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    best = np.argsort(-scores, axis=1)[:, :5]
    hits = sum(len(got[i] & {ids[j] for j in best[k]}) for k, i in enumerate(ids))
    assert all(len(v) == 5 for v in got.values()) and hits / (5 * len(ids)) >= 0.95


def test_unusable_repeated_and_equal_vectors(spark):
    x = vectors(40, seed=4)
    same = [(f"same{i:02}", x[0].tolist()) for i in range(20)]
    rest = [(f"v{i:02}", v.tolist()) for i, v in enumerate(x[1:])]
    bad = [("null", None), ("zero", [0.0] * 1024), ("short", [1.0] * 512), ("nan", [float("nan")] + [1.0] * 1023)]
    got: dict[str, list] = {}
    for r in similar_vectors.nearest_vectors(store(spark, same + rest + rest[:3] + bad)).orderBy("edit_id", "rank").collect():
        got.setdefault(r.edit_id, []).append(r.other_id)
    assert set(got) == {i for i, _ in same + rest}
    assert got["same00"] == [f"same{i:02}" for i in range(1, 6)]
    assert got["same19"] == got["same07"] == [f"same{i:02}" for i in range(5)]
    assert all(len(v) == 5 and len(set(v)) == 5 and k not in v for k, v in got.items())
    pairs = [tuple(r) for r in similar_vectors.found(store(spark, same + rest + bad)).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_no_vectors(spark):
    assert similar_vectors.found(store(spark, [("null", None)])).count() == 0
    assert similar_vectors.found(store(spark, [("one", [1.0] * 1024)])).count() == 0


def test_hilbert_places_are_neighbours():
    side = 8
    cells = np.array([(a, b) for a in range(side) for b in range(side)])
    order = cells[np.argsort(similar_vectors.hilbert_places(cells, 3))]
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_windows_reach_over_borders():
    curve = similar_vectors.Curve(np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    places = np.random.default_rng(5).integers(0, 1 << 63, size=1500, dtype=np.uint64)
    keys = similar_vectors._keys(places, [f"id{i}" for i in range(1500)])
    curve.cut(keys, 10, 40)
    order = np.argsort(keys)
    seen, own = {part: set() for part in range(10)}, {}
    for at, parts, mine in curve.parts(keys):
        for row, part in zip(at.tolist(), parts.tolist()):
            seen[part].add(row)
            if mine:
                own[row] = part
    assert len(own) == 1500
    for n, row in enumerate(order.tolist()):
        assert set(order[max(0, n - 40) : n + 41].tolist()) <= seen[own[row]]


def test_many_partitions_lose_no_neighbours(spark, monkeypatch):
    x = vectors(1500, seed=5)
    rows = store(spark, [(f"{i:05}", v.tolist()) for i, v in enumerate(x)])
    pairs = lambda: {tuple(r) for r in similar_vectors.nearest_vectors(rows, window=40).select("edit_id", "other_id").collect()}
    whole = pairs()
    monkeypatch.setattr(similar_vectors, "ROWS_PER_TASK", 160)
    cut = pairs()
    assert len(whole) == len(cut) == 5 * len(x) and len(whole & cut) > 0.9 * len(whole)


def test_neighbours_that_the_curves_tear_apart_are_found(spark, monkeypatch):
    """Small groups, and windows of a 250th of the vectors."""
    monkeypatch.setattr(similar_vectors, "SCORES", 1)  # few rows share a window
    draw = np.random.default_rng(8)
    low = np.linalg.qr(draw.normal(size=(1024, 200)))[0].T
    centres = draw.normal(size=(300, 200))
    centres *= 8 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres @ low, 10, axis=0) + draw.normal(size=(3000, 1024)) * draw.uniform(0.2, 0.28, size=(3000, 1))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    true = {(f"{i:05}", f"{j:05}") for i, row in enumerate(np.argsort(-scores, axis=1)[:, :5]) for j in row}
    rows = store(spark, [(f"{i:05}", x[i].tolist()) for i in draw.permutation(3000)])
    got = {tuple(r) for r in similar_vectors.nearest_vectors(rows, window=12).select("edit_id", "other_id").collect()}
    assert len(got) == 15_000 and len(got & true) >= 0.995 * len(true)  # 0.989 by the curves alone


def test_largest_of_many_columns():
    values = np.random.default_rng(9).normal(size=(7, 3001)).astype(np.float32)
    values[:, 2995:] += 9
    expected = np.sort(np.argsort(-values, axis=1)[:, :32], axis=1)
    assert (np.sort(similar_vectors._largest(values, 32), axis=1) == expected).all()


def test_a_cell_that_many_share_is_cut():
    curve = similar_vectors.Curve(np.zeros((1, 1), np.float32), np.zeros(1, np.float32))
    draw = np.random.default_rng(6)
    ids = [f"id{i}" for i in range(5000)]
    places = np.where(np.arange(5000) % 3 > 0, np.uint64(1 << 60), draw.integers(0, 1 << 63, size=5000, dtype=np.uint64))
    keys = similar_vectors._keys(places, ids)
    curve.cut(keys[:2000], 10, 8)
    own, copies = np.zeros(10, int), 0
    for at, part, mine in curve.parts(keys):
        if mine:
            assert len(at) == 5000
            own += np.bincount(part, minlength=10)
        else:
            assert part.min() >= 0 and part.max() <= 9
            copies += len(at)
    assert own.max() < 800 and own.min() > 250 and 9 * 2 * 8 < copies < 9 * 2 * 60
