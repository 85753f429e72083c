"""Splitting, encoding, leaks and stuffed pages: nulls, empties, ties, repeats, clashing columns, round trips."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirework.llm import encode_corpus, leaked_items, split_pieces, stuffed_pages

PAGES = "extraction_id string, template_id string, section_name string, full_text string, limit_max int, piece string"
SPECS = "template_id string, template_version int, name string, target_length_max int, created_at timestamp"


def pages(spark, *rows):
    return spark.createDataFrame([(i, t, s, x, 1, "clash") for i, t, s, x in rows], PAGES)


def specs(spark, *rows):
    return spark.createDataFrame([(*r, None) for r in rows], SPECS)


def test_split_limits_overlaps_and_cases(spark):
    text = " ".join(f"W{i}." if i % 7 == 6 else f"W{i}" for i in range(100)) + "\n\nTail here"
    own = specs(spark, ("t", 1, "s", 5), ("t", 3, "s", 30), ("t", 2, "s", 500), ("t", 1, "n", 5), ("t", 2, "n", None))
    rows = [("a", "t", "s", text), ("a", "t", "s", text), ("b", "t", "s", "short"), ("c", "t", "n", text), ("d", None, "s", text), ("e", "t", "s", None), ("f", "t", "s", ""), ("g", "x", "s", text)]
    got = split_pieces.split_oversized(pages(spark, *rows), own).orderBy("piece_no").collect()
    assert {r.extraction_id for r in got} == {"a"} and len(got) == got[0].n_pieces
    words = text.split()
    for before, after in zip(got, got[1:]):
        assert before.n_words <= 30 and after.start_word == before.end_word - 15
    assert all(r.piece.split() == words[r.start_word : r.end_word] for r in got)
    assert got[0].start_word == 0 and got[-1].end_word == len(words)
    assert all(r.boundary >= split_pieces.SENTENCE for r in got)
    assert [r.extraction_id for r in split_pieces.found(pages(spark, *rows), own).collect()] == ["a"]


def test_split_empty_tables(spark):
    assert split_pieces.split_oversized(pages(spark).limit(0), specs(spark).limit(0)).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.data())
def test_strongest_gap_is_the_rightmost_maximum(strengths, data):
    low = data.draw(st.integers(0, len(strengths) - 1))
    high = data.draw(st.integers(low, len(strengths) - 1))
    strength, place = split_pieces.StrongestGap(np.array(strengths)).query(low, high)
    window = strengths[low : high + 1]
    assert strength == max(window)
    assert place == max(i for i in range(low, high + 1) if strengths[i] == strength)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(-3, 40), st.integers(0, 20))
def test_cuts_cover_all_words(strengths, limit, overlap):
    cuts = split_pieces.cut_points(np.array(strengths), limit, overlap)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(strengths)
    assert all(b - a <= max(limit, 1) for a, b, _ in cuts)
    assert all(c == b - min(overlap, max(limit, 1) - 1) for (_, b, _), (c, _, _) in zip(cuts, cuts[1:]))


PARTS = ["a", "bc", " ", "  ", "\n", "\t", "'s", "'", "ll", "é", "中文", "🙂", "12", ".", "!?", " ", "　", "don't", "<|endoftext|>", "​"]


@settings(deadline=None, max_examples=400)
@given(st.lists(st.sampled_from(PARTS), max_size=60).map("".join), st.integers(1, 8), st.sampled_from([1, 2, 16]))
def test_joined_parts_equal_the_whole(text, count, window):
    encoding = encode_corpus.encoder(open(encode_corpus.VOCABULARY, "rb").read())
    parts = [encoding.encode_ordinary(text[i * len(text) // count : (i + 1) * len(text) // count]) for i in range(count)]
    ids: list[int] = []
    for part in parts:
        ids = encode_corpus.join_ids(encoding, ids, part, window)
    assert ids == encoding.encode_ordinary(text)
    assert encode_corpus.join_tree(encoding, parts) == encoding.encode_ordinary(text)


def test_encoding_of_whole_tables(spark):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(encode_corpus.VOCABULARY.replace(".tiktoken", ".json"))
    other.encode_special_tokens = True
    long = "The lien's   été 中文🙂 was released. " * 400 + "x" * 9000 + " \n " * 3000
    texts = [(1, None), (2, ""), (3, "  "), (4, "plain <|endoftext|> text"), (5, long), (6, long), (6, long)]
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in texts], "doc_id bigint, text string, ids string, k int")
    got = encode_corpus.encode_corpus(frame, part_chars=512).collect()
    assert len(got) == len(texts)
    expected = {i: other.encode(t, add_special_tokens=False).ids if t else [] for i, t in texts}
    assert all(list(r.ids) == expected[r.doc_id] for r in got)
    assert encode_corpus.encode_corpus(frame.limit(0)).count() == 0


def test_leaks_with_places(spark):
    words = [f"word{i}" for i in range(40)]
    item = " ".join(words)
    doc = "Before it. " + "  ".join(f"“{w.upper()}”," for w in words[5:25]) + " - after it"
    docs = [(1, doc), (1, doc), (2, " ".join(words[:12])), (3, None), (4, ""), (5, " ".join(words[3:16])), (6, item + " " + item)]
    frame = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id bigint, text string, item_id bigint")
    items = spark.createDataFrame([(7, item, "x"), (7, item, "x"), (8, item, "x"), (9, None, "x"), (10, "too short", "x")], "item_id bigint, text string, doc_id string")
    assert {tuple(r) for r in leaked_items.found(frame, items).collect()} == {(d, i) for d in (1, 5, 6) for i in (7, 8)}
    passage = leaked_items.leaked_passages(frame, items).where("doc_id = 1 and item_id = 7").first()
    assert (passage.n_words, passage.item_word, passage.doc_word) == (20, 5, 2)
    assert passage.passage == doc[passage.start_char : passage.end_char] and passage.passage.startswith("“WORD5”")
    assert leaked_items.leaked_passages(frame, items).where("doc_id = 6 and item_id = 7").count() == 2
    assert sorted(map(tuple, leaked_items.leaked_passages(frame, items, at_once=60).collect())) == sorted(map(tuple, leaked_items.leaked_passages(frame, items).collect()))
    assert leaked_items.found(frame, items.limit(0)).count() == 0
    assert leaked_items.found(frame.limit(0), items).count() == 0


def test_leaks_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(leaked_items, "BYTES_AT_ONCE", 1)
    text = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(i, text) for i in range(3)], "item_id bigint, text string")
    assert leaked_items.found(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items).count() == 3


def corpus(seed: int) -> list[tuple[int, str, bool]]:
    draw = np.random.default_rng(seed)
    nouns = "court lien policy notice survey annex parcel claim deed lease order witness".split()
    rows = []
    for i in range(260):
        prose = [f"The {draw.choice(nouns)} of the {draw.choice(nouns)} was filed with the {draw.choice(nouns)} on {draw.integers(1, 28)} May {draw.integers(1990, 2024)}." for _ in range(draw.integers(3, 12))]
        kind = i % 8
        phrases = [f"{draw.choice(['cheap', 'best', 'free'])} {draw.choice(['loan', 'lawyer', 'quote'])} {draw.choice(['online', 'near me', 'help'])}" for _ in range(2)]
        if kind == 0:
            rows.append((i, " ".join(draw.choice(phrases) for _ in range(60)), True))
        elif kind == 1:
            rows.append((i, "\n".join(f"[{draw.choice(phrases)}](https://{draw.choice(nouns)}.example/{draw.integers(999)})" for _ in range(30)), True))
        elif kind == 2:
            rows.append((i, "Tags: " + " ".join(f"#{draw.choice(phrases).replace(' ', '_')}" for _ in range(40)), True))
        elif kind == 3:
            rows.append((i, "\n".join(f"Exhibit {k}-{draw.integers(300)} | {draw.choice(nouns)} | {draw.integers(1, 28)} May 2020 | ${draw.integers(9999)}" for k in "ABCDEFGHIJ"), False))
        else:
            rows.append((i, " ".join(prose) + (" See https://court.example/rules for more." if kind == 4 else ""), False))
    return rows


def test_stuffed_pages_on_held_out_texts(spark):
    model = stuffed_pages.train([t for _, t, _ in corpus(1)])
    rows = corpus(2)
    right = sum((model.shares([stuffed_pages.Page(t)])[0][0] > 0.5) == stuffed for _, t, stuffed in rows)
    assert right / len(rows) >= 0.97


def test_stuffed_pages_cases(spark):
    rows = corpus(3) + [(1000, None, False), (1001, "", False), (1002, " \n ", False), (None, "One line.", False)]
    frame = spark.createDataFrame([(i, t, "clash") for i, t, _ in rows + rows[:5]], "doc_id bigint, text string, labels string")
    found = [r.doc_id for r in stuffed_pages.found(frame).collect()]
    assert len(found) == len(set(found))
    assert len(set(found) ^ {i for i, _, stuffed in rows if stuffed}) <= 8
    shares = stuffed_pages.page_shares(frame)
    assert shares.count() == len(rows) + 5
    assert {r.n_words for r in shares.where("doc_id in (1000, 1001, 1002)").collect()} == {0}
    assert stuffed_pages.found(frame.limit(0)).count() == 0
