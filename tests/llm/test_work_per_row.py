"""What is done once for many rows, and that it gives what was done for each."""

from __future__ import annotations

import pickle
from itertools import pairwise, product

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark.sql import functions as F

from quirework.llm import personal_data, scan_repair


class Caught(Exception):
    """Holds the function that a DataFrame is mapped with."""


class Texts:
    """Stands for a DataFrame up to the point where Python takes over."""

    def select(self, *columns):
        return self

    def mapInPandas(self, function, schema):
        raise Caught(function)


def test_name_words_of_many_batches_are_put_together(monkeypatch):
    try:
        personal_data.name_words(Texts())
    except Caught as caught:
        count = caught.args[0]
    batches = [pd.DataFrame({"text": ["Signed by Orla Quent", "Orla came late, Viggo early"]})] * 5
    (whole,) = count(iter(batches))
    assert sorted(whole[["n", "seen"]].itertuples(index=False, name=None)) == [(0, 5), (0, 5), (5, 5), (5, 10)]
    monkeypatch.setattr(personal_data, "KEPT", 3)
    parts = pd.concat(count(iter(batches))).groupby("cell").sum()
    assert parts.to_dict() == whole.set_index("cell").to_dict()


def test_tokens_seen_before_are_kept_for_all_tasks_and_do_not_travel():
    lexicon = personal_data.Lexicon(np.zeros(1 << personal_data.CELLS, dtype=np.uint8))
    lexicon.flags.of("Signed by 212 867 5309")
    assert lexicon.flags is lexicon.flags and len(lexicon.flags) == 5
    assert not pickle.loads(pickle.dumps(lexicon)).flags


def test_flags_of_a_text():
    flags = personal_data.Lexicon(np.zeros(1 << personal_data.CELLS, dtype=np.uint8)).flags
    assert flags.of("the view was noted") == 0
    assert flags.of("call 867 5309") & personal_data.IS_NUMBER
    assert flags.of("4 Elm Street") & personal_data.IS_STREET and not flags.of("Elm Street, No 4") & personal_data.IS_STREET
    assert flags.of("call 212-867-5309") & personal_data.IS_NUMBER and not flags.of("parcel 212-867-5309") & personal_data.IS_NUMBER


def flags_of_one(flags: personal_data.Flags, text: str) -> int:
    """The flags of a text, token by token."""
    P = personal_data
    found, last, house = 0, 0, 9
    for token in text.split():
        own = flags[token]
        if own & P.IS_DIGITS & last:
            found |= P.IS_NUMBER
        if own & P.IS_NUMBER and last & P.IS_NUMBERED:
            own &= ~P.IS_NUMBER
        if own & P.IS_ROAD and house <= 5:
            found |= P.IS_STREET
        if own & P.IS_HOUSE:
            house = 0
        found |= own
        last, house = own, house + 1
    return found


def test_flags_of_many_texts():
    counts = np.zeros(1 << personal_data.CELLS, dtype=np.uint8)
    counts[personal_data._code("quent") >> 64 - personal_data.CELLS] = 3
    flags = personal_data.Lexicon(counts).flags
    draw = np.random.default_rng(7)
    words = "the Quent quent 4 12 867 5309 212-867-5309 parcel Claim Street Rd. rue (at) @ Signed by al-Quent 14B, A123456 $1,200.50 é \x1c".split(" ")
    texts = ["", " ", "\n", " 4 Elm", "Street", "4", "5309"] + [str(draw.choice([" ", "  ", "\u2003"])).join(draw.choice(words, draw.integers(0, 12))) for _ in range(2000)]
    wanted = [flags_of_one(flags, text) for text in texts]
    assert flags.of_all(pa.array(texts)).tolist() == wanted and len(set(wanted)) > 40
    assert flags.of_all(pa.array(texts)[5:]).tolist() == wanted[5:] and not len(flags.of_all(pa.array([], pa.string())))


def test_figures_are_looked_at_once_for_all_numbers_of_a_form(monkeypatch):
    tried = []

    class Counting:
        match = staticmethod(lambda token: tried.append(token) or whole.match(token))

    whole = personal_data._NUMBER_LIKE
    monkeypatch.setattr(personal_data, "_NUMBER_LIKE", Counting)
    flags = personal_data.Lexicon(np.zeros(1 << personal_data.CELLS, dtype=np.uint8)).flags
    tokens = [f"{a}{k}{z}" for k in range(1000, 1400) for a, z in (("$1,", ".50"), ("212-867-", ","), ("2020-CV-", ""))]
    assert {bool(flags.of(token) & personal_data.IS_NUMBER) for token in tokens[1::3]} == {True}
    assert {flags.of(token) for token in tokens[::3] + tokens[2::3]} == {0}
    assert len(tried) == 3


def test_only_texts_that_can_have_windows_are_looked_through(monkeypatch):
    class Shared(Texts):
        sparkSession = property(lambda self: self)
        sparkContext = property(lambda self: self)

        def broadcast(self, value):
            self.value = value
            return self

        def mapInArrow(self, function, schema):
            raise Caught(function)

    looked = []
    whole = personal_data.windows
    monkeypatch.setattr(personal_data, "windows", lambda text, *rest, **more: looked.append(text) or whole(text, *rest, **more))
    try:
        personal_data.first_states(Shared(), personal_data.Model(personal_data.Lexicon(np.zeros(1 << personal_data.CELLS, dtype=np.uint8))))
    except Caught as caught:
        states = caught.args[0]
    texts = ["the view was noted", "", "write to orla@quent.org", "Signed by Orla Quent", "of 12 pages"]
    batch = pa.RecordBatch.from_pydict({"src": ["a"] * 5, "row_id": list("vwxyz"), "doc": pa.array(range(5), pa.int64()), "text": texts})
    rows = pa.Table.from_batches(states(iter([batch, batch.slice(0, 0), batch.slice(3)])))
    assert looked == [texts[2], texts[3], texts[3]]
    assert set(rows["row_id"].to_pylist()) <= {"x", "y"}


def test_keys_of_groups_are_made_once_for_a_token(monkeypatch):
    made = []
    whole = personal_data.shared_key
    monkeypatch.setattr(personal_data, "shared_key", lambda token, lexicon: made.append(token) or whole(token, lexicon))
    lexicon = personal_data.Lexicon(np.zeros(1 << personal_data.CELLS, dtype=np.uint8))
    lexicon.counts[personal_data._code("quent") >> 64 - personal_data.CELLS] = 3
    text, logs = "Orla Quent saw Viggo", np.log(np.full((4, 6), 1 / 6))
    logs[3], got = [0, *[-50.0] * 5], np.full((4, 6), 0.5)
    spans = [m.span() for m in personal_data._TOKEN.finditer(text)]
    for told in (None, got):
        sent = list(personal_data._sent(text, spans, logs, told, lexicon))
        assert [(at, key) for at, key, _ in sent] == [(0, "orla"), (1, "quent")]
        assert np.allclose([own for _, _, own in sent], np.log(1 / 6) - (0 if told is None else 0.5))
    assert made == ["Orla", "Quent", "saw", "Viggo"]


def test_beliefs_are_those_over_all_sequences():
    draw = np.random.default_rng(12)
    steps = draw.normal(size=(6, 6)) * 3
    for scale in (1, 60):
        unary, sizes = draw.normal(size=(5, 4, 6)) * scale, [4, 1, 3, 2, 4]
        filled = np.arange(4) < np.array(sizes)[:, None]
        logs, expected = personal_data.beliefs(np.where(filled[:, :, None], unary, 0.0), filled, steps)
        pairs = np.zeros((6, 6))
        for scores, own, n in zip(unary, logs, sizes):
            ways = np.array(list(product(range(6), repeat=n)))
            weights = scores[np.arange(n), ways].sum(axis=1) + steps[ways[:, :-1], ways[:, 1:]].sum(axis=1)
            weights -= np.logaddexp.reduce(weights)
            for at in range(n):
                assert np.allclose(own[at], [np.logaddexp.reduce(weights[ways[:, at] == label]) for label in range(6)])
            for at in range(n - 1):
                np.add.at(pairs, (ways[:, at], ways[:, at + 1]), np.exp(weights))
        assert np.allclose(expected, pairs)


def test_patterns_are_tried_only_where_their_words_are(monkeypatch):
    tails = [" testified", " may be reached", " and diagnosed", " shows SSN", ", resides at", " holder of", " at orla@quent.org", " (orla [at] quent.org", ", orla(at)quent.org", " came"]
    texts = [f"On Monday Orla {name}{tail}. Then all left." for tail in tails for name in ("Quent", "de Quent", "Q. Vell")]
    quick = [personal_data.pattern_items(text) for text in texts]
    assert len(personal_data._NEEDED) == 2
    monkeypatch.setattr(personal_data, "_NEEDED", {})
    assert [personal_data.pattern_items(text) for text in texts] == quick and sum(map(bool, quick)) >= 24


def test_solved_windows_with_messages():
    draw = np.random.default_rng(4)
    steps, sizes = draw.normal(size=(6, 6)), [3, 1, 5]
    unary = [draw.normal(size=(n, 6)).astype(np.float16) for n in sizes]
    told = [[{"at": 2, "logs": [-1.0, 0, 0, 0, 0, -2.0]}], None, []]
    rows = {
        "ends": pa.array([list(range(2 * n)) for n in sizes], pa.list_(pa.int32())),
        "unary": pa.array([own.tobytes() for own in unary]),
        "messages": pa.array(told, pa.list_(pa.struct([("at", pa.int32()), ("logs", pa.list_(pa.float64()))]))),
    }
    batch = pa.RecordBatch.from_pydict(rows)
    got = {i: (spans.tolist(), logs, own) for i, spans, logs, own in personal_data._solved(batch, steps)}
    for i, n in enumerate(sizes):
        scores = unary[i].astype(float)
        for message in told[i] or []:
            scores[message["at"]] += message["logs"]
        logs, _ = personal_data.beliefs(scores[None], np.ones((1, n), dtype=bool), steps)
        assert np.allclose(got[i][1], logs[0]) and np.allclose(got[i][2], scores - unary[i])
        assert got[i][0] == [[a, a + 1] for a, _ in pairwise(range(2 * n + 1))][::2]
    assert not list(personal_data._solved(batch.slice(0, 0), steps))
    assert len(list(personal_data._solved(batch.slice(1, 2), steps))) == 2


def test_lines_alike_are_those_of_the_whole_distance(spark):
    draw = np.random.default_rng(6)
    pairs = []
    for length in [*range(4, 40), 120, 300]:
        text = "".join(draw.choice(list("abcé 1"), length))
        for wrong in range(8):
            other = list(text)
            for _ in range(wrong):
                at = int(draw.integers(0, len(other)))
                other[at : at + int(draw.integers(0, 2))] = draw.choice(["", "z", "zz"])
            pairs.append((text, "".join(other)))
    pairs += [("", ""), ("", "z"), ("abcdefgh", "z")]
    frame = spark.createDataFrame(pairs, "a string, b string")
    whole = F.levenshtein("a", "b") * scan_repair.LETTERS_PER_ERROR <= F.greatest(F.length("a"), F.length("b"), F.lit(scan_repair.LETTERS_PER_ERROR))
    rows = frame.select(scan_repair.alike(F.col("a"), F.col("b")).alias("got"), whole.alias("whole")).collect()
    assert [r.got for r in rows] == [r.whole for r in rows] and 20 < sum(r.whole for r in rows) < len(rows) - 20


def test_only_lines_at_the_edges_are_looked_up(spark):
    rows = [(f"{d}{k}", d, 1, f"line {k}", 0.1, 0.9, 0.1 * k, 0.1 * k + 0.05, source) for d, source in (("s", "vlm"), ("n", "pdfplumber"), ("u", None)) for k in range(7)]
    frame = spark.createDataFrame(rows, "span_id string, document_id string, page_number int, text string, x0 double, x1 double, y0 double, y1 double, source string")
    lines = scan_repair.page_lines(frame)
    noise = spark.createDataFrame([("s0",), ("s5",), ("u6",)], "span_id string")
    body = scan_repair.body_lines(lines, noise)
    assert sorted(r.span_id for r in body.collect()) == sorted(r.span_id for r in lines.join(noise, "span_id", "left_anti").collect())
    assert body.columns == lines.columns
    looked_up = lines.where(scan_repair.AT_EDGE).select("span_id").collect()
    assert sorted(r.span_id for r in looked_up) == [f"{d}{k}" for d in "su" for k in (0, 1, 5, 6)]


def test_broken_words_and_words_are_counted_once(spark, monkeypatch):
    written = []
    whole = scan_repair.materialize
    monkeypatch.setattr(scan_repair, "materialize", lambda df: written.append(set(df.columns)) or whole(df))
    rows = [("a", "d", 1, "and the mort-", 0.1, 0.9, 0.1, 0.15, "vlm"), ("b", "d", 1, "gage was\trecorded", 0.1, 0.9, 0.2, 0.25, "vlm")]
    frame = spark.createDataFrame(rows, "span_id string, document_id string, page_number int, text string, x0 double, x1 double, y0 double, y1 double, source string")
    assert {tuple(r) for r in scan_repair.found(frame).collect()} == {("a", "hyphen", "mortgage")}
    for columns in ({"span_id", "joined", "compound", "low_joined", "kept", "n_joined"}, {"word", "n"}, {"core", "right"}):
        assert written.count(columns) == 1
