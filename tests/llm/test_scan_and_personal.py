"""Scan repair and personal data on small generated tables."""

from __future__ import annotations

import numpy as np
import pytest

from quirework.llm import personal_data, scan_repair

SPAN = "span_id string, document_id string, page_number int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, source string, doc string, core string"


def lines(spark, rows):
    """rows: (span_id, document, page, place on the page, text, source)."""
    return spark.createDataFrame([(i, d, p, t, 0.1, 0.05 + 0.03 * k, 0.8, 0.07 + 0.03 * k, None, s, "clash", "clash") for i, d, p, k, t, s in rows], SPAN)


def scanned(pages: int = 4) -> list[tuple]:
    rows = []
    draw = np.random.default_rng(8)
    body = "the claimant served a notice of the third-party complaint on the carrier and the mortgage was recorded".split()
    for p in range(1, pages + 1):
        texts = ["IN THE KELFORD COUNTY COURT" if p != 2 else "IN THE KELF~RD COUNTY COURT"]
        texts += [" ".join(draw.permutation(body)) + "." for _ in range(8)]
        texts += [f"- {p} -"]
        rows += [(f"s{p}-{k}", "d", p, k, t, "paddleocr") for k, t in enumerate(texts)]
    return rows


def test_noise_of_scanned_pages(spark):
    rows = scanned()
    extra = [
        ("h1", "e", 1, 1, "and the mort-", "vlm"), ("h2", "e", 1, 2, "gage was recorded on the", "vlm"), ("h3", "e", 1, 3, "notice of the third-", "vlm"), ("h4", "e", 1, 4, "party complaint.", "vlm"),
        ("m1", "e", 2, 1, "The mortg@gc was recorded", "vlm"), ("m2", "e", 2, 2, "on the clairnant,", "vlm"), ("null", "e", 2, 3, None, "vlm"), ("empty", "e", 2, 4, "", "vlm"),
        ("alone", None, None, 1, "7", None), ("native", "n", 1, 1, "a plain line of the complaint", "pdfplumber"),
    ]
    frame = lines(spark, rows + extra + extra[:2])
    got = {tuple(r) for r in scan_repair.found(frame).collect()}
    headers = {(f"s{p}-0", "header", "") for p in range(1, 5)}
    numbers = {(f"s{p}-9", "page_number", "") for p in range(1, 5)}
    assert headers <= got and numbers <= got
    assert ("h1", "hyphen", "mortgage") in got and ("h3", "hyphen", "third-party") in got
    assert ("m1", "misread", "mortgage") in got and ("m2", "misread", "claimant") in got
    assert {i for i, _, _ in got} <= {f"s{p}-{k}" for p in range(1, 5) for k in (0, 9)} | {"h1", "h3", "m1", "m2", "alone"}
    pages = {(r.document_id, r.page_number): r.text for r in scan_repair.clean_pages(frame).collect()}
    assert "KELF" not in pages["d", 2] and "- 2 -" not in pages["d", 2]
    assert "mortgage was recorded on the" in pages["e", 1] and "third-party complaint." in pages["e", 1]
    assert "The mortgage was recorded" in pages["e", 2] and "claimant," in pages["e", 2]


def test_headers_of_long_documents(spark):
    """A header on two of many pages; a word with many confusions; a page number of five figures."""
    draw = np.random.default_rng(9)
    body = "the claimant served a notice of the third-party complaint on the carrier and the mortgage was recorded".split()
    rows = []
    for p in range(1, 13):
        head = "SCHEDULE OF INSURED ITEMS" if p in (1, 8) else f"{' '.join(draw.permutation(body))}."
        lines_of = [head, *(" ".join(draw.permutation(body)) + "." for _ in range(6)), f"- {10_000 + p} -"]
        rows += [(f"q{p}-{k}", "long", p, k, t, "vlm") for k, t in enumerate(lines_of)]
    got = {tuple(r) for r in scan_repair.found(lines(spark, rows)).collect()}
    assert {("q1-0", "header", ""), ("q8-0", "header", "")} == {g for g in got if g[1] == "header"}
    assert {i for i, kind, _ in got if kind == "page_number"} == {f"q{p}-7" for p in range(1, 13)}
    assert scan_repair.anagram_hash("m" * 60 + "enn") in scan_repair.possible_hashes("rn" + "m" * 59 + "cnn")


def test_pages_without_spans_come_from_their_text(spark):
    """Both joinings of lines; a page with spans keeps these."""
    body = ["The mortg@gc was recorded and the", "clairnant served a notice of the mort-", "gage on the carrier in this place."]
    head = "IN THE KELFORD COUNTY COURT"
    pages = [
        ("x5", "d", 15, "\n".join([head, *body, "- 15 -"]), "vlm", 2), ("x5old", "d", 15, "old", "vlm", 1), ("x6", "d", 16, " ".join([head, *body, "- 16 -"]), "vlm_budget_exceeded", 1), ("x1", "d", 1, "not taken", "vlm", 1),
        ("n", "n", 1, "A plain complaint.\n\nThe carrier.", "pdfplumber", 1), ("nil", "z", 1, None, "vlm", 1), ("blank", "z", 2, " \n ", "vlm", 1), ("solo", None, None, "Filed on 6 May 2020", "vlm", 1),
    ]
    texts = spark.createDataFrame(pages, "extraction_id string, document_id string, page_num int, full_text string, source string, created_at int")
    got = {(r.document_id, r.page_number): r.text for r in scan_repair.clean_pages(lines(spark, scanned(8)), texts).collect()}
    clean = "The mortgage was recorded and the claimant served a notice of the mortgage on the carrier in this place."
    assert " ".join(got["d", 15].split()) == clean and " ".join(got["d", 16].split()) == clean
    assert "not taken" not in got["d", 1]
    assert got["n", 1] == "A plain complaint.\n\nThe carrier." and got["solo", -1] == "Filed on 6 May 2020"
    assert set(got) == {("d", p) for p in (*range(1, 9), 15, 16)} | {("n", 1), ("solo", -1)}


def test_scan_repair_of_nothing(spark):
    assert scan_repair.found(lines(spark, scanned()).limit(0)).count() == 0


@pytest.mark.parametrize(("wrong", "right"), [("mortg@gc", "mortgage"), ("clairnant", "claimant"), ("1ease", "lease"), ("daimant", "claimant"), ("rcqiiested", "requested"), ("ansvver", "answer")])
def test_anagram_hashes_meet(wrong, right):
    assert scan_repair.anagram_hash(right) in scan_repair.possible_hashes(wrong)


FIRST = "Wanda Lenka Orla Viggo Zoran Marek Hana Petra Bodil Farid".split()
LAST = "Huxberg Delltrand Karstrom Pelquist Osmann Veroso Nyswell Marrow Tarski Lomton".split()


def texts(seed: int, n: int) -> list[tuple[str, str, set]]:
    draw = np.random.default_rng(seed)
    pick = draw.choice
    rows = []
    for i in range(n):
        name = f"{pick(FIRST)} {pick(LAST)}"
        mail = f"{name.split()[1].lower()}{draw.integers(99)}@mail.example.org"
        phone = f"({draw.integers(200, 999)}) 555-01{draw.integers(10, 99)}"
        ssn = f"9{draw.integers(10, 99)}-{draw.integers(10, 99)}-{draw.integers(1000, 9999)}"
        street = f"{draw.integers(10, 9999)} {pick(['Gable', 'Ferry', 'Canal'])} {pick(['Street', 'Lane', 'Road'])}"
        company = f"{pick(['Corwyn', 'Kelford', 'Marby'])} {pick(['Freight', 'Title', 'Dairy'])} LLC"
        choice = i % 6
        if choice == 0:
            rows.append((f"r{i}", f"Signed by {name} for {company} on 3 May 2020.", {("name", name)}))
        elif choice == 1:
            rows.append((f"r{i}", f"Please contact {name} at {mail} regarding Claim D4291827.", {("name", name), ("email", mail)}))
        elif choice == 2:
            rows.append((f"r{i}", f"Witness {name}, holder of SSN {ssn}, was at {street} at 3:12 p.m.", {("name", name), ("id_number", ssn), ("address", street)}))
        elif choice == 3:
            rows.append((f"r{i}", f"Call {phone} or write to {mail} before May 4, 2021.", {("phone", phone), ("email", mail)}))
        elif choice == 4:
            rows.append((f"r{i}", f"{company} recorded instrument {draw.integers(10**9, 10**10)} against parcel 19-34-302-032-0000.", set()))
        else:
            rows.append((f"r{i}", f"Bill to: {name}, {street}.", {("name", name), ("address", street)}))
    return rows


def frames(spark, rows):
    spans = spark.createDataFrame([(i, f"doc{k % 20}", t, "clash") for k, (i, t, _) in enumerate(rows)] + [("null", "d", None, "c"), ("empty", None, "", "c"), (None, "d", "Signed by Wanda Huxberg for A", "c")], "span_id string, document_id string, text string, src string")
    sections = spark.createDataFrame([("sec", "d", "\n".join(t for _, t, _ in rows[:6]), 1), ("nil", None, None, 1)], "section_id string, draft_id string, final_text string, start int")
    return spans, sections


def test_personal_data_is_found_and_replaced(spark):
    rows = texts(1, 600)
    spans, sections = frames(spark, rows + rows[:3])
    got: dict[str, set] = {}
    for r in personal_data.found(spans, sections).collect():
        got.setdefault(r.row_id, set()).add((r.pii_type, r.value))
    truth = {i: items for i, _, items in rows}
    right = sum(len(got.get(i, set()) & items) for i, items in truth.items())
    assert right >= 0.97 * sum(map(len, truth.values()))
    assert sum(len(v) for k, v in got.items() if k in truth) <= 1.03 * sum(map(len, truth.values()))
    assert len(got["sec"]) >= 8
    clean = {r.row_id: r.text for r in personal_data.redact(spans, sections).collect()}
    i, text, items = rows[3]
    for kind, value in items:
        text = text.replace(value, f"[{kind.upper()}]")
    assert clean[i] == text and clean[rows[4][0]] == rows[4][1] and clean["empty"] == ""


def test_names_are_carried_to_unclear_places(spark):
    rows = texts(2, 300) + [("far", "The view of Zelmira Quandt was noted.", set()), ("clear", "Signed by Zelmira Quandt for Marby Title LLC on 3 May 2020.", set())]
    spans = spark.createDataFrame([(i, "one", t) for i, t, _ in rows], "span_id string, document_id string, text string")
    sections = spark.createDataFrame([], "section_id string, draft_id string, final_text string")
    got = {(r.row_id, r.value) for r in personal_data.found(spans, sections).where("pii_type = 'name'").collect()}
    assert ("clear", "Zelmira Quandt") in got


def test_rare_names_make_windows_in_their_document(spark):
    rows = texts(3, 300) + [("clear", "Signed by Zelmira Quandt for Marby Title LLC on 3 May 2020.", set()), ("far", "The view of Zelmira Quandt was noted.", set()), ("small", "as quandt said before", set()), ("plain", "The view of Many Others was noted.", set())]
    spans = spark.createDataFrame([(i, "one", t) for i, t, _ in rows], "span_id string, document_id string, text string")
    sections = spark.createDataFrame([], "section_id string, draft_id string, final_text string")
    every = personal_data.source_texts(spans, sections)
    model = personal_data.trained_model(every, personal_data.name_words(every), {"ocr_spans": len(rows), "draft_sections": 0})
    assert model.lexicon.count("quandt") and not model.lexicon.count("others")
    first = personal_data.first_states(every, model)
    pairs = first.selectExpr("explode(names) AS pair").distinct()
    seen = {r.row_id: r.text for r in first.union(personal_data.later_states(every, pairs, model)).collect()}
    assert "Zelmira Quandt" in seen["far"] and "quandt" in seen["small"] and "plain" not in seen
    got = {(r.row_id, r.value) for r in personal_data.found(spans.where("span_id <> 'small'"), sections).where("pii_type = 'name'").collect()}
    assert ("clear", "Zelmira Quandt") in got
    assert any(i == "far" and "Quandt" in value for i, value in got), [v for v in got if v[0] == "far"]


def test_names_come_in_blocks(spark, monkeypatch):
    """With more pairs of document and word than one table takes in, the windows are the same, and no two of a text overlap."""
    again = "the view of zoran there and of marek was noted before the court of orla by all who had come to the place of viggo in time"
    rows = texts(3, 300) + [("again", again, set())]
    spans = spark.createDataFrame([(i, "one", t) for i, t, _ in rows], "span_id string, document_id string, text string")
    sections = spark.createDataFrame([], "section_id string, draft_id string, final_text string")
    every = personal_data.source_texts(spans, sections)
    model = personal_data.trained_model(every, personal_data.name_words(every), {"ocr_spans": len(rows), "draft_sections": 0})
    codes = np.array([personal_data._code(word) for word in ("zoran", "marek", "orla", "viggo")], dtype=np.uint64)
    pairs = personal_data.mix(codes ^ np.array([every.first().doc]).view(np.uint64)).view(np.int64).tolist()
    pairs = spark.createDataFrame([(pair,) for pair in pairs], "pair bigint")

    def windows() -> list[tuple]:
        return [(r.row_id, r.start, r.text) for r in personal_data.later_states(every, pairs, model).collect()]

    whole = windows()
    assert [i for i, _, _ in whole] == ["again"]
    monkeypatch.setattr(personal_data, "PAIRS", 2)
    assert windows() == whole


def test_items_are_told_by_their_surroundings_too(spark, monkeypatch):
    """Recall with all features of formats held out while decoding."""
    rows = texts(5, 600)
    spans, sections = frames(spark, rows)
    truth = {(i, *item) for i, _, items in rows for item in items}
    every = personal_data.source_texts(spans, sections)
    model = personal_data.trained_model(every, personal_data.name_words(every), {"ocr_spans": len(rows), "draft_sections": 2})
    flags, got = personal_data.Flags(model.lexicon), set()
    for i, text, _ in rows:
        for window in personal_data.windows(text, flags):
            window.forms = [0] * len(window.forms)
            scores = model.unary([window])[0]
            logs, _ = personal_data.beliefs(scores[None].astype(float), np.ones((1, len(scores)), dtype=bool), model.steps)
            got |= {(i, personal_data.LABELS[label], text[a:b]) for label, a, b in personal_data.decoded(text, window.spans, logs[0].argmax(axis=1))}
    assert len(got & truth) >= 0.8 * len(truth)


def test_personal_data_of_nothing(spark):
    spans, sections = frames(spark, texts(1, 6))
    assert personal_data.found(spans.limit(0), sections.limit(0)).count() == 0


def test_tokens_written_alike():
    assert personal_data.alike("JALIL") == personal_data.alike("Jalil") == personal_data.alike("jal1l")
    assert personal_data.alike("Nysérault") == personal_data.alike("NYSERAULT")
