"""Problems 3 and 8."""

import pytest

from lectern.llm import pii, scanned

PAGE = "document_id string, page int, text string, used_ocr boolean, line string"


def test_page_numbers():
    yes = [("- 12 -", 12), ("Pg. l2 of 70", 12), ("xii", 12), ("[3]", 3), ("22 |", 22), ("Page 7", 7), ("2O", 20), ("— l4 —", 14)]
    no = [("12.", 12), ("12", 13), ("twelve", 12), ("(7) marks", 7), ("", 1), ("Page 7 Hill climbing", 7)]
    assert all(scanned.is_page_number(line, page) for line, page in yes)
    assert not any(scanned.is_page_number(line, page) for line, page in no)


def test_weighted_distance():
    for read, printed in (("scheclules", "schedules"), ("recorcl", "record"), ("grarnmar", "grammar"), ("(ontrol", "control"), ("vvith", "with"), ("caclie", "cache")):
        assert scanned.weighted_distance(read, printed, scanned.MOST_COST) <= 0.5
    assert scanned.weighted_distance("orthgoonal", "orthogonal", scanned.MOST_COST) == float("inf")


def corpus(spark):
    clean = "the recursive compiler delays every buffer. a run-time signal controls the memory of the machine while the schedule is read"
    rows = [(f"clean{i}", 1, clean, False) for i in range(6)]
    for page in range(4, 10):
        body = "The recursive compiler deiays every buffer. A run-\ntime signal con-\ntrols the mem0ry of the machine"
        rows.append(("scan", page, f"Graph Torkapas / Lecture Record\n{body}\nDept. of Hulmond Studies\n- {page} -", True))
    rows += [("scan", 4, rows[6][2], True), ("scan", 20, None, True), ("scan", 21, "", True), (None, 1, "x", True), ("odd", None, "x", True), ("maybe", 1, "mem0ry", None)]
    return spark.createDataFrame([(*r, "clash") for r in rows], PAGE)


def test_damaged_lines(spark):
    got = {(r.page, r.line_no, r.kind) for r in scanned.damaged_lines(corpus(spark)).collect() if r.document_id == "scan"}
    for page in range(4, 10):
        assert {(k, n) for p, n, k in got if p == page} == {("running_header", 0), ("misread", 1), ("split_word", 2), ("misread", 3), ("running_header", 4), ("page_number", 5)}


def test_readable_pages(spark):
    out = {r.page: r for r in scanned.readable_pages(corpus(spark)).collect() if r.document_id == "scan" and r.text}
    assert out[5].text == "The recursive compiler delays every buffer. A run-time signal controls the memory of the machine"
    assert (out[5].n_dropped, out[5].n_joined) == (3, 1)


def test_readable_chunks(spark):
    pages = corpus(spark)
    text = {r.page: r.text for r in pages.where("document_id = 'scan' and text != ''").collect()}
    lines = text[5].split("\n")
    rows = [
        ("whole", "scan", 5, text[5]),
        ("whole", "scan", 5, text[5]),
        ("begin", "scan", 5, "\n".join(lines[:3])),
        ("end", "scan", 5, "\n".join(lines[3:])),
        ("over", "scan", 5, "\n".join(lines[3:] + text[6].split("\n")[:2])),
        ("other", "scan", 5, "\n".join(lines[:2]) + "\nrecursive mem0ry buffer"),
        ("clean", "clean1", 1, "the recursive compiler"),
        ("null", "scan", 5, None),
        ("nowhere", "scan", 99, "mem0ry"),
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, page int, text string")
    got = scanned.readable_chunks(chunks, pages).collect()
    out = {r.chunk_id: r for r in got}
    assert len(got) == len(out) and set(out) == {"whole", "begin", "end", "over", "other"}
    assert out["whole"].text == "The recursive compiler delays every buffer. A run-time signal controls the memory of the machine"
    assert (out["whole"].n_dropped, out["whole"].n_joined) == (3, 1)
    assert out["begin"].text == "The recursive compiler delays every buffer. A run-time signal controls"
    assert out["end"].text == "the memory of the machine" and out["end"].n_dropped == 2
    assert out["over"].text.split() == "the memory of the machine The recursive compiler delays every buffer. A run-".split()
    assert out["other"].text.endswith("recursive memory buffer")


def test_long_words_are_repaired(spark):
    printed = ["electroencephalographically", "counterrevolutionary-minded", "microspectrophotometrica"]
    read = ["electroencephaloqraphically", "countcrrevolutionary-rnindcd", "rnicrospectrophotornetrica"]
    rows = [(f"clean{i}", 1, f"the {' and '.join(printed)} signal", False, "clash") for i in range(4)] + [("scan", 1, f"the {' and '.join(read)} signal", True, "clash")]
    pages = spark.createDataFrame(rows, PAGE)
    assert [(r.line_no, r.kind) for r in scanned.damaged_lines(pages).collect() if r.kind == "misread"] == [(0, "misread")]
    assert scanned.readable_pages(pages).first().text == f"the {' and '.join(printed)} signal"


def test_no_pages(spark):
    assert scanned.damaged_lines(corpus(spark).where("false")).count() == 0


LEXICON = {"nemim": 1, "quastelmoor": 2, "banelsen": 2, "olvira": 1}


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("write to a.b+lab2@cs.norvane.example before", "email", "a.b+lab2@cs.norvane.example"),
        ("mail dardiel_74 [at] cs [dot] norvane [dot] example.", "email", "dardiel_74 [at] cs [dot] norvane [dot] example"),
        ("or x AT mail DOT ostrand DOT example. It", "email", "x AT mail DOT ostrand DOT example"),
        ("call (030) 23125 141.", "phone", "(030) 23125 141"),
        ("(mobile 555-0127 ext. 40), co", "phone", "555-0127 ext. 40"),
        ("(mobile +1 415 555 0188), co", "phone", "+1 415 555 0188"),
        ("on +33 6 39 98 83 67, ask", "phone", "+33 6 39 98 83 67"),
        ("SSN is 993-55-2640 and", "identity_number", "993-55-2640"),
        ("UID no 016467844150, section", "identity_number", "016467844150"),
        ("passport no. XX9874886, section", "identity_number", "XX9874886"),
        ("stands at P.O. Box 801, Orrovric Square,\nRavgoabad 58907. The", "street_address", "P.O. Box 801, Orrovric Square,\nRavgoabad 58907"),
        ("to H.No. 17-8-386/B, Banelmoor Layout, Velshuville - 152900; late", "street_address", "H.No. 17-8-386/B, Banelmoor Layout, Velshuville - 152900"),
        ("at Ilmartistraße 41, 42252 Sultaabad, copied", "street_address", "Ilmartistraße 41, 42252 Sultaabad"),
        ("a Calle Chelviraez 14, 6º, 34869 Orgoona, sin", "street_address", "Calle Chelviraez 14, 6º, 34869 Orgoona"),
        ("to Flat 5B, 2 Pendrunsen Ave., Tavshuona; late", "street_address", "Flat 5B, 2 Pendrunsen Ave., Tavshuona"),
        ("In Nemim L. Quastelmoor's seminar", "person_name", "Nemim L. Quastelmoor"),
        ("see QUASTELMOOR, NEMIM for keys", "person_name", "QUASTELMOOR, NEMIM"),
        ("Prof S. Banelsen will", "person_name", "S. Banelsen"),
        ("ask for Olvira.", "person_name", "Olvira"),
        ("Mr Nemim Quastelmoor-Banelsen (mobile", "person_name", "Nemim Quastelmoor-Banelsen"),
    ],
)
def test_pieces(text, kind, piece):
    assert [(k, text[s:e]) for s, e, k in pii.find(text, LEXICON)] == [(kind, piece)]


SPELLINGS = {"nemim": 1, "ana": 1, "quastelmoor": 2, "banelsen": 2, "li": 2, "ng": 2, "o'brien": 2, "mcdonald": 2, "dvořák": 2}


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("In Nemim Quastelmoor Banelsen's seminar", ["Nemim Quastelmoor Banelsen"]),
        ("In Ana Nemim Quastelmoor\nBanelsen is", ["Ana Nemim Quastelmoor\nBanelsen"]),
        ("QUASTELMOOR BANELSEN, NEMIM for", ["QUASTELMOOR BANELSEN, NEMIM"]),
        ("Nemim Quastelmoor\nAna Banelsen", ["Nemim Quastelmoor", "Ana Banelsen"]),
        *((f"In Nemim {name}'s seminar", [f"Nemim {name}"]) for name in ("Li", "Ng", "NG", "O'Brien", "McDonald", "Dvořák", "DVOŘÁK", "O'BRIEN")),
        ("ask for Dr. Li.", ["Li"]),
        ("ask for Mr. Nobody who", []),
    ],
)
def test_names_of_any_length_and_spelling(text, pieces):
    assert [text[s:e] for s, e, _ in pii.find(text, SPELLINGS)] == pieces


@pytest.mark.parametrize(
    "text",
    ["ISBN 978-0-00-393132-0", "host 192.0.2.93 drops 4 294 967 296 packets", "took 334 782 183 cycles at 3 @ 81 each", "A @ B = C51", "bounds it by 112-91-49 units", "2018-05-27", "By the Olvira rule, no", "Use @opcode.transform on release 8.6.325", "31926178072813684", "", "The node stands at High level."],
)
def test_nothing_personal(text):
    assert pii.find(text, LEXICON) == []


def test_names_come_from_the_corpus(spark):
    texts = [f"Submitted by Velrasha Kalmendal for the task {i}." for i in range(5)] + ["Later Velrasha Kalmendal wrote more about the Graph.", None, "", "Dr. Graph is a title."]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, term string")
    for most in (10, 0):  # with the terms broadcast, and joined
        out = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in pii.found(rows, broadcast_terms=most).collect()}
        assert {(i, "Velrasha Kalmendal") for i in range(6)} <= out
    clean = {r.doc_id: r.text for r in pii.scan(rows, clean=True).collect()}
    assert clean[0] == "Submitted by [PERSON_NAME] for the task 0." and clean[6] is None and clean[7] == ""
    assert pii.found(rows.where("false")).count() == 0


def test_numbers_of_any_form_behind_words_that_disclose_them(spark):
    known = [f"My mobile +33 6 39 98 83 {i:02} is new." for i in range(6)] + [f"The passport XX98748{i:02} was lost." for i in range(6)] + [f"It took {i}12 345 678 steps and mass {i}1234567." for i in range(8)]
    asked = ["Her mobile 06-12345678, please", "mobile: 010-1234-5678.", "mobile (02) 12.34.56.78 or", "his passport YB 1234 5678 9 is", "it took 912 345 678 steps", "mobile 1234567890123456789", "mobile 12-05", "of mass 21234567 g", "mobile\n06-12345678"]
    rows = spark.createDataFrame(list(enumerate(asked + known)), "doc_id long, text string")
    for most in (1000, 0):  # with the words broadcast, and joined
        out = {(r.doc_id, r.kind, asked[r.doc_id][r.start_pos : r.end_pos]) for r in pii.found(rows, broadcast_terms=most).collect() if r.doc_id < len(asked)}
        assert out == {(0, "phone", "06-12345678"), (1, "phone", "010-1234-5678"), (2, "phone", "(02) 12.34.56.78"), (3, "identity_number", "YB 1234 5678 9")}


def test_long_pieces_are_whole():
    long = "x" * 300 + ".y" * 40 + "@mail.example"
    assert [long[s:e] for s, e, _ in pii.find(long, {})] == [long]
    text = "ask for" + " " * 60 + "Olvira."
    assert [text[s:e] for s, e, _ in pii.find(text, LEXICON)] == ["Olvira"]


def test_positions_count_code_points():
    text = "👩‍🔬 é mail a@b.example"
    (start, end, _), = pii.find(text, {})
    assert text[start:end] == "a@b.example"


def test_queries_run_on_small_tables(spark, small):
    from lectern.llm import queries

    for name, query in queries.queries().items():
        assert query(spark, small).count() >= 0, name
