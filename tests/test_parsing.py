"""Questions, outlines, keyphrases, sources."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import concepts, exam_parse, labels, outline
from lectern.sources import readers

PAPER = """May 2021
PART - A
1. Define a binary tree and give one use of it. [2]
2. State the pumping lemma. (3)
PART - B
11. (a) Explain how a stack differs from a queue
in memory use. (7)
(b) Compare arrays with lists. (5)
Page 1
"""


def test_parse_pages():
    rows = exam_parse.parse_pages([(1, PAPER), (2, "which goes on here.\n12 Describe quicksort in detail. (10)")])
    assert [(r["part"], r["question_number"], r["marks"]) for r in rows] == [("A", "1", 2), ("A", "2", 3), ("B", "11(a)", 7), ("B", "11(b)", 5), ("B", "12", 10)]
    assert rows[2]["prompt_text"] == "Explain how a stack differs from a queue in memory use."
    assert all(r["paper_label"] == "May 2021" for r in rows)


def test_parse_restarts_numbers_in_a_part():
    rows = exam_parse.parse_pages([(1, "PART A\n1 Explain the first thing here.\nPART B\n1 Explain the second thing here.\n(b) And one more of its parts.")])
    assert [(r["part"], r["question_number"]) for r in rows] == [("A", "1"), ("B", "1"), ("B", "1(b)")]


FILLER = "\nFigures may be drawn in pencil; every answer must be written in the book that was handed out."


def test_parse_questions_frame(spark):
    pages = spark.createDataFrame([("d", 1, PAPER), ("d", 2, "12 b) short page"), ("e", 1, None), (None, 1, PAPER), ("f", 1, "Download ISL Student\n" + PAPER)], "document_id string, page int, text string")
    out = exam_parse.parse_questions(pages).collect()
    assert {r.document_id for r in out} == {"d", "f"} and len([r for r in out if r.document_id == "f"]) == 4
    assert exam_parse.parse_questions(pages.where("false")).count() == 0


COMPULSORY = "Note: First question is compulsory and answer any four of the others.\n1. a) List the reasons to study trees.\nb) Draw a parse tree of some grammar.\n2. (@) Discuss the kinds of search trees.\nb) Compare heaps with queues, please."
UNNUMBERED = "PART -— A (25 Marks)\nDraw the tree of the sum (a + b) * c.\nWhat are regular expressions?\nDefine dynamic binding of names.\nPART -B (50 Marks)\n11. Explain the phases of a compiler.\n12.a) Explain how the stack is used.\nb) Explain how loops are written."


def test_layouts_of_papers(spark):
    pages = spark.createDataFrame([("c", 1, COMPULSORY), ("u", 1, UNNUMBERED)], "document_id string, page int, text string")
    out = sorted((r.document_id, r.part, r.question_number) for r in exam_parse.parse_questions(pages).collect())
    assert out == [("c", "C", "1(a)"), ("c", "C", "1(b)"), ("c", "C", "2(a)"), ("c", "C", "2(b)"), ("u", "A", "1"), ("u", "A", "2"), ("u", "A", "3"), ("u", "B", "11"), ("u", "B", "12(a)"), ("u", "B", "12(b)")]


def test_formats_and_drops(spark):
    texts = {
        "part": "PART - A\n1 Write something about trees here. (2)" + FILLER,
        "compulsory": COMPULSORY,
        "goes_on": "12 b) Explain how a stack differs from a queue.",
        "code_only": "Code No. 3112/N\n" + "x " * 300 + "\n13 a) Explain how loops end.",
        "note": "Note: answer all of PART - A and three more" + FILLER,
        "short": "PART - A",
        "numbered": "1. Explain the first thing.\n2) Explain the second." + FILLER,
        "start": "FACULTY OF ENGINEERING\nSubject: Trees" + FILLER,
        "coded": "Code No: E-5772/N\nPART - B\nE 5772 / 0 / BL and 12345" + FILLER,
        "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "name string, text string")
    t = F.col("text")
    out = {r.name: r for r in rows.select("name", exam_parse.paper_format(t).alias("format"), exam_parse.page_drops(t).alias("drops"), exam_parse.codes_in(t).alias("codes")).collect()}
    assert {n: r.format for n, r in out.items()} == {"part": "part_ab", "compulsory": "compulsory_q1", "goes_on": "continuation", "code_only": "continuation", "note": "skip", "short": "skip", "numbered": "part_ab", "start": "skip", "coded": "part_ab", "null": "skip"}
    assert out["start"].drops == ["format_skip", "no_code_no", "no_part_header"] and out["short"].drops == ["unreadably_short", "format_skip"] and out["coded"].drops == []
    assert out["coded"].codes == ["E-5772/N", "E-5772/O/BL", "12345"] and out["part"].codes == []
    marked = rows.select(exam_parse.without_watermarks(F.lit("a\nxx oddasif yy\nb"))).first()[0]
    assert marked == "a\nb"


def test_overlap(spark):
    pairs = spark.createDataFrame([("Define a tree", "define a tree!"), ("", "x"), (None, "x"), ("Define a binary tree", "binary"), ("Explain the heaps of a graph", "heap of graphs"), ("abcd efgh", "abcd efgx")], "a string, b string")
    out = {r.b: r.overlap for r in exam_parse.fuzzy_pairs(pairs, "a", "b").collect()}
    assert out == {"define a tree!": 1.0, "x": 0.0, "binary": 0.3, "heap of graphs": 1.0, "abcd efgx": round(16 / 18, 6)}


def test_codes(spark):
    expected = spark.createDataFrame([("s", i, c) for i, c in enumerate(["E-5002/O", "E-5807/N", "D-1111/N", "D-2222/N", "D-2222/N/BL"])], "scope string, ordinal int, code string")
    actual = spark.createDataFrame([("s", c) for c in ["e 5002/0", "E-5801/N", "D-2222/O", None, "99999"]], "scope string, code string")
    out = {r.code: (r.match, r.matched_code) for r in exam_parse.match_codes(expected, actual).collect()}
    assert out["E-5002/O"] == ("exact", "E-5002/O") and out["E-5807/N"] == ("fuzzy", "E-5801/N")
    assert out["D-1111/N"] == ("missing", None) and out["D-2222/N"][0] == "fuzzy"
    assert exam_parse.match_codes(expected.where("false"), actual).count() == 0


def test_outline_from_headings(spark):
    text = "UNIT - II Graphs and Trees\n2.1 Paths in graphs\nbody\n2.2 Cycles"
    pages = spark.createDataFrame([("d", 3, text), ("d", 5, "2.3 Flows"), ("d", 8, "the end"), ("d", 9, None)], "document_id string, page int, text string")
    assert [(r.unit_no, r.title) for r in outline.unit_headings(pages).collect()] == [(2, "Graphs and Trees")]
    last = pages.groupBy("document_id").agg(F.max("page").alias("last_page"))
    spans = outline.section_spans(outline.section_headings(pages), last).orderBy("minor").collect()
    assert [(r.minor, r.page_start, r.page_end) for r in spans] == [(1, 3, 3), (2, 3, 4), (3, 5, 9)]


def test_contents_need_several_lines(spark):
    lines = "\n".join(f"Topic {c} ...... {i}" for i, c in enumerate("abcd", 1))
    pages = spark.createDataFrame([("d", 1, lines), ("d", 2, "Lonely ..... 9")], "document_id string, page int, text string")
    assert [r.start_page for r in outline.contents(pages).orderBy("line_no").collect()] == [1, 2, 3, 4]


def test_topics_and_pasted_trees(spark):
    one = spark.createDataFrame([("Sets (finite, (in)finite), maps; proofs. Next v1.2, end",)], "t string")
    assert one.select(outline.split_topics(F.col("t"))).first()[0] == ["Sets (finite, (in)finite)", "maps", "proofs", "Next v1.2", "end"]
    text = "  lost\nUnit one\n  - Part a\n    * Topic x\n\nUnit two\n\tTopic y"
    nodes = outline.pasted_tree(spark.createDataFrame([("i", text), ("n", None)], "id string, text string")).orderBy("node_no").collect()
    assert [(n.level, n.title, n.parent_no) for n in nodes] == [(1, "lost", None), (0, "Unit one", None), (1, "Part a", 1), (2, "Topic x", 2), (0, "Unit two", None), (2, "Topic y", 5)]
    joined = spark.createDataFrame([("The first\ngoes on\n\nSecond line,\nThird cat-\negory\nEnd",), (None,), ("",)], "t string").select(outline.join_wrapped(F.col("t")).alias("l")).collect()
    assert [r.l for r in joined] == [["The first goes on", "Second line, Third category", "End"], None, []]


def slow_merge(sizes, most):
    groups = [[i] for i in range(len(sizes))]
    while len(groups) > max(1, most):
        weights = [sum(sizes[i] for i in g) for g in groups]
        at = min(range(len(groups) - 1), key=lambda i: (weights[i] + weights[i + 1], i))
        groups[at] += groups.pop(at + 1)
    return [g for g, members in enumerate(groups) for _ in members]


def test_merging_units_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 5, 14, 40):
        for most in (1, 3, 12):
            sizes = rng.integers(1, 6, n).tolist()
            assert outline.merge_to_most(sizes, most) == slow_merge(sizes, most)
    rows = spark.createDataFrame([("d", i, 1) for i in range(4)] + [("e", i, int(s)) for i, s in enumerate([5, 1, 1, 9])], "document_id string, ordinal int, size int")
    got = {(r.document_id, r.ordinal): r.group for r in outline.capped(rows, 3).collect()}
    assert [got["e", i] for i in range(4)] == [0, 1, 1, 2] and [got["d", i] for i in range(4)] == [0, 0, 1, 2]


def test_headings(spark):
    titles = ["Unit 2.4 Surfaces", "UNIT II Graphs", "Chapter 3: Trees", "3. Trees", "2.303 RT/F", "1.2 Ohm and 3 x 4", "Unit 5", "Part", "0.0591 V"]
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in titles], "t string").select("t", outline.is_chapter(t).alias("c"), outline.chapter_title(t).alias("title"), outline.major_unit(t).alias("u"), outline.is_section_title(t).alias("s")).collect()
    assert [r.c for r in rows] == [False, True, True, True, False, False, True, False, False]
    assert [r.title for r in rows][1:4] == ["Graphs", "Trees", "3. Trees"] and [r.u for r in rows] == [2, None, None, None, None, 1, 5, None, None]
    assert [r.s for r in rows] == [True, True, True, True, False, False, True, True, False]


def test_outline_checks(spark):
    schema = "document_id string, unit_id string, title string, page_start int, page_end int"
    rows = [("good", str(u), f"Topic {u}", 10 * u, 10 * u + 4) for u in range(3)] + [("bucket", "1", f"Notes pages {i}-{i + 9}", i, i + 9) for i in (1, 11, 21)] + [("few", "1", "Alone", 1, 2)]
    out = {r.document_id: (r.valid, r.granularity, r.quality) for r in outline.outline_checks(spark.createDataFrame(rows, schema)).collect()}
    assert out == {"good": (True, "chapter", "high"), "bucket": (False, "section", "low"), "few": (False, "section", "low")}
    short = spark.createDataFrame([("d", "1", "A", 1, 1), ("d", "1", "B", 2, 2), ("d", "1", "1.3 C", 3, 3), ("d", "1", "D", 4, 9), ("d", "1", "E", 10, 10), ("d", "2", "F", 1, 1)], schema)
    assert sorted((r.unit_id, r.title, r.page_start, r.page_end) for r in outline.merge_short(short).collect()) == [("1", "1.3 C", 3, 3), ("1", "A", 1, 2), ("1", "D", 4, 10), ("2", "F", 1, 1)]


def test_tiers(spark):
    tier = lambda *x: spark.range(1).select(readers.audit_tier(*map(F.lit, x))).first()[0]
    assert [tier(0.8, 0.0, 0.0), tier(0.3, 0.4, 0.0), tier(0.6, 0.4, 0.0), tier(0.1, 0.0, 0.4), tier(0.1, 0.1, 0.1)] == ["ocr", "layout_defer", "ocr", "ocr", "native"]
    after = lambda *x: spark.range(1).select(readers.reconciled_tier(*map(F.lit, x))).first()[0]
    assert [after("native", 0.0, 10, 0, 0), after("layout_defer", 0.0, 10, 2, 9), after("native", 0.0, 10, 2, 9), after("native", 0.4, 10, 0, 9), after("native", 0.0, 10, 0, 9)] == ["ocr", "layout_defer", "ocr", "layout_defer", "native"]
    columns = lambda xs, w: spark.range(1).select(readers.looks_multi_column(F.array(*map(F.lit, xs)), F.lit(w))).first()[0]
    assert columns([100.0] * 4 + [500.0] * 4, 600.0) and not columns([100.0] * 4 + [300.0] * 4, 600.0) and not columns([100.0] * 3 + [500.0] * 4, 600.0)


def test_keyphrases(spark):
    prompts = [("q1", "s", "Explain the Finite State Machine (FSM) and why FSM minimisation matters"), ("q2", "s", "  "), ("q3", "s", None), ("q4", "s", "NOISE noise of noise")]
    rows = spark.createDataFrame([(*r, "x") for r in prompts], "question_id string, scope string, prompt_text string, score string")
    out = {}
    for r in concepts.extract(rows).collect():
        out.setdefault(r.question_id, {})[r.phrase] = r.score
    assert set(out) == {"q1", "q4"} and len(out["q1"]) == 8 and "fsm" not in out["q1"] and all(0 < s <= 1 for s in out["q1"].values())
    # three uses at 0, 6 and 15: the mean over all, divided by their number, for a capital
    assert out["q4"]["noise"] == pytest.approx((1 + 1 / np.log2(8) + 1 / np.log2(17)) / 3 / 3 * 1.5 / 2.5, abs=1e-6)
    assert out["q4"]["noise noise noise"] == pytest.approx(min(1.0, 1.5 * 1.7 / 2.5))
    assert concepts.extract(rows.where("false")).count() == 0


def slow_leaders(vectors, merge):
    leaders, out = [], []
    for v in vectors:
        scores = [float(c @ v / (np.linalg.norm(c) * np.linalg.norm(v))) for c in leaders]
        best = max(range(len(scores)), key=lambda i: (scores[i], -i), default=-1)
        if best >= 0 and scores[best] >= merge:
            leaders[best] = (leaders[best] + v) / 2
        else:
            leaders.append(v)
            best = len(leaders) - 1
        out.append(best)
    return out


def test_clusters(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((20, 8))[rng.integers(0, 20, 300)] + 0.2 * rng.standard_normal((300, 8))
    assert concepts.leader_clusters(vectors).tolist() == slow_leaders(vectors, concepts.MERGE)
    rows = [(f"q{i}", "many", "binary search tree" if i % 2 else "binary search trees", 0.5 + i / 100) for i in range(6)] + [("a", "few", "binary search tree", 0.9), ("b", "few", "binary search trees", 0.8)]
    frame = spark.createDataFrame(rows, "question_id string, scope string, phrase string, score double")
    out = {(r.scope, r.phrase): r.cluster for r in concepts.cluster(frame).collect()}
    assert out["few", "binary search tree"] != out["few", "binary search trees"]
    named = {(r.scope, r.label): list(r.terms) for r in concepts.labelled(concepts.cluster(frame)).collect()}
    assert ("few", "Binary Search Tree") in named and all(label == label.title() for _, label in named)


def test_labels(spark):
    noise = ["tree", "explain binary trees", "heap of", "properties applications", "ab cd ef", "constituents composites", "go go run run", "hash map"]
    fine = ["binary trees", "reverse osmosis plant", "edta titration", "brief notes about binary trees"]
    rows = spark.createDataFrame([(x,) for x in noise + fine], "p string").select("p", labels.is_noise(F.col("p")).alias("n"), labels.polished(F.col("p")).alias("l"), labels.rebuilt(F.col("p")).alias("r")).collect()
    assert [r.p for r in rows if r.n] == noise and [r.p for r in rows if not r.n] == fine
    assert spark.range(1).select(labels.polished(F.lit("and the of binary  trees"))).first()[0] == "Binary Trees"
    assert {r.p: r.r for r in rows}["constituents composites"] == "Composites" and {r.p: r.r for r in rows}["tree"] is None
    terms = spark.createDataFrame([("s", 1, "explain binary trees", 0.9), ("s", 1, "balanced binary trees", 0.2), ("s", 2, "composites constituents", 0.5), ("s", 3, "tree", 0.4)], "scope string, cluster int, phrase string, score double")
    assert {r.cluster: r.label for r in labels.cluster_labels(terms).collect()} == {1: "Balanced Binary Trees"}
    titles = spark.createDataFrame([("s", "balanced binary trees", "Search Trees", 0.8), ("s", "tree", "Trees and Graphs", 0.5)], "scope string, phrase string, title string, similarity double")
    assert {r.cluster: r.label for r in labels.cluster_labels(terms, titles).collect()} == {1: "Search Trees"}


def test_concept_links_sum_to_one(spark):
    questions = spark.createDataFrame([("q1", "c"), ("q2", "c")], "question_id string, scope string")
    phrases = spark.createDataFrame([("q1", "c", "x", 0.6), ("q1", "c", "y", 0.2), ("q1", "c", "z", 0.05)], "question_id string, scope string, phrase string, score double")
    terms = spark.createDataFrame([("c", "x", "X"), ("c", "y", "Y"), ("c", "z", "Z")], "scope string, phrase string, concept string")
    out = {(r.question_id, r.concept): round(r.weight, 6) for r in concepts.concept_links(questions, phrases, terms).collect()}
    assert out == {("q1", "X"): 0.75, ("q1", "Y"): 0.25, ("q2", "Unclassified"): 1.0}


def test_tie_band_prefers_the_deeper_node(spark):
    row = spark.createDataFrame([([(0, "u", 1, 0.9), (1, "t", 3, 0.89), (2, "p", 2, 0.89)],)], "s array<struct<ordinal int, node_id string, depth int, score double>>")
    assert row.select(concepts.tie_band_match(F.col("s"))).first()[0] == "t"


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("page one\fshort")
    pages = readers.read_pages(spark, str(tmp_path), ocr=lambda b: ["", "a scanner read much more than that here"], pattern="*.txt").orderBy("page").collect()
    assert [(r.page, r.used_ocr) for r in pages] == [(1, False), (2, True)]
    assert readers.pages_of(b"", lambda b: 1 / 0, None)[0]["text"] is None
    outlines = readers.outline_frame(spark, [{"document": "d", "course": "c", "page_index_base": 0, "page_count": 9, "units": [{"id": "1", "title": "U", "page_start": 0, "page_end": 4, "sections": [{"title": "S", "page_start": 1, "page_end": 2}]}]}])
    row = readers.outline_sections(outlines).first()
    assert (row.page_start, row.page_end, row.toc_path) == (2, 3, "U > S")
    (tmp_path / "g.json").write_text(json.dumps({"a": 1}))
    assert readers.load_mapping(str(tmp_path / "g.json")) == {"a": 1}
