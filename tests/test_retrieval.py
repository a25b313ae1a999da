"""Boosts, hints and the hybrid plan on small hand-made rows."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import analytics, hints, ranking, retrieval, search


def value(spark, column, **row):
    names = {k: v for k, v in row.items()}
    frame = spark.range(1).select(*(v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in names.items()))
    return frame.select(column).first()[0]


def test_focus_and_query_terms(spark):
    focus = fn.focus_terms(F.lit("What is the Syntax of a short-circuit; explain Syntax and bnf using trees"), ["short-circuit", "bnf rule"])
    assert value(spark, focus) == ["syntax", "short-circuit", "bnf", "trees"]
    assert value(spark, fn.query_terms(F.array(F.lit("short-circuit"), F.lit("a-b"), F.lit("trees")))) == ["shortcircuit", "trees"]
    assert value(spark, fn.query_terms(F.array(F.lit("trees")), 2)) == []
    assert value(spark, fn.terms(F.lit("Étude 2 по Дереву"))) == ["étude", "2", "по", "дереву"]


def test_bonuses(spark):
    wanted = F.array(F.lit("stack"), F.lit("queue"), F.lit("heap"))
    assert value(spark, ranking.lexical_bonus(F.lit("a stack and a queue"), wanted, F.lit("parent"))) == pytest.approx(0.05 + 0.1 * 2 / 3 + 0.05)
    assert value(spark, ranking.lexical_bonus(F.lit("a stack and a queue"), wanted, F.lit(""))) == pytest.approx(0.05 + 0.1 * 2 / 3)
    assert value(spark, ranking.lexical_bonus(F.lit("stack queue heap"), wanted, F.lit("x"))) == pytest.approx(0.18)
    assert value(spark, ranking.phrase_bonus(F.lit("On Lazy Evaluation"), F.lit("lazy evaluation delays"), {"lazy evaluation": 0.08, "eager": 0.2})) == pytest.approx(0.08)
    rules = [(["prove"], ["grammar", "ambiguous"], 0.14), (["prove"], [], 0.1)]
    rescue = lambda score, body: value(spark, ranking.rescue_bonus(F.lit(score), F.lit("Prove it"), F.lit(body), rules))
    assert (rescue(0.34, "an ambiguous grammar"), rescue(0.34, "none"), rescue(0.35, "an ambiguous grammar")) == (0.14, 0.1, 0.0)


def ranges(*pairs):
    return F.array(*(F.struct(F.lit(a).alias("page_start"), F.lit(b).alias("page_end")) for a, b in pairs))


def test_hints_move_the_score(spark):
    units, pages = F.array(F.lit("2"), F.lit("1")), ranges((10, 12), (30, 31))
    demoted = lambda page, unit: value(spark, ranking.section_demotion(F.lit(page), F.lit(unit).cast("string"), units, pages))
    assert [demoted(p, u) for p, u in ((11, "7"), (13, "2"), (15, "2"), (22, "2"), (13, "7"), (42, "7"))] == [0.0, 0.0, 0.05, 0.05, 0.06, 0.08]
    wanted = F.array(F.lit("tree"), F.lit("graph"))
    bonus = lambda **k: value(spark, ranking.metadata_bonus(F.lit(k.get("score", 0.5)), wanted, F.lit(k["page"]), F.lit(k.get("unit")).cast("string"), F.lit(k.get("section")).cast("string"), F.lit(k.get("toc")).cast("string"), F.lit(k.get("hits", 0)), units, pages))
    assert bonus(page=20, unit="9") == 0.0
    assert bonus(page=20) == pytest.approx(-0.08)
    assert bonus(page=2, unit="1", section="Tree walks") == pytest.approx(-0.08 + 0.03 + 0.02 + 0.02)
    assert bonus(page=11, unit="2", hits=1, score=0.4) == pytest.approx(0.03 + 0.06 + 0.03)
    assert bonus(page=11, unit="2", section="tree graph", hits=2, score=0.4) == pytest.approx(0.18)


def test_rerank_text_and_gate(spark):
    read = lambda b, p: value(spark, ranking.rerank_text(F.lit(b).cast("string"), F.lit(p).cast("string")))
    assert (read(" b ", None), read("b", "abc"), read("abc", "b"), read("x", "y" * 1600)) == ("b", "abc", "abc", "x\n\n" + "y" * 1500)
    assert [value(spark, ranking.gate_threshold(F.lit(m).cast("string"))) for m in ("study", "exam", None)] == [0.35, 0.25, 0.35]
    text = F.lit("x" * 50 + "stack" + "x" * 45)
    page = lambda wanted, **k: value(spark, ranking.estimate_page(text, F.array(F.lit(wanted)), F.lit(k.get("a", 2)), F.lit(k.get("b", 12)), F.lit(4), k.get("r")))
    assert (page("stack"), page("none"), page("stack", b=2), page("stack", r=ranges((9, 20))), page("stack", r=ranges((30, 40)))) == (7, 4, 4, 9, 7)


OUTLINE = "scope string, unit_id string, unit_title string, section_title string, page_start int, page_end int"


def test_outline_hints(spark):
    outline = spark.createDataFrame([("c", "1", "Sets and maps", "Hash maps", 3, 5), ("c", "1", "Sets and maps", "Ordered sets", 6, 9), ("c", "2", "Graph theory", "Shortest paths in graphs", 10, 14), ("d", "1", "Hash", None, None, None)], OUTLINE)
    questions = spark.createDataFrame([("q", "c", "How do hash maps grow, and ordered trees?"), ("r", "c", "Nothing here"), ("n", "c", None), ("o", "d", "hash maps")], "query_id string, scope string, text string")
    assert {(r.query_id, r.unit_id, r.score, r["rank"]) for r in hints.infer_units(questions, hints.unit_phrases(outline), hints.unit_terms(outline)).collect()} == {("q", "1", 13.0, 1), ("o", "1", 3.0, 1)}
    assert {tuple(r) for r in hints.page_ranges(questions, hints.page_hints(outline)).collect()} == {("q", 3, 5), ("o", None, None)}
    both = {r.query_id: (r.units, [tuple(x) for x in r.ranges]) for r in retrieval.outline_hints(questions.where("query_id = 'q'"), outline).collect()}
    assert both == {"q": (["1"], [(3, 5)])}


def test_pages_of_sections(spark):
    outline = spark.createDataFrame([("c", "1", "Sets", "Hash maps", 1, 2), ("c", "2", "Trees", "Balanced search trees", 3, 4)], OUTLINE)
    filler = " and so on" * 12
    pages = spark.createDataFrame([("c", "f", 1, "hash maps" + filler), ("c", "f", 1, "hash maps" + filler), ("c", "f", 2, "hash maps or balanced search trees" + filler), ("c", "f", 3, "none" + filler), ("c", "f", 4, "trees"), ("d", "g", 1, "trees" + filler)], "scope string, file string, page int, text string")
    assert {tuple(r) for r in hints.page_counts(pages, outline).collect()} == {("c", "1", "Hash maps", 1), ("c", "2", "Balanced search trees", 1), ("c", "1", "Unclassified", 1), ("d", "general", "Unclassified", 1)}


def test_hybrid_stays_in_its_course(spark):
    docs = spark.createDataFrame([("d1", "c", "a.pdf", "notes", "ready"), ("d2", "e", "b.pdf", "notes", "ready"), ("d3", "c", "c.pdf", "notes", "failed"), ("d4", "c", "p.pdf", "past_paper", "ready"), ("d5", None, "x", "notes", "ready")], "document_id string, course_id string, filename string, doc_kind string, status string")
    rows = [("k1", "d1", "p1", 0, 3, "a stack holds what a queue holds", {"unit": "1", "section_title": "Stacks"}), ("k2", "d1", None, 1, 4, "nothing of the kind", None), ("k3", "d2", None, 0, 1, "stack queue", None), ("k4", "d3", None, 0, 1, "stack queue", None), ("k5", "d4", None, 0, 1, "stack queue", None), ("k6", "d5", None, 0, 1, "stack queue", None), ("k1", "d1", "p1", 0, 3, "a stack holds what a queue holds", {"unit": "1"})]
    chunks = spark.createDataFrame(rows, "chunk_id string, document_id string, parent_id string, chunk_index int, page int, text string, metadata map<string,string>")
    scoped = retrieval.scoped_chunks(chunks, docs, ("notes",))
    assert {r.id for r in scoped.collect()} == {"k1", "k2", "k3"}
    assert {r.id for r in retrieval.scoped_chunks(chunks, docs, ("notes",), docs.where("document_id = 'd2'")).collect()} == {"k3"}
    vectors = spark.createDataFrame([("k1", [1.0, 0.0]), ("k2", [0.0, 1.0]), ("k3", [1.0, 0.0]), ("k5", [1.0])], "id string, vector array<float>")
    questions = spark.createDataFrame([("q", "c", "stack queue", [1.0, 1.0]), ("none", "z", "stack", None)], "query_id string, scope string, text string, vector array<float>")
    hits = retrieval.hybrid(questions, scoped, vectors).orderBy("rank").collect()
    assert [(r.query_id, r.id, r.n_lists) for r in hits] == [("q", "k1", 3), ("q", "k2", 1)]
    assert hits[0].fused == pytest.approx(1 / 61 + 1 / 61 + 1.1 / 61, abs=1e-9) and hits[1].vector_score == pytest.approx(0.707107)
    parents = spark.createDataFrame([("p1", "d1", 3, 6, "x" * 100 + "stack" + "x" * 95, None)], "parent_id string, document_id string, page_start int, page_end int, text string, metadata map<string,string>")
    outline = spark.createDataFrame([("c", "1", "Unit 1", "Stacks", 3, 4)], OUTLINE)
    ranked = retrieval.rerank(retrieval.with_parents(retrieval.hybrid(questions, scoped, vectors), scoped, parents), questions, retrieval.outline_hints(questions, outline), F.lit(0.0))
    context, status = retrieval.answerable(questions, ranked, 0.5, 20)
    ranked = ranked.orderBy("rank").collect()
    assert [(r.id, r.page) for r in ranked] == [("k1", 5), ("k2", 4)] and ranked[0].score > ranked[1].score
    assert {r.query_id: r.status for r in status.collect()} == {"q": "ok", "none": "not_in_materials"}
    assert {r.id: r.kept for r in context.collect()} == {"k1": 80, "k2": 0}
    empty = retrieval.hybrid(questions.where("false"), scoped, vectors)
    assert empty.count() == 0


def test_any_density_counts_places(spark):
    texts = spark.createDataFrame([("a", "tree tree leaf"), ("b", "leaf"), ("c", None), ("d", "")], "id string, text string")
    asked = spark.createDataFrame([("q", "tree"), ("q", "leaf"), ("q", "tree"), ("q", None)], "query_id string, term string")
    assert [(r.id, r.score) for r in search.any_density(asked, texts).orderBy("rank").collect()] == [("a", 0.3), ("b", 0.1)]


def test_unit_and_topic_predictions(spark):
    rows = [(f"q{i}", "c", label, number, unit, i) for i, (label, number, unit) in enumerate([("May 2020", "1", "I"), ("May 2021", "1", "I"), ("May 2021", "2", "I"), ("May 2020", "2", "II"), ("May 2020", "3", None), ("Paper", "1", "I")])]
    q = spark.createDataFrame(rows, "question_id string, scope string, paper_label string, question_number string, unit string, page int")
    out = {r.label: (r.weightage_pct, r.recurrence_rate, r.trend_slope) for r in analytics.unit_features(q).collect()}
    assert out == {"I": (66.7, 1.0, 1.0), "II": (16.7, 0.5, None)}
    topics = spark.createDataFrame([("c", "T", 4), ("c", "U", 1), ("c", " ", 4)], "scope string, topic string, n long")
    assert {r.label: (r.weightage_pct, r.recurrence_rate) for r in analytics.topic_features(topics).collect()} == {"T": (100.0, 1.0), "U": (25.0, 0.25)}
    units = analytics.unit_features(q)
    structure = units.where("label = 'II'").withColumn("label", F.lit("Trees"))
    made = analytics.all_predictions(units, units, analytics.topic_features(topics), structure, top_units=1).collect()
    assert [(r.label, r["rank"]) for r in made if r.kind == "unit"] == [("Trees", 1)] and len([r for r in made if r.kind == "topic"]) == 2
