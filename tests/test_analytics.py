"""Concept facts, predictions and frequencies on hand-made rows."""

from decimal import Decimal

import pytest

from lectern.operators import analytics

Q = "question_id string, scope string, marks int, paper_label string, unit string, section_title string, question_number string, page int, prompt_text string"


@pytest.fixture
def questions(spark):
    rows = [
        ("q1", "c", 10, "May 2021", "I", "A", "1", 1, "long one"),
        ("q2", "c", 2, "May 2022", "I", "A", "2", 1, "short"),
        ("q3", "c", 2, "May 2022", None, None, "3", 2, None),
    ]
    return spark.createDataFrame(rows, Q)


@pytest.fixture
def links(spark):
    rows = [("q1", "A", 1.0), ("q2", "A", 1.0), ("q1", "B", 0.5), ("q3", "Unclassified", 1.0), ("q1", "A", 0.25)]
    return spark.createDataFrame([(q, c, Decimal(str(w))) for q, c, w in rows], "question_id string, concept string, weight decimal(9,3)")


def test_concept_facts(questions, links):
    facts = {r.concept: r for r in analytics.concept_facts(questions, links).collect()}
    a = facts["A"]
    assert (a.question_count, a.marks_total, a.long_count, a.short_count, a.paper_reach) == (2.0, 12.0, 1, 1, 2)
    assert a.weightage_pct == pytest.approx(85.71) and a.trend_slope == 0.0 and a.last_year == 2022
    assert facts["B"].marks_total == 5.0 and facts["B"].trend_slope is None


def test_no_questions(spark, links):
    assert analytics.concept_facts(spark.createDataFrame([], Q), links).count() == 0


def test_ranked_page(questions, links):
    facts = analytics.concept_facts(questions, links)
    assert [(r.concept, r["rank"]) for r in analytics.ranked_page(facts, "label_asc", 1, 1).collect()] == [("B", 2)]
    assert [r.concept for r in analytics.ranked_page(facts, "weightage_desc", 0, 9).orderBy("rank").collect()] == ["A", "B", "Unclassified"]


def test_predictions(spark):
    rows = [("c", "x", 50.0, 1.0, 2.0), ("c", "y", 30.0, 0.75, 0.0), ("c", "z", 10.0, 0.25, -1.0)]
    out = analytics.predictions(spark.createDataFrame(rows, "scope string, label string, weightage_pct double, recurrence_rate double, trend_slope double")).orderBy("rank").collect()
    assert [r.score for r in out] == [1.0, 0.5992, 0.1775]
    assert out[0].reasons == ["high_weightage", "recurs_across_papers", "rising_trend"]


def test_predictions_without_slopes(spark):
    out = analytics.predictions(spark.createDataFrame([("c", "x", 0.0, None, None)], "scope string, label string, weightage_pct double, recurrence_rate double, trend_slope double")).first()
    assert (out.score, out.reasons) == (0.0, [])


def test_unclassified_only(questions, links):
    row = analytics.unclassified_only(questions, links, "Unclassified").first()
    assert (row.n_questions, row.unclassified_only, row.unclassified_pct) == (3, 1, 33.33)


def test_subparts_count_alone(spark):
    rows = [("q1", "c", 1, "May 2020", "I", "A", "1", 1, ""), ("q2", "c", 1, "May 2020", "I", "A", "1(a)", 1, ""), ("q3", "c", 1, "May 2020", "II", "B", "1 b.", 1, "")]
    out = {r.unit: r for r in analytics.unit_frequency(spark.createDataFrame(rows, Q)).collect()}
    assert {u: (r.n_rows, r.n_mains) for u, r in out.items()} == {"I": (1, 0), "II": (1, 1)}  # "1 b." sorts before "1(a)"


def test_topic_frequency_levels(questions):
    out = {(r.unit, r.section, r.level): r.n for r in analytics.topic_frequency(questions).collect()}
    assert out[("I", None, "unit")] == 2 and out[("general", "Unclassified", "section")] == 1


def test_best_prompt_breaks_ties_by_id(questions, links):
    best = {r.concept: r.question_id for r in analytics.best_prompt(questions, links.select("question_id", "concept").distinct()).collect()}
    assert best == {"A": "q1", "B": "q1", "Unclassified": "q3"}
