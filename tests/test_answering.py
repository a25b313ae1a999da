"""Prompts, sources, questions for concepts, topics to units, concepts to nodes."""

from pyspark.sql import functions as F

from lectern.operators import answering


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def words(*terms):
    return F.array(*(F.lit(t).cast("string") for t in terms)) if terms else F.array().cast("array<string>")


def test_excerpts_and_lengths(spark):
    cut = value(spark, answering.excerpt(F.lit("t"), F.lit("x" * 398 + "  yy")))
    assert cut == "x" * 398 + "…" and value(spark, answering.excerpt(F.lit("t"), F.lit(""))) == "t" and value(spark, answering.excerpt(F.lit("t"), F.lit(None).cast("string"))) == "t"
    assert [tuple(value(spark, answering.answer_length(F.lit(m).cast("int")))) for m in (9, 8, 4, 3, None)] == [("quality", "long")] * 2 + [("balanced", "medium")] + [("budget", "short")] * 2
    assert [value(spark, answering.answer_tier(F.lit(a), F.lit(b))) for a, b in ((False, True), (True, False), (True, True))] == [1, 2, 3]


def test_prompts(spark):
    questions = spark.createDataFrame([("q", "Why?", "study"), ("r", "What?", "poem"), ("s", "How?", "exam")], "query_id string, text string, preset string")
    hits = spark.createDataFrame([("q", 2, "b.pdf", 7, "child b", None), ("q", 1, "a.pdf", 3, "child a", "parent a"), ("q", 9, "c.pdf", 1, "late", None), ("r", 1, "a.pdf", 3, "x", None)], "query_id string, rank int, filename string, page int, text string, parent_text string")
    out = {r.query_id: (r.n_parents, r.prompt) for r in answering.prompts(questions, hits).collect()}
    assert out == {"q": (2, "Excerpts:\n\n--- a.pdf (page 3) ---\nparent a\n\n--- b.pdf (page 7) ---\nchild b\n\nQuestion: Why?")}
    full = hits.select("*", F.lit("i").alias("id"), F.lit("d").alias("document_id"), F.lit(0.5).alias("score"))
    assert [(r["rank"], r.excerpt) for r in answering.sources(full.where("query_id = 'q'")).orderBy("rank").collect()] == [(1, "parent a"), (2, "child b"), (9, "late")]


def test_questions_for_concepts(spark):
    terms = answering.ordered_terms(F.lit("Binary  Tree"), words("binary tree", None, "BST", ""), words("bst", "search tree"))
    assert value(spark, terms) == ["Binary Tree", "BST", "search tree"]
    assert value(spark, answering.concept_question(F.lit("Tree"), words("a1", "a2", "a3", "a4", "a5"), words())) == "Explain Tree (also: a1, a2, a3, a4). Use course notes and syllabus."
    assert value(spark, answering.concept_question(F.lit("Tree"), words(), words("tree"))) == "Explain Tree. Use course notes and syllabus."
    assert value(spark, answering.concept_question(F.lit(None).cast("string"), words(), words())) == "Explain this topic. Use course notes and syllabus."
    assert value(spark, answering.question_terms(F.lit(" What  IS it"), words("It", "what is it"))) == ["what is it", "it"]


def test_topics_to_units(spark):
    topics = spark.createDataFrame([("p", "t2", 2, "Zeta"), ("p", "t1", 1, "Alpha"), ("s", "t3", 1, "graphs"), ("s", "t4", 2, "Nothing"), ("s", "t5", 3, "Sorting and searching")], "scope string, topic_id string, ordinal int, title string")
    units = spark.createDataFrame([("p", 0, "One"), ("p", 1, "Two"), ("s", 0, "Sorting"), ("s", 1, "Graphs and trees"), ("s", 2, "More graphs"), ("s", 3, "x-ray")], "scope string, unit_no int, title string")
    matched = answering.match_topics(topics, units)
    assert {(r.topic_id, r.unit_no) for r in matched.collect()} == {("t1", 0), ("t2", 1), ("t3", 1), ("t5", 0)}
    documents = spark.createDataFrame([("d1", "t3"), ("d2", "t3"), ("d3", "t5"), ("d4", None), ("syl", "t3")], "document_id string, topic_id string")
    out = {(r.scope, r.unit_no): r.document_ids for r in answering.unit_documents(matched, documents, documents.where("document_id = 'syl'")).collect()}
    assert out == {("s", 1): ["d1", "d2"], ("s", 0): ["d3"]}


def test_concepts_to_nodes(spark):
    nodes = spark.createDataFrame([("s", 1, "u", "Trees", 1), ("s", 2, "t", "Binary trees", 3), ("s", 3, "g", "Graphs", 1)], "scope string, ordinal int, node_id string, title string, depth int")
    concepts = spark.createDataFrame([("s", "c1", ["trees"]), ("s", "c2", ["maps", "ab"]), ("s", "c3", ["paths"]), ("z", "c4", ["trees"])], "scope string, concept string, terms array<string>")
    similar = spark.createDataFrame([("s", "c3", "g", 0.8), ("s", "c2", "g", 0.7)], "scope string, concept string, node_id string, similarity double")
    assert {(r.concept, r.node_id) for r in answering.map_to_nodes(concepts, nodes, similar).collect()} == {("c1", "t"), ("c2", None), ("c3", "g"), ("c4", None)}
    assert {(r.concept, r.node_id) for r in answering.map_to_nodes(concepts, nodes).collect()} == {("c1", "t"), ("c2", None), ("c3", None), ("c4", None)}
