"""Search, fusion and ranking against brute force and hand-made cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.vectors import cosine
from lectern.operators import ranking, search


def test_vector_topk_is_exact(spark):
    random = np.random.default_rng(1)
    vectors = random.standard_normal((60, 8)).round(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)] + [(100, None), (101, [0.0] * 8), (102, [1.0]), (103, [float("nan")] * 8)]
    table = spark.createDataFrame(rows, "id long, vector array<float>")
    got = {}
    for r in search.vector_topk(table.where("id < 5").withColumnRenamed("id", "query_id"), table, 4, exclude_self=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    units = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for q in range(5):
        order = [int(i) for i in np.argsort(-(units @ units[q]), kind="stable") if i != q][:4]
        assert [i for _, i in sorted(got[q])] == order


def test_vector_topk_without_queries(spark):
    table = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    assert search.vector_topk(table.where("id > 1").withColumnRenamed("id", "query_id"), table).count() == 0


def test_cosine(spark):
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    out = row.select(cosine(F.col("a"), F.col("b")), cosine(F.col("a"), F.col("z"))).first()
    assert out[0] == pytest.approx(2**-0.5) and out[1] == 0.0


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([("a", "red green red"), ("b", "green"), ("c", None), ("d", ""), ("e", "blue red green")], "id string, text string")


def test_bm25_needs_all_terms_when_asked(spark, texts):
    asked = spark.createDataFrame([("q", "red"), ("q", "green"), ("q", "red"), ("q", None)], "query_id string, term string")
    assert {r.id for r in search.bm25(asked, texts).collect()} == {"a", "b", "e"}
    assert {r.id for r in search.bm25(asked, texts, require_all=True).collect()} == {"a", "e"}


def test_cover_density():
    assert search.covers_score([[0, 10], [1]]) == pytest.approx(0.1 + 0.1 / 9)
    assert search.covers_score([[3]]) == 0.1


def test_fusion_sums_reciprocal_ranks(spark):
    schema = "query_id string, id string, rank int"
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], schema)
    b = spark.createDataFrame([("q", "y", 1)], schema)
    out = {r.id: (r.fused, r["rank"]) for r in search.fuse([(a, 1.0), (b, 0.5)]).collect()}
    assert out["y"] == (round(1 / 62 + 0.5 / 61, 10), 1) and out["x"] == (round(1 / 61, 10), 2)


def test_merge_hits_keeps_the_larger_and_drops_zero(spark):
    schema = "id string, score double"
    out = {r.id: r for r in search.merge_hits(spark.createDataFrame([("x", 0.2), ("x", 0.4), ("y", 0.0)], schema), spark.createDataFrame([("x", 0.3)], schema)).collect()}
    assert (out["x"].match_score, out["y"].lexical_score, out["y"].match_score) == (0.4, None, None)


def test_gate(spark):
    hits = spark.createDataFrame([("a", 1, 0.35), ("a", 2, 0.9), ("b", 1, 0.2), ("c", 1, None)], "query_id string, rank int, score double")
    assert {r.query_id for r in ranking.confidence_gate(hits, 0.35).collect()} == {"a"}
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "query_id string")
    status = {r.query_id: r.reason for r in ranking.gate_status(asked, hits, 0.35).collect()}
    assert status == {"a": None, "b": "below_threshold", "c": "below_threshold", "d": "empty_corpus"}


def test_context_budget_cuts_and_empties(spark):
    hits = spark.createDataFrame([("q", 1, "a", "x" * 6), ("q", 2, "b", "y" * 6), ("q", 3, "c", "z"), ("q", 4, "d", None)], "query_id string, rank int, id string, text string")
    out = {r.id: (r.kept, r.text) for r in ranking.context_budget(hits, 2).collect()}
    assert out == {"a": (6, "x" * 6), "b": (2, "yy"), "c": (0, ""), "d": (0, None)}


def test_text_functions(spark):
    row = spark.createDataFrame([("  What is the  Binary Tree in Python? ", "Q1 (20 marks) May 2021", "12(b)")], "a string, b string, c string")
    out = row.select(fn.focus_terms(F.col("a")), fn.normalise(F.col("a")), fn.year_of(F.col("b")), fn.main_number(F.col("c")), fn.is_subpart(F.col("c")), fn.token_count(F.lit(None).cast("string"))).first()
    assert list(out) == [["binary", "tree", "python"], "what is the binary tree in python?", 2021, "12", True, 1]


def test_metadata_search_reads_the_contents_path(spark, tmp_path):
    from lectern.queries import queries

    chunks = [("t", {"section_title": "Graph colouring"}), ("p", {"toc_path": "Unit 2 > Graph colouring"}), ("b", {"section_title": "Planar", "toc_path": "Graph"}), ("o", {"page": "graph"}), ("n", None)]
    spark.createDataFrame(chunks, "chunk_id string, metadata map<string,string>").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([("x", "Graph theory")], "course_id string, name string").write.parquet(f"{tmp_path}/courses.parquet")
    assert {r.id for r in queries()["metadata_search"](spark, str(tmp_path)).collect()} == {"t", "p", "b"}
