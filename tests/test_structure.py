"""Chunking, lookups, hierarchy, sequences, scope, evaluation and jobs."""

from decimal import Decimal

from pyspark.sql import functions as F

from lectern.operators import chunking, evaluation, hierarchy, lookup, scope, sequences
from lectern.operators.components import components
from lectern.operators.running import running_sum
from lectern.streaming import jobs


def test_running_sum_equals_a_window(spark):
    rows = spark.createDataFrame([(k, i, (i * 7) % 5) for k in ("a", None) for i in range(50)], "k string, i int, v int")
    out = running_sum(rows, ["k"], F.col("i") / 8, ["i"], F.col("v"), "before").collect()
    for k in ("a", None):
        total = 0
        for r in sorted((r for r in out if r.k == k), key=lambda r: r.i):
            assert r.before == total
            total += r.v
    assert running_sum(rows.where("false"), ["k"], F.col("i"), ["i"], F.col("v"), "before").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (5, 5), (4, 3)] + [(100 + i, 101 + i) for i in range(40)], "a long, b long")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert {labels[i] for i in (1, 2, 3, 4)} == {1} and labels[11] == 10 and {labels[100 + i] for i in range(41)} == {100} and 5 not in labels


def test_windows(spark):
    texts = spark.createDataFrame([("a", " ".join(str(i) for i in range(25))), ("b", "  just three words "), ("c", None), ("d", " \n ")], "id string, text string")
    out = chunking.windows(texts, F.lit(10), F.lit(0.2)).orderBy("id", "window").collect()
    assert [(r.id, r.window, r.token_count) for r in out] == [("a", 0, 10), ("a", 1, 10), ("a", 2, 9), ("b", 0, 3)]
    assert out[1].text.split()[0] == "8" and out[-1].text == "just three words"


def test_parent_groups_follow_the_budget(spark):
    sizes = [300, 900, 200, 1400, 10, 5]
    pages = spark.createDataFrame([("d", i + 1, "w " * n) for i, n in enumerate(sizes)] + [("d", 9, ""), ("d", 10, None)], "document_id string, page int, text string")
    out = {r.page: r.group_no for r in chunking.parent_groups(pages, F.lit(1350)).collect()}
    assert [out[i + 1] for i in range(6)] == [0, 0, 1, 2, 3, 3] and len(out) == 6


def test_merge_metadata_later_non_null_wins(spark):
    row = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "9", "b": None})], "x map<string,string>, y map<string,string>")
    assert row.select(chunking.merge_metadata(F.col("x"), F.col("y"))).first()[0] == {"a": "9", "b": "2"}


def test_first_chunk_keeps_the_best_hit(spark):
    hits = spark.createDataFrame([("h1", "d", 1, 0.5), ("h2", "d", 1, 0.9), ("h3", "d", 7, 1.0)], "hit_id string, document_id string, page int, score double")
    chunks = spark.createDataFrame([("c2", "d", 1, 2), ("c1", "d", 1, 1)], "chunk_id string, document_id string, page int, chunk_index int")
    assert [(r.hit_id, r.chunk_id) for r in lookup.first_chunk_of_page(hits, chunks).collect()] == [("h2", "c1")]


def test_page_sections_takes_the_first_range(spark):
    pages = spark.createDataFrame([("d", p) for p in (1, 3, 9)], "document_id string, page int")
    sections = spark.createDataFrame([("d", "s2", 2, 5), ("d", "s1", 1, 3)], "document_id string, section_id string, page_start int, page_end int")
    assert {r.page: r.section_id for r in lookup.page_sections(pages, sections).collect()} == {1: "s1", 3: "s1", 9: None}


def test_keyword_match_prefers_long_words_then_order(spark):
    texts = spark.createDataFrame([("t", ["tree", "graph"]), ("u", ["none"])], "text_id string, terms array<string>")
    phrases = spark.createDataFrame([("p1", 1, "tree"), ("p2", 2, "graph"), ("p0", 0, "graph")], "pattern_id string, ordinal int, term string")
    assert [(r.text_id, r.pattern_id, r.score) for r in lookup.best_keyword_match(texts, phrases).collect()] == [("t", "p0", 5)]


def test_rollup_counts_a_question_once(spark):
    nodes = spark.createDataFrame([("u", "unit", "U", "u", None, None), ("p", "part", "P", "u", "p", "u"), ("t", "subtopic", "T", "u", "p", "p")], "node_id string, node_type string, title string, unit_id string, part_id string, parent_id string")
    facts = spark.createDataFrame([("t", "q1", Decimal("0.5"), 10), ("p", "q1", Decimal("1.0"), 10)], "node_id string, question_id string, weight decimal(9,3), marks int")
    out = {r.node_id: (r.question_count, r.unique_questions, r.marks_total, r.link_long) for r in hierarchy.rollup(nodes, facts).collect()}
    assert out == {"t": (0.5, 1, 5.0, 1), "p": (1.0, 1, 10.0, 2), "u": (1.0, 1, 10.0, 2)}


def test_scope_of_a_part_reaches_its_unit(spark):
    nodes = spark.createDataFrame([("u", "unit", "u", None), ("p", "part", "u", "p"), ("t", "subtopic", "u", "p"), ("p2", "part", "u", "p2")], "node_id string, node_type string, unit_id string, part_id string")
    links = spark.createDataFrame([(n, f"d{n}") for n in ("u", "p", "t", "p2")], "node_id string, document_id string")
    reach = lambda n: sorted(r.document_id for r in scope.expand(spark.createDataFrame([(n,)], "node_id string"), nodes, links).collect())
    assert reach("p") == ["dp", "dt", "du"] and reach("t") == ["dp", "dt", "du"] and reach("u") == ["dp", "dp2", "dt", "du"]


def test_sequences(spark):
    rows = spark.createDataFrame([("d", i, v) for i, v in enumerate([3, 3, None, 9])], "k string, i int, v int")
    assert [r.filled for r in sequences.filled(rows, ["k"], "i", "v").orderBy("i").collect()] == [3, 3, 6, 9]
    assert [r.n_rows for r in sequences.runs(rows, ["k"], ["i"], "v").orderBy("run_no").collect()] == [2, 1, 1]
    assert [r.rising for r in sequences.strictly_rising(rows.where("v is not null"), ["k"], "i", "v").orderBy("i").collect()] == [3, 4, 9]


def test_evaluation_counts_missing_results_as_misses(spark):
    golden = spark.createDataFrame([("a", True, [5]), ("b", True, [1]), ("c", False, [])], "query_id string, in_corpus boolean, expected_pages array<int>")
    results = spark.createDataFrame([("a", "ok", [6, 9]), ("c", "not_in_materials", [])], "query_id string, status string, pages array<int>")
    row = evaluation.scored(golden, results).first()
    assert (row.hit_rate, row.refusal_rate, row.hits) == (0.5, 1.0, 1)


def test_jobs_in_batch_and_stream(spark, tmp_path):
    rows = "job_id string, document_id string, status string, phase string, error string, created_at timestamp_ntz"
    data = [("j1", "d", "queued", "fast", None, "2021-01-01 00:00:00"), ("j2", "d", "failed", "fast", "x", "2021-01-02 00:00:00"), ("j1", "d", "queued", "fast", None, "2021-01-01 00:00:00"), ("j3", None, "queued", "full", None, "2020-01-01 00:00:00")]
    table = spark.createDataFrame(data, rows.replace("timestamp_ntz", "string")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert jobs.latest(table).first().job_id == "j2"
    assert [r.job_id for r in jobs.claim_order(table, 5).collect()] == ["j3", "j1"]
    table.write.parquet(str(tmp_path / "in"))
    stream = jobs.windowed_counts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {(r.status, r.n) for r in spark.table("counts").collect()} == {(r.status, r.n) for r in jobs.windowed_counts(table).collect()}
