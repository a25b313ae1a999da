"""The queries of the engine's own operators and their SQL.

Each runs over whole tables. Where SQL has no equal (sequential parsing, greedy clustering) a query has
no SQL and its operator is tested against brute force or hand-made cases instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.functions.vectors import cosine
from lectern.operators import analytics, chunking, evaluation, hierarchy, lookup, ranking, scope, search, sequences
from lectern.plans import views
from lectern.session import table
from lectern.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

# Shared parts of the SQL, as WITH entries.
_Q = "q AS (SELECT DISTINCT * FROM exam_questions WHERE course_id IS NOT NULL)"
_L = """l0 AS (SELECT DISTINCT question_id, unit, section_title, confidence FROM exam_questions),
  l1 AS (SELECT question_id, coalesce(unit,'Unclassified') AS concept, CAST(coalesce(confidence,1.0) AS DECIMAL(9,3)) AS w FROM l0
    UNION ALL SELECT question_id, section_title, CAST(0.5 AS DECIMAL(9,3)) FROM l0 WHERE section_title IS NOT NULL),
  l AS (SELECT question_id, concept, max(w) AS w FROM l1 GROUP BY ALL)"""
_M = "m AS (SELECT question_id, course_id AS scope, CAST(coalesce(marks,1) AS INTEGER) AS m, nullif(trim(paper_label),'') AS paper, CAST(nullif(regexp_extract(paper_label,'(20[0-9]{2})',1),'') AS INTEGER) AS year FROM q)"
_FACTS = f"""{_Q}, {_L}, {_M},
  tot AS (SELECT scope, sum(m) AS t, count(*) AS n, greatest(1, count(DISTINCT paper)) AS p FROM m GROUP BY scope),
  met AS (SELECT * FROM l JOIN m USING (question_id)),
  sl0 AS (SELECT scope, concept, year, count(*) AS links FROM met WHERE year IS NOT NULL GROUP BY ALL),
  sl AS (SELECT scope, concept, CASE WHEN count(*) > 1 THEN round(regr_slope(links, year), 4) END AS trend_slope FROM sl0 GROUP BY ALL),
  f0 AS (SELECT scope, concept, CAST(sum(w) AS DOUBLE) AS sw, count(*) AS u, CAST(sum(m*w) AS DOUBLE) AS smw, count(*) FILTER (m >= 8) AS lc, count(*) FILTER (m < 8) AS sc, count(DISTINCT paper) AS pr, max(year) AS last_year FROM met GROUP BY ALL),
  facts AS (SELECT f0.scope, f0.concept, CAST(round(CAST(sw AS DECIMAL(28,10)),4) AS DOUBLE) AS question_count, u AS unique_questions, CAST(round(CAST(smw AS DECIMAL(28,10)),2) AS DOUBLE) AS marks_total, CAST(round(CAST(100*smw/t AS DECIMAL(28,10)),2) AS DOUBLE) AS weightage_pct, CAST(round(CAST(100*CAST(u AS DOUBLE)/n AS DECIMAL(28,10)),2) AS DOUBLE) AS count_pct,
    lc AS long_count, sc AS short_count, pr AS paper_reach, CAST(round(CAST(CAST(pr AS DOUBLE)/p AS DECIMAL(28,10)),4) AS DOUBLE) AS recurrence_rate, CASE WHEN sw > 0 THEN CAST(round(CAST(smw/sw AS DECIMAL(28,10)),2) AS DOUBLE) END AS avg_marks, last_year, trend_slope
    FROM f0 JOIN tot USING (scope) LEFT JOIN sl ON sl.scope = f0.scope AND sl.concept = f0.concept)"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    from lectern import queries_concepts, queries_retrieval, queries_text  # noqa: F401  register the other queries

    return dict(_QUERIES)


#: Queries whose rank is an int here and a bigint in the SQL's row_number().
_RANKED = ("concept_page_ranked", "predictions_ranked", "top_topics", "vector_topk", "lexical_any", "lexical_all", "metadata_search", "cover_density_search", "rrf_fusion", "confidence_gate", "context_budget")


def oracle_sql() -> dict[str, str]:
    queries()
    return _SQL | {name: f"SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM ({_SQL[name]})" for name in _RANKED}


# --- analytics ---------------------------------------------------------------------------------------


def _facts(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.concept_facts(views.questions(spark, folder), views.links(spark, folder))


@query(f"WITH {_FACTS} SELECT * FROM facts")
def concept_facts(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder)


@query(f"WITH {_FACTS} SELECT scope, concept, trend_slope FROM facts WHERE trend_slope IS NOT NULL")
def concept_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _facts(spark, folder).where(F.col("trend_slope").isNotNull()).select("scope", "concept", "trend_slope")


@query(f"""WITH {_FACTS}, r AS (SELECT scope, concept, weightage_pct, unique_questions, row_number() OVER (PARTITION BY scope ORDER BY weightage_pct DESC, unique_questions DESC, lower(concept), concept) AS rank FROM facts)
    SELECT * FROM r WHERE rank BETWEEN 3 AND 7""")
def concept_page_ranked(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.ranked_page(_facts(spark, folder), "weightage_desc", 2, 5).select("scope", "concept", "weightage_pct", "unique_questions", "rank")


@query(f"""WITH {_FACTS}, e AS (SELECT scope, max(weightage_pct) AS top, min(trend_slope) AS low, max(trend_slope) AS high FROM facts GROUP BY scope),
    s AS (SELECT f.scope, concept AS label, CASE WHEN top > 0 THEN weightage_pct/top ELSE 0 END AS share, recurrence_rate AS r, trend_slope AS ts,
      CASE WHEN trend_slope IS NULL THEN 0.0 WHEN high = low THEN 1.0 ELSE (trend_slope-low)/(high-low) END AS nt FROM facts f JOIN e USING (scope)),
    z AS (SELECT scope, label, CAST(round(CAST(CAST(0.45 AS DOUBLE)*share + CAST(0.35 AS DOUBLE)*r + CAST(0.20 AS DOUBLE)*nt AS DECIMAL(28,10)), 4) AS DOUBLE) AS score,
      list_filter([CASE WHEN share >= 0.6 THEN 'high_weightage' END, CASE WHEN r >= 0.5 THEN 'recurs_across_papers' END, CASE WHEN ts > 0 THEN 'rising_trend' END], lambda x: x IS NOT NULL) AS reasons FROM s)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, lower(label), label) AS rank FROM z) WHERE rank <= 10""")
def predictions_ranked(spark: SparkSession, folder: str) -> DataFrame:
    features = _facts(spark, folder).select("scope", F.col("concept").alias("label"), "weightage_pct", "recurrence_rate", "trend_slope")
    return analytics.predictions(features)


@query(f"""WITH {_Q}, {_L}, k AS (SELECT question_id, bool_and(concept = 'Unclassified') AS alone FROM l GROUP BY question_id)
    SELECT course_id AS scope, count(*) AS n_questions, count(*) FILTER (coalesce(alone,false)) AS unclassified_only, CAST(round(CAST(100.0*count(*) FILTER (coalesce(alone,false))/count(*) AS DECIMAL(28,10)), 2) AS DOUBLE) AS unclassified_pct
    FROM q LEFT JOIN k USING (question_id) GROUP BY course_id""")
def unclassified_questions(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.unclassified_only(views.questions(spark, folder), views.links(spark, folder), views.UNCLASSIFIED)


_ROWS = f"""{_Q}, s0 AS (SELECT *, course_id AS scope, coalesce(regexp_matches(regexp_replace(lower(question_number),'[.()\\s]','','g'), '^[0-9]+[a-g]$'), false) AS sub FROM q),
  rows_ AS (SELECT s0.* FROM s0 JOIN (SELECT scope, bool_or(sub) AS any_sub FROM s0 GROUP BY scope) a USING (scope) WHERE sub OR NOT any_sub)"""


@query(f"""WITH {_ROWS}, u AS (SELECT scope, coalesce(unit,'Unmapped') AS unit, count(*) AS n_rows FROM rows_ GROUP BY ALL),
    m0 AS (SELECT scope, coalesce(paper_label,'Unknown') AS paper, nullif(regexp_extract(question_number,'^\\s*([0-9]+)',1),'') AS main, coalesce(unit,'Unmapped') AS unit,
      row_number() OVER (PARTITION BY scope, coalesce(paper_label,'Unknown'), nullif(regexp_extract(question_number,'^\\s*([0-9]+)',1),'') ORDER BY page NULLS FIRST, question_number NULLS FIRST, question_id) AS rn FROM rows_),
    m AS (SELECT scope, unit, count(*) AS n_mains FROM m0 WHERE main IS NOT NULL AND rn = 1 GROUP BY ALL)
    SELECT scope, unit, n_rows, CAST(round(CAST(100.0*n_rows/sum(n_rows) OVER (PARTITION BY scope) AS DECIMAL(28,10)), 1) AS DOUBLE) AS rows_pct, coalesce(n_mains,0) AS n_mains,
      CAST(round(CAST(100.0*coalesce(n_mains,0)/greatest(coalesce(sum(n_mains) OVER (PARTITION BY scope),0),1) AS DECIMAL(28,10)), 1) AS DOUBLE) AS mains_pct FROM u LEFT JOIN m USING (scope, unit)""")
def syllabus_units(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.unit_frequency(views.questions(spark, folder))


@query(f"""WITH {_ROWS}, c AS (SELECT scope, section_title AS topic, count(*) AS n FROM rows_ WHERE section_title IS NOT NULL GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, topic) AS rank FROM c) WHERE rank <= 10""")
def top_topics(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.top_topics(views.questions(spark, folder))


@query(f"""WITH {_Q} SELECT CAST(regexp_extract(paper_label,'(20[0-9]{{2}})',1) AS INTEGER) AS year, count(*) FILTER (unit='I') AS "I", count(*) FILTER (unit='II') AS "II", count(*) FILTER (unit='III') AS "III",
    count(*) FILTER (unit='IV') AS "IV", count(*) FILTER (unit='V') AS "V", count(*) FILTER (unit IS NULL OR unit NOT IN ('I','II','III','IV','V')) AS other FROM q WHERE regexp_extract(paper_label,'(20[0-9]{{2}})',1) <> '' GROUP BY 1""")
def year_unit_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.year_unit_matrix(views.questions(spark, folder), ["I", "II", "III", "IV", "V"])


@query(f"""WITH {_Q}, t AS (SELECT course_id AS scope, coalesce(unit,'general') AS unit, coalesce(section_title,'Unclassified') AS section FROM q)
    SELECT scope, unit, section, count(*) AS n, CASE WHEN grouping(section)=1 THEN 'unit' ELSE 'section' END AS level FROM t GROUP BY GROUPING SETS ((scope, unit), (scope, unit, section))""")
def topic_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.topic_frequency(views.questions(spark, folder))


@query(f"""WITH {_Q}, o AS (SELECT c.course_id AS scope, u.unit FROM courses c, (VALUES ('I'),('II'),('III'),('IV'),('V')) u(unit)), k AS (SELECT course_id AS scope, unit, count(*) AS n FROM q WHERE unit IS NOT NULL GROUP BY ALL)
    SELECT coalesce(o.scope,k.scope) AS scope, coalesce(o.unit,k.unit) AS unit, coalesce(n,0) AS n FROM o FULL JOIN k ON o.scope=k.scope AND o.unit=k.unit""")
def outline_frequency(spark: SparkSession, folder: str) -> DataFrame:
    outline = table(spark, folder, "courses").select(F.col("course_id").alias("scope"), F.explode(F.array(*map(F.lit, ("I", "II", "III", "IV", "V")))).alias("unit"))
    counts = views.questions(spark, folder).where(F.col("unit").isNotNull()).groupBy("scope", "unit").agg(F.count(F.lit(1)).alias("n"))
    return analytics.with_outline(outline, counts)


@query("""WITH c AS (SELECT DISTINCT ON (chunk_id) chunk_id, document_id, page, text FROM chunks ORDER BY chunk_id),
    s AS (SELECT document_id, count(*) AS n, list_sort(list(DISTINCT page) FILTER (length(trim(text)) >= 100)) AS p FROM c GROUP BY document_id)
    SELECT d.document_id, coalesce(n,0) AS n_chunks, coalesce(p,[]) AS readable_pages FROM documents d LEFT JOIN s USING (document_id)""")
def source_documents(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.source_stats(table(spark, folder, "documents"), table(spark, folder, "chunks"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, document_id FROM chunks), v AS (SELECT DISTINCT chunk_id FROM chunk_embeddings WHERE embedding IS NOT NULL),
    pc AS (SELECT document_id, count(*) AS n, count(v.chunk_id) AS e FROM c LEFT JOIN v USING (chunk_id) GROUP BY document_id), pq AS (SELECT document_id, count(DISTINCT question_id) AS q FROM exam_questions GROUP BY document_id)
    SELECT course_id AS scope, count(*) AS documents, CAST(coalesce(sum(n),0) AS BIGINT) AS chunks, CAST(coalesce(sum(e),0) AS BIGINT) AS embedded, CAST(coalesce(sum(q),0) AS BIGINT) AS questions, coalesce(sum(e),0) > 0 AS can_search, coalesce(sum(q),0) > 0 AS can_analyse
    FROM documents LEFT JOIN pc USING (document_id) LEFT JOIN pq USING (document_id) WHERE course_id IS NOT NULL GROUP BY course_id""")
def exam_status(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumnRenamed("course_id", "scope")
    return analytics.readiness(docs, table(spark, folder, "chunks"), table(spark, folder, "chunk_embeddings"), table(spark, folder, "exam_questions"))


@query(f"""WITH {_Q}, {_L} SELECT scope, concept, question_id FROM (SELECT course_id AS scope, concept, question_id, row_number() OVER (PARTITION BY course_id, concept ORDER BY coalesce(marks,0) DESC, length(coalesce(prompt_text,'')) DESC, question_id) AS rn
    FROM q JOIN l USING (question_id)) WHERE rn = 1""")
def best_prompt_argmax(spark: SparkSession, folder: str) -> DataFrame:
    links = views.links(spark, folder).select("question_id", "concept").distinct()
    return analytics.best_prompt(views.questions(spark, folder), links)


@query(f"""WITH {_Q}, r AS (SELECT unnest(list_filter([CASE WHEN trim(coalesce(prompt_text,''))='' THEN 'empty' END, CASE WHEN trim(coalesce(prompt_text,''))<>'' AND length(prompt_text)<12 THEN 'too_short' END, CASE WHEN marks IS NULL THEN 'no_marks' END,
    CASE WHEN coalesce(regexp_extract(question_number,'^\\s*([0-9]+)',1),'')='' THEN 'no_number' END, CASE WHEN page IS NULL THEN 'no_page' END], lambda x: x IS NOT NULL)) AS reason FROM q) SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def question_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.drop_reasons(views.questions(spark, folder))


@query(f"""WITH {_Q}, y AS (SELECT course_id AS scope, unit, CAST(nullif(regexp_extract(paper_label,'(20[0-9]{{2}})',1),'') AS INTEGER) AS year, count(*) AS n FROM q WHERE unit IS NOT NULL GROUP BY ALL),
    i AS (SELECT *, row_number() OVER (PARTITION BY scope, unit ORDER BY year) - 1 AS x FROM y WHERE year IS NOT NULL) SELECT scope, unit, CASE WHEN count(*) > 1 THEN round(regr_slope(n, x), 4) END AS slope FROM i GROUP BY ALL""")
def unit_ordinal_trend(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.questions(spark, folder).where(F.col("unit").isNotNull()).withColumn("year", fn.year_of(F.col("paper_label")))
    return analytics.ordinal_slope(rows.groupBy("scope", "unit", "year").agg(F.count(F.lit(1)).alias("n")), ["scope", "unit"])


# --- hierarchy and scope -----------------------------------------------------------------------------

_TREE = """nodes AS (SELECT 'r'||r_regionkey AS node_id, 'unit' AS node_type, r_name AS title, 'r'||r_regionkey AS unit_id, NULL AS part_id, NULL AS parent_id FROM region
  UNION ALL SELECT 'n'||n_nationkey, 'part', n_name, 'r'||n_regionkey, 'n'||n_nationkey, 'r'||n_regionkey FROM nation
  UNION ALL SELECT 'c'||c_custkey, 'subtopic', c_name, 'r'||n_regionkey, 'n'||c_nationkey, 'n'||c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"""WITH {_TREE}, f AS (SELECT n.unit_id, n.part_id, n.node_id, 'q'||o_orderkey AS q, CAST(o_orderkey % 12 AS INTEGER) AS m FROM orders JOIN nodes n ON n.node_id = 'c'||o_custkey),
    a AS (SELECT node_id, q, m FROM f UNION ALL SELECT part_id, q, m FROM f UNION ALL SELECT unit_id, q, m FROM f),
    s AS (SELECT node_id, count(DISTINCT q) AS u, CAST(count(*) FILTER (m >= 8) AS BIGINT) AS ll, CAST(count(*) FILTER (m < 8) AS BIGINT) AS ls, sum(m) AS sm FROM a GROUP BY node_id)
    SELECT node_id, CAST(coalesce(0.5*u,0.0) AS DOUBLE) AS question_count, coalesce(u,0) AS unique_questions, coalesce(ll,0) AS link_long, coalesce(ls,0) AS link_short, CAST(coalesce(0.5*sm,0.0) AS DOUBLE) AS marks_total FROM nodes LEFT JOIN s USING (node_id)""")
def structure_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.rollup(*views.customers_tree(spark, folder))


@query(f"""WITH {_TREE} SELECT n.node_id, u.title AS unit_title, p.title AS part_title, CASE WHEN n.node_type='subtopic' THEN n.title END AS subtopic_title FROM nodes n LEFT JOIN nodes u ON u.node_id = n.unit_id LEFT JOIN nodes p ON p.node_id = n.part_id""")
def ancestor_labels(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.ancestor_titles(views.customers_tree(spark, folder)[0])


@query("""SELECT 'r'||r_regionkey AS unit_id, r_name AS title, (SELECT list(n_name ORDER BY 'n'||n_nationkey) FROM nation WHERE n_regionkey = r_regionkey) AS children FROM region""")
def structure_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.nested(views.customers_tree(spark, folder)[0])


@query("""WITH cu AS (SELECT 'r'||min(r_regionkey) AS r FROM region), cn AS (SELECT n_regionkey, max(n_nationkey) AS n FROM nation GROUP BY 1), cc AS (SELECT c_nationkey, min(c_custkey) AS c FROM customer GROUP BY 1),
    t AS (SELECT c_custkey, c_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
    reached AS (SELECT 'c'||c_custkey AS node_id FROM t WHERE 'r'||n_regionkey IN (SELECT r FROM cu) UNION SELECT 'n'||n_nationkey FROM nation WHERE 'r'||n_regionkey IN (SELECT r FROM cu) UNION SELECT r FROM cu
      UNION SELECT 'c'||c_custkey FROM t WHERE c_nationkey IN (SELECT n FROM cn) UNION SELECT 'n'||n FROM cn UNION SELECT 'r'||n_regionkey FROM cn
      UNION SELECT 'c'||c FROM cc UNION SELECT 'n'||c_nationkey FROM cc UNION SELECT 'r'||n_regionkey FROM cc JOIN nation ON n_nationkey = c_nationkey),
    links AS (SELECT 'c'||o_custkey AS node_id, 'd'||o_orderkey AS document_id FROM orders UNION ALL SELECT 'n'||s_nationkey, 's'||s_suppkey FROM supplier UNION ALL SELECT 'r'||r_regionkey, 'r'||r_regionkey FROM region)
    SELECT DISTINCT document_id FROM links JOIN reached USING (node_id)""")
def scope_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Chosen are the first unit, the last part of each unit and the first subtopic of each part; nodes of all three levels have documents."""
    nodes, _ = views.customers_tree(spark, folder)
    named = lambda sign, c: F.concat(F.lit(sign), c).alias("node_id")
    region, nation, customer, orders, supplier = (table(spark, folder, t) for t in ("region", "nation", "customer", "orders", "supplier"))
    chosen = region.agg(F.min("r_regionkey").alias("k")).select(named("r", F.col("k")))
    chosen = chosen.union(nation.groupBy("n_regionkey").agg(F.max("n_nationkey").alias("k")).select(named("n", F.col("k"))))
    chosen = chosen.union(customer.groupBy("c_nationkey").agg(F.min("c_custkey").alias("k")).select(named("c", F.col("k"))))
    link = lambda df, sign, key, of, doc: df.select(named(sign, F.col(key)), F.concat(F.lit(of), F.col(doc)).alias("document_id"))
    links = link(orders, "c", "o_custkey", "d", "o_orderkey").union(link(supplier, "n", "s_nationkey", "s", "s_suppkey")).union(link(region, "r", "r_regionkey", "r", "r_regionkey"))
    return scope.expand(chosen, nodes, links)


@query("SELECT document_id, doc_kind FROM documents WHERE doc_kind IN ('notes','textbook','syllabus') AND status = 'ready'")
def lane_filter(spark: SparkSession, folder: str) -> DataFrame:
    return scope.lane(table(spark, folder, "documents"), scope.STUDY).select("document_id", "doc_kind")


@query("SELECT DISTINCT document_id FROM exam_questions q WHERE document_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.document_id = q.document_id AND d.status = 'ready')")
def scope_check_missing(spark: SparkSession, folder: str) -> DataFrame:
    ready = table(spark, folder, "documents").where("status = 'ready'").select("document_id")
    return scope.missing(table(spark, folder, "exam_questions"), ready, "document_id")


@query("""SELECT course_id, document_id, doc_kind FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY CASE WHEN doc_kind='syllabus' THEN 0 WHEN lower(filename) LIKE '%syllabus%' THEN 1 ELSE 2 END, created_at NULLS FIRST, document_id) AS rn FROM documents WHERE course_id IS NOT NULL) WHERE rn = 1""")
def syllabus_pick(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("course_id IS NOT NULL").select("course_id", "document_id", "doc_kind", "filename", "created_at")
    priority = F.when(F.col("doc_kind") == "syllabus", 0).when(F.contains(F.lower("filename"), F.lit("syllabus")), 1).otherwise(2)
    return scope.prioritised(docs, "course_id", priority, F.col("created_at")).select("course_id", "document_id", "doc_kind")


# --- joins and lookups -------------------------------------------------------------------------------


@query("""WITH c AS (SELECT DISTINCT chunk_id, document_id, page, chunk_index FROM chunks WHERE page IS NOT NULL), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY chunk_index NULLS LAST, chunk_id) AS rn FROM c) WHERE rn = 1),
    h AS (SELECT DISTINCT question_id AS hit_id, document_id, page, round(greatest(coalesce(bm25_score,0), coalesce(vector_score,0)),6) AS score FROM exam_questions)
    SELECT hit_id, chunk_id, score FROM (SELECT h.hit_id, f.chunk_id, h.score, row_number() OVER (PARTITION BY f.chunk_id ORDER BY h.score DESC NULLS LAST, h.hit_id) AS rn FROM h JOIN f ON f.document_id = h.document_id AND f.page = h.page) WHERE rn = 1""")
def first_chunk_lookup(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(0.0)
    score = F.round(F.greatest(F.coalesce("bm25_score", zero), F.coalesce("vector_score", zero)), 6)
    hits = table(spark, folder, "exam_questions").select(F.col("question_id").alias("hit_id"), "document_id", "page", score.alias("score")).distinct()
    return lookup.first_chunk_of_page(hits, table(spark, folder, "chunks").select("chunk_id", "document_id", "page", "chunk_index").distinct()).select("hit_id", "chunk_id", "score")


@query("""WITH p AS (SELECT DISTINCT document_id, page FROM page_texts), s AS (SELECT DISTINCT document_id, parent_id, page_start, page_end FROM chunk_parents)
    SELECT document_id, page, (SELECT parent_id FROM s WHERE s.document_id = p.document_id AND p.page BETWEEN page_start AND page_end ORDER BY page_start, page_end, parent_id LIMIT 1) AS section_id FROM p""")
def page_to_section(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_texts").select("document_id", "page").distinct()
    sections = table(spark, folder, "chunk_parents").select("document_id", F.col("parent_id").alias("section_id"), "page_start", "page_end").distinct()
    return lookup.page_sections(pages, sections)


_WORD = r"'[\p{L}\p{N}]+'"
_TERM = "list_filter(list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')), lambda x: length(x) >= 4)"


@query(f"""WITH q AS (SELECT DISTINCT question_id AS text_id, prompt_text FROM exam_questions WHERE prompt_text IS NOT NULL), t AS (SELECT DISTINCT text_id, unnest(list_distinct(regexp_extract_all(lower(prompt_text), {_WORD}))) AS term FROM q),
    c AS (SELECT course_id AS pattern_id, row_number() OVER (ORDER BY course_id) AS ordinal, {_TERM.format('name')} AS ts FROM courses), ph AS (SELECT pattern_id, ordinal, unnest(ts) AS term FROM c),
    s AS (SELECT text_id, pattern_id, ordinal, CAST(sum(length(term)) AS BIGINT) AS score FROM t JOIN ph USING (term) GROUP BY ALL)
    SELECT text_id, pattern_id, score FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, ordinal) AS rn FROM s) WHERE rn = 1""")
def keyword_best_match(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    texts = table(spark, folder, "exam_questions").where("prompt_text IS NOT NULL").select(F.col("question_id").alias("text_id"), fn.terms(F.col("prompt_text")).alias("terms")).distinct()
    courses = table(spark, folder, "courses").withColumn("ordinal", F.row_number().over(Window.orderBy("course_id")))  # a fixed list of courses
    phrases = courses.select(F.col("course_id").alias("pattern_id"), "ordinal", F.explode(F.array_distinct(fn.terms(F.col("name")))).alias("term")).where(F.length("term") >= 4)
    return lookup.best_keyword_match(texts, phrases)


@query("""WITH h AS (SELECT document_id, round(max(greatest(coalesce(bm25_score,0),coalesce(vector_score,0))),6) AS best_score, count(*) AS n_hits FROM (SELECT DISTINCT * FROM exam_questions) WHERE bm25_score IS NOT NULL OR vector_score IS NOT NULL GROUP BY document_id)
    SELECT document_id, best_score, coalesce(n_hits,0) AS n_hits, best_score IS NOT NULL AS hit FROM documents LEFT JOIN h USING (document_id) WHERE doc_kind IN ('notes','textbook','syllabus') AND status='ready'""")
def coverage_left(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(0.0)
    hits = table(spark, folder, "exam_questions").distinct().where("bm25_score IS NOT NULL OR vector_score IS NOT NULL").select("document_id", F.round(F.greatest(F.coalesce("bm25_score", zero), F.coalesce("vector_score", zero)), 6).alias("score"))
    return ranking.coverage(scope.lane(table(spark, folder, "documents"), scope.STUDY).select("document_id"), hits)


@query("""WITH a AS (SELECT 'chunks_'||doc_kind AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT chunk_id, document_id FROM chunks) JOIN documents USING (document_id) WHERE doc_kind IS NOT NULL GROUP BY doc_kind),
    e AS (SELECT 'chunks_'||doc_kind AS name, CAST(count(*) AS DOUBLE) AS value FROM (SELECT DISTINCT parent_id, document_id FROM chunk_parents) JOIN documents USING (document_id) WHERE doc_kind IS NOT NULL GROUP BY doc_kind)
    SELECT name, a.value AS actual, e.value AS expected, a.value - e.value AS delta, coalesce(abs(a.value-e.value) <= greatest(0.0, abs(e.value)*1.2), false) AS passed FROM a FULL JOIN e USING (name)""")
def golden_metrics(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "documents").where("doc_kind IS NOT NULL").select("document_id", "doc_kind")
    count = lambda name, key: table(spark, folder, name).select(key, "document_id").distinct().join(kinds, "document_id").groupBy(F.concat(F.lit("chunks_"), "doc_kind").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return lookup.compare_metrics(count("chunks", "chunk_id"), count("chunk_parents", "parent_id"), relative=1.2)


# --- search ------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0),
    s AS (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(q.v, lambda x: CAST(x AS DOUBLE))),6) AS score FROM q, embeddings e WHERE e.vec_id <> query_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search.vector_topk(rows.where("id % 20 = 0").withColumnRenamed("id", "query_id"), rows, 10, exclude_self=True)


@query("""SELECT a.vec_id AS vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)), list_transform(b.embedding, lambda x: CAST(x AS DOUBLE))),6) AS similarity FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_of_pairs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return rows.join(following, "vec_id").select("vec_id", F.round(cosine(F.col("a"), F.col("b")), 6).alias("similarity"))


def _course_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The names of the courses as questions, a fixed query set."""
    return table(spark, folder, "courses").select(F.col("course_id").alias("query_id"), F.explode(F.array_distinct(fn.terms(F.col("name")))).alias("term")).where(F.length("term") >= 4)


_CHUNK_TEXT = "SELECT chunk_id AS id, min(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id"


def _bm(texts: str) -> str:
    """The steps of Okapi BM25 over the texts (id, text)."""
    return f"""qt AS (SELECT course_id AS query_id, unnest({_TERM.format('name')}) AS term FROM courses),
  d AS ({texts}), dt AS (SELECT id, regexp_extract_all(lower(text), {_WORD}) AS ts FROM d),
  st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(ts)) AS mean FROM dt), po AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM dt) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM po GROUP BY term),
  sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5)/(df + 0.5)) * tf * CAST(2.2 AS DOUBLE) / (tf + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * len / mean))),6) AS score, count(*) AS matched FROM qt JOIN po USING (term) JOIN df USING (term), st GROUP BY query_id, id)"""


_BM = _bm(_CHUNK_TEXT)
_TOP = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {}) WHERE rank <= {}"


def covers_sql(asked: str, texts: str) -> str:
    """The steps of ``search.cover_density`` over asked (query_id, scope, term) and texts (id, scope, text): sc (query_id, id, score)."""
    return f"""qa AS (SELECT DISTINCT * FROM ({asked})), dl AS ({texts}), dw AS (SELECT id, scope, regexp_extract_all(lower(text), {_WORD}) AS ts FROM dl WHERE text IS NOT NULL),
  ev AS (SELECT query_id, id, term, pos FROM (SELECT id, scope, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM dw) JOIN qa USING (scope, term)),
  need AS (SELECT query_id, count(*) AS need FROM qa GROUP BY query_id), hv AS (SELECT query_id, id, count(DISTINCT term) AS have FROM ev GROUP BY ALL),
  fe AS (SELECT ev.* FROM ev JOIN hv USING (query_id, id) JOIN need USING (query_id) WHERE have = need),
  lt AS (SELECT a.query_id, a.id, a.pos, b.term, max(b.pos) AS last FROM fe a JOIN fe b ON a.query_id = b.query_id AND a.id = b.id AND b.pos <= a.pos GROUP BY ALL),
  st0 AS (SELECT query_id, id, pos, min(last) AS start FROM lt JOIN need USING (query_id) GROUP BY query_id, id, pos, need HAVING count(*) = need),
  cv AS (SELECT query_id, id, start, min(pos) AS stop FROM st0 GROUP BY ALL),
  cn AS (SELECT cv.query_id, cv.id, start, stop, count(*) AS inside FROM cv JOIN fe ON fe.query_id = cv.query_id AND fe.id = cv.id AND fe.pos BETWEEN start AND stop GROUP BY ALL),
  sc AS (SELECT query_id, id, round(sum(CAST(0.1 AS DOUBLE) / (1 + (stop - start) - (inside - 1))), 6) AS score FROM cn GROUP BY ALL)"""


@query(f"WITH {_BM} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 20")
def lexical_any(spark: SparkSession, folder: str) -> DataFrame:
    texts = views.chunks(spark, folder).select(F.col("chunk_id").alias("id"), "text")
    return search.bm25(_course_terms(spark, folder), texts, 20)


@query(f"""WITH {_BM}, need AS (SELECT query_id, count(DISTINCT term) AS asked FROM qt GROUP BY query_id), al AS (SELECT sc.* FROM sc JOIN need USING (query_id) WHERE matched = asked)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM al) WHERE rank <= 20""")
def lexical_all(spark: SparkSession, folder: str) -> DataFrame:
    texts = views.chunks(spark, folder).select(F.col("chunk_id").alias("id"), "text")
    return search.bm25(_course_terms(spark, folder), texts, 20, require_all=True)


@query(f"""WITH {_bm("SELECT id, min(text) AS text FROM (SELECT chunk_id AS id, concat_ws(' ', metadata['section_title'], metadata['toc_path']) AS text FROM chunks WHERE coalesce(metadata['section_title'], metadata['toc_path']) IS NOT NULL) GROUP BY id")} {_TOP.format("sc", 20)}""")
def metadata_search(spark: SparkSession, folder: str) -> DataFrame:
    fields = [F.try_element_at("metadata", F.lit(key)) for key in ("section_title", "toc_path")]
    titles = table(spark, folder, "chunks").where(F.coalesce(*fields).isNotNull()).select(F.col("chunk_id").alias("id"), F.concat_ws(" ", *fields).alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    return search.bm25(_course_terms(spark, folder), titles, 20)


@query(f"""WITH {covers_sql("SELECT course_id AS query_id, '' AS scope, unnest(" + _TERM.format("name") + ") AS term FROM courses", "SELECT id, '' AS scope, text FROM (" + _CHUNK_TEXT + ")")} {_TOP.format("sc", 20)}""")
def cover_density_search(spark: SparkSession, folder: str) -> DataFrame:
    texts = views.chunks(spark, folder).select(F.col("chunk_id").alias("id"), "text")
    return search.cover_density(_course_terms(spark, folder), texts, 20)


def _score_list(spark: SparkSession, folder: str, column: str) -> DataFrame:
    """The questions of each course ranked by a stored score."""
    from pyspark.sql import Window

    rows = views.questions(spark, folder).where(F.col(column) > 0).select(F.col("scope").alias("query_id"), F.col("question_id").alias("id"), F.col(column).alias("score"))
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(window)).where("rank <= 40")


_LISTS = f"""{_Q}, lx AS (SELECT * FROM (SELECT course_id AS query_id, question_id AS id, bm25_score AS score, row_number() OVER (PARTITION BY course_id ORDER BY bm25_score DESC, question_id) AS rank FROM q WHERE bm25_score > 0) WHERE rank <= 40),
  vx AS (SELECT * FROM (SELECT course_id AS query_id, question_id AS id, vector_score AS score, row_number() OVER (PARTITION BY course_id ORDER BY vector_score DESC, question_id) AS rank FROM q WHERE vector_score > 0) WHERE rank <= 40),
  fu AS (SELECT query_id, id, round(sum(p),10) AS fused, count(*) AS n_lists FROM (SELECT query_id, id, CAST(1.75 AS DOUBLE)/(60+rank) AS p FROM lx UNION ALL SELECT query_id, id, CAST(0.85 AS DOUBLE)/(60+rank) FROM vx) GROUP BY ALL),
  fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM fu) WHERE rank <= 24)"""


def _fused(spark: SparkSession, folder: str) -> DataFrame:
    return search.fuse([(_score_list(spark, folder, "bm25_score"), 1.75), (_score_list(spark, folder, "vector_score"), 0.85)])


@query(f"WITH {_LISTS} SELECT * FROM fr")
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    return _fused(spark, folder)


@query("""WITH a AS (SELECT question_id AS id, nullif(max(bm25_score),0) AS lexical_score FROM exam_questions WHERE bm25_score IS NOT NULL GROUP BY 1), b AS (SELECT question_id AS id, nullif(max(vector_score),0) AS vector_score FROM exam_questions WHERE vector_score IS NOT NULL GROUP BY 1)
    SELECT id, lexical_score, vector_score, greatest(lexical_score, vector_score) AS match_score FROM a FULL JOIN b USING (id)""")
def merge_hits(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exam_questions")
    side = lambda c: rows.where(F.col(c).isNotNull()).select(F.col("question_id").alias("id"), F.col(c).alias("score"))
    return search.merge_hits(side("bm25_score"), side("vector_score"))


@query(f"""WITH {_LISTS}, h AS (SELECT fr.query_id, fr.id, fr.rank, round(greatest(coalesce(bm25_score,0),coalesce(vector_score,0)),6) AS score FROM fr JOIN q ON q.question_id = fr.id AND q.course_id = fr.query_id)
    SELECT query_id, id, rank, score FROM h WHERE query_id IN (SELECT query_id FROM h WHERE rank = 1 AND score >= 0.9)""")
def confidence_gate(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.confidence_gate(_scored_hits(spark, folder), 0.9)


def _scored_hits(spark: SparkSession, folder: str) -> DataFrame:
    zero = F.lit(0.0)
    scores = views.questions(spark, folder).select(F.col("scope").alias("query_id"), F.col("question_id").alias("id"), F.round(F.greatest(F.coalesce("bm25_score", zero), F.coalesce("vector_score", zero)), 6).alias("score"))
    return _fused(spark, folder).join(scores, ["query_id", "id"]).select("query_id", "id", "rank", "score")


@query(f"""WITH {_LISTS}, h AS (SELECT fr.query_id, fr.rank, round(greatest(coalesce(bm25_score,0),coalesce(vector_score,0)),6) AS score FROM fr JOIN q ON q.question_id = fr.id AND q.course_id = fr.query_id), t AS (SELECT query_id, score FROM h WHERE rank = 1)
    SELECT course_id AS query_id, CASE WHEN score >= 0.9 THEN 'ok' ELSE 'not_in_materials' END AS status, CASE WHEN score IS NULL THEN 'empty_corpus' WHEN score < 0.9 THEN 'below_threshold' END AS reason FROM courses LEFT JOIN t ON query_id = course_id""")
def gate_status(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "courses").select(F.col("course_id").alias("query_id"))
    return ranking.gate_status(asked, _scored_hits(spark, folder), 0.9)


@query("""WITH p AS (SELECT document_id AS query_id, parent_id AS id, min(text) AS text, min(page_start) AS ps FROM chunk_parents GROUP BY 1,2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ps, id) AS rank FROM p),
    u AS (SELECT *, coalesce(sum(coalesce(length(text),0)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS used FROM r)
    SELECT query_id, id, rank, CAST(greatest(0, least(coalesce(length(text),0), 2400 - used)) AS INTEGER) AS kept, md5(substr(text, 1, CAST(greatest(0, least(coalesce(length(text),0), 2400 - used)) AS INTEGER))) AS digest FROM u""")
def context_budget(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    parents = table(spark, folder, "chunk_parents").groupBy(F.col("document_id").alias("query_id"), F.col("parent_id").alias("id")).agg(F.min("text").alias("text"), F.min("page_start").alias("ps"))
    ranked = parents.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ps", "id"))).drop("ps")
    return ranking.context_budget(ranked, 600).select("query_id", "id", "rank", "kept", F.md5("text").alias("digest"))


# --- chunking ----------------------------------------------------------------------------------------


@query("""WITH s(kind, n, r) AS (VALUES ('notes',100,0.12),('textbook',120,0.12),('syllabus',60,0.10),('past_paper',50,0.12)),
    w0 AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws, n, greatest(1, CAST(floor(n*r) AS INTEGER)) AS o FROM documents JOIN s ON kind = coalesce(doc_kind,'notes') WHERE trim(text, E' \\t\\r\\n\\f\\v') <> ''),
    w AS (SELECT *, len(ws) AS c, greatest(1, n-o) AS step FROM w0 WHERE len(ws) > 0),
    e AS (SELECT *, unnest(range(CAST(1 + ceil(greatest(0, c-n)/step) AS BIGINT))) AS k FROM w)
    SELECT id, CAST(k AS INTEGER) AS window, CASE WHEN c <= n THEN NULL ELSE md5(array_to_string(list_slice(ws, k*step+1, k*step+n), ' ')) END AS digest, CAST(CASE WHEN c <= n THEN c ELSE len(list_slice(ws, k*step+1, k*step+n)) END AS INTEGER) AS token_count FROM e""")
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce("doc_kind", F.lit("notes")).alias("kind"))
    size = F.when(F.col("kind") == "notes", 100).when(F.col("kind") == "textbook", 120).when(F.col("kind") == "syllabus", 60).when(F.col("kind") == "past_paper", 50)
    ratio = F.when(F.col("kind") == "syllabus", 0.10).otherwise(0.12)
    sized = docs.select("id", "text", size.alias("w"), ratio.alias("r"))
    out = chunking.windows(sized, F.col("w"), F.col("r"))
    many = out.join(out.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id")
    return many.select("id", "window", F.when(F.col("n") > 1, F.md5("text")).alias("digest"), F.col("token_count").cast("int").alias("token_count"))


@query()
def parent_groups(spark: SparkSession, folder: str) -> DataFrame:
    kinds = table(spark, folder, "documents").select("document_id", "doc_kind")
    pages = views.pages(spark, folder).join(kinds, "document_id")
    return chunking.parent_groups(pages, chunking.spec(F.col("doc_kind"), 2) / 5)


@query("""WITH c AS (SELECT chunk_id, document_id, page, min(chunk_index) AS i, min(text) AS t FROM chunks GROUP BY 1,2,3) SELECT document_id, page, md5(coalesce(array_to_string(list(t ORDER BY i NULLS FIRST, chunk_id), chr(10)),'')) AS digest FROM c GROUP BY document_id, page""")
def page_reassembly(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.reassemble(table(spark, folder, "chunks")).select("document_id", "page", F.md5("text").alias("digest"))


@query("""WITH a AS (SELECT document_id, page, min(text) AS t FROM page_texts GROUP BY 1,2), c AS (SELECT chunk_id, document_id, page, min(chunk_index) AS i, min(text) AS t FROM chunks GROUP BY 1,2,3),
    b AS (SELECT document_id, page, array_to_string(list(t ORDER BY i NULLS FIRST, chunk_id), chr(10)) AS t FROM c GROUP BY 1,2)
    SELECT document_id, page, CASE WHEN coalesce(length(a.t),-1) >= coalesce(length(b.t),-1) THEN 'native' ELSE 'stored' END AS source, md5(CASE WHEN coalesce(length(a.t),-1) >= coalesce(length(b.t),-1) THEN a.t ELSE b.t END) AS digest FROM a FULL JOIN b USING (document_id, page)""")
def source_merge(spark: SparkSession, folder: str) -> DataFrame:
    merged = chunking.longer_source(views.pages(spark, folder), chunking.reassemble(table(spark, folder, "chunks")))
    return merged.select("document_id", "page", "source", F.md5("text").alias("digest"))


# --- sequences ---------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT DISTINCT document_id, parent_id, page_start FROM chunk_parents WHERE page_start IS NOT NULL), d AS (SELECT document_id, page_count FROM documents)
    SELECT document_id, parent_id, page_start, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY document_id ORDER BY page_start, parent_id) - 1, page_count)) AS span_end FROM s JOIN d USING (document_id)""")
def section_spans_lead(spark: SparkSession, folder: str) -> DataFrame:
    starts = table(spark, folder, "chunk_parents").select("document_id", "parent_id", "page_start").where("page_start IS NOT NULL").distinct()
    joined = starts.join(table(spark, folder, "documents").select("document_id", "page_count"), "document_id")
    return sequences.spans(joined, ["document_id"], "page_start", "page_count").drop("page_count")


@query("""WITH p AS (SELECT document_id, page, min(text) AS t FROM page_texts GROUP BY 1,2) SELECT document_id, page, CAST(sum(CASE WHEN coalesce(regexp_matches(t, '(?m)^(UNIT|\\d+\\.\\d+ )'), false) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page) AS BIGINT) AS session_no FROM p""")
def page_sessions(spark: SparkSession, folder: str) -> DataFrame:
    opens = F.coalesce(F.col("text").rlike(r"(?m)^(UNIT|\d+\.\d+ )"), F.lit(False))
    return sequences.sessions(views.pages(spark, folder), ["document_id"], ["page"], ~opens).select("document_id", "page", "session_no")


@query("""WITH e AS (SELECT DISTINCT question_id, document_id, page, unit FROM exam_questions WHERE page IS NOT NULL), n AS (SELECT *, CASE WHEN unit IS NOT DISTINCT FROM lag(unit) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS f FROM e WINDOW w AS (PARTITION BY document_id ORDER BY page, question_id)),
    r AS (SELECT *, CAST(sum(f) OVER (PARTITION BY document_id ORDER BY page, question_id) AS BIGINT) AS run_no FROM n) SELECT document_id, run_no, any_value(unit) AS unit, count(*) AS n_rows FROM r GROUP BY document_id, run_no""")
def unit_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exam_questions").select("question_id", "document_id", "page", "unit").where("page IS NOT NULL").distinct()
    return sequences.runs(rows, ["document_id"], ["page", "question_id"], "unit")


@query("""WITH s AS (SELECT DISTINCT document_id, parent_id, page_start FROM chunk_parents WHERE page_start IS NOT NULL), i AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY parent_id) AS k FROM s)
    SELECT document_id, parent_id, CAST(max(page_start - k) OVER (PARTITION BY document_id ORDER BY k) + k AS INTEGER) AS rising FROM i""")
def monotonic_starts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "chunk_parents").select("document_id", "parent_id", "page_start").where("page_start IS NOT NULL").distinct()
    return sequences.strictly_rising(rows, ["document_id"], "parent_id", "page_start").select("document_id", "parent_id", "rising")


# --- evaluation and jobs -----------------------------------------------------------------------------


@query("""WITH g AS (SELECT DISTINCT question_id, document_id, page, bm25_score FROM exam_questions WHERE page IS NOT NULL), c AS (SELECT document_id, list(DISTINCT page) FILTER (page IS NOT NULL) AS pages FROM chunks GROUP BY document_id),
    j AS (SELECT bm25_score IS NOT NULL AS inc, len(list_filter(coalesce(pages,[]), lambda p: abs(p - page) <= 1)) > 0 AS hit, pages IS NULL AS refused FROM g LEFT JOIN c USING (document_id)),
    t AS (SELECT count(*) FILTER (inc) AS in_corpus, count(*) FILTER (inc AND hit) AS hits, count(*) FILTER (NOT inc) AS out_of_corpus, count(*) FILTER (NOT inc AND refused) AS refusals FROM j)
    SELECT *, CASE WHEN in_corpus > 0 THEN round(CAST(hits AS DOUBLE)/in_corpus,6) ELSE 1.0 END AS hit_rate, CASE WHEN out_of_corpus > 0 THEN round(CAST(refusals AS DOUBLE)/out_of_corpus,6) ELSE 1.0 END AS refusal_rate FROM t""")
def hit_and_refusal_rate(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "exam_questions").where("page IS NOT NULL").select("question_id", "document_id", "page", "bm25_score").distinct()
    pages = table(spark, folder, "chunks").groupBy("document_id").agg(F.collect_set("page").alias("pages"))
    golden = asked.select(F.col("question_id").alias("query_id"), F.col("bm25_score").isNotNull().alias("in_corpus"), F.array("page").alias("expected_pages"))
    results = asked.join(pages, "document_id", "left").select(F.col("question_id").alias("query_id"), F.when(F.col("pages").isNull(), "not_in_materials").otherwise("ok").alias("status"), "pages")
    return evaluation.scored(golden, results)


@query("""SELECT document_id, job_id, status, phase, error, created_at FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, job_id DESC) AS rn FROM (SELECT DISTINCT * FROM ingest_jobs WHERE document_id IS NOT NULL)) WHERE rn = 1""")
def latest_job(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.latest(table(spark, folder, "ingest_jobs"))


@query("""WITH j AS (SELECT DISTINCT ON (job_id) * FROM ingest_jobs WHERE status = 'queued' ORDER BY job_id, created_at) SELECT job_id, document_id, phase, created_at FROM j ORDER BY created_at NULLS LAST, job_id LIMIT 25""")
def job_queue_order(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.claim_order(table(spark, folder, "ingest_jobs"), 25)


@query("""SELECT document_id, job_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at NULLS FIRST, job_id) AS rn FROM (SELECT DISTINCT document_id, job_id, created_at FROM ingest_jobs WHERE status IN ('queued','processing') AND document_id IS NOT NULL)) WHERE rn = 1""")
def active_job_per_document(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.active_once(table(spark, folder, "ingest_jobs"))


@query("""SELECT date_trunc('day', created_at) AS window_start, status, count(DISTINCT job_id) AS n FROM ingest_jobs WHERE created_at IS NOT NULL GROUP BY 1, 2""")
def jobs_per_day(spark: SparkSession, folder: str) -> DataFrame:
    counted = jobs.windowed_counts(table(spark, folder, "ingest_jobs"))
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "status", "n")


@query("""WITH j AS (SELECT document_id, status, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC NULLS LAST, job_id DESC) AS rn FROM (SELECT DISTINCT * FROM ingest_jobs WHERE document_id IS NOT NULL))
    SELECT d.document_id, d.status AS document_status, j.status AS job_status, CASE j.status WHEN 'completed' THEN 100 WHEN 'processing' THEN 50 WHEN 'queued' THEN 5 ELSE 0 END AS progress FROM documents d LEFT JOIN (SELECT * FROM j WHERE rn = 1) j USING (document_id)""")
def ingest_status(spark: SparkSession, folder: str) -> DataFrame:
    last = jobs.latest(table(spark, folder, "ingest_jobs")).select("document_id", F.col("status").alias("job_status"))
    docs = table(spark, folder, "documents").select("document_id", F.col("status").alias("document_status"))
    return docs.join(last, "document_id", "left").withColumn("progress", jobs.progress(F.col("job_status")))
