"""Queries of hybrid retrieval, outline hints and predictions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import LEXICAL_MARKERS, QUERY_STOPWORDS
from lectern.operators import analytics, hints, ranking, retrieval, scope
from lectern.plans import views
from lectern.queries import _ROWS, _WORD, covers_sql, query
from lectern.session import table

_MODEL, _SIZE = "study-embed-small-v2", 384


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vector): each chunk's usable vector once."""
    rows = table(spark, folder, "chunk_embeddings").where((F.col("embedding_model") == _MODEL) & (F.size("embedding") == _SIZE))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    return rows.where(good).groupBy(F.col("chunk_id").alias("id")).agg(F.min("embedding").alias("vector"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question a course, a set that doesn't grow: the prompt of its smallest question with the section's title."""
    rows = views.questions(spark, folder).where(F.col("prompt_text").isNotNull())
    first = rows.groupBy("scope").agg(F.min(F.struct("question_id", F.concat_ws(" ", "prompt_text", "section_title").alias("text"))).alias("first"))
    return first.select(F.col("scope").alias("query_id"), "scope", "first.text")


def _asking(spark: SparkSession, folder: str, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """The questions with a vector: that of the course's smallest chunk of the lane, for want of a model."""
    first = vectors.join(chunks.select("id", "scope"), "id").groupBy("scope").agg(F.min_by("vector", "id").alias("vector"))
    return _questions(spark, folder).join(first, "scope", "left").select("query_id", "scope", "text", "vector")


_STOP = ", ".join(f"'{w}'" for w in QUERY_STOPWORDS)
_FOCUS = rf"""list_slice(list_filter(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda x: NOT list_contains([{_STOP}], x)), lambda x, i: list_position(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}'), lambda y: NOT list_contains([{_STOP}], y)), x) = i), 1, 8)"""
_QN = "qn AS (SELECT course_id AS query_id, course_id AS scope, min(struct_pack(q := question_id, t := concat_ws(' ', prompt_text, section_title))).t AS text FROM exam_questions WHERE course_id IS NOT NULL AND prompt_text IS NOT NULL GROUP BY course_id)"
_HEAVY = " OR ".join(f"contains(lower(text), '{m}')" for m in LEXICAL_MARKERS)
_DOUBLE = "CAST({} AS DOUBLE)".format


def _lane_sql(kinds: tuple[str, ...]) -> str:
    """docs, ck (chunks of the lane), ve (vectors), qn (questions) and near, any-term and title lists."""
    listed = ", ".join(f"'{k}'" for k in kinds)
    top = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM"
    dense = lambda name, texts: f"""{name}p AS (SELECT id, scope, unnest(regexp_extract_all(lower(text), {_WORD})) AS term FROM ({texts})),
  {name} AS (SELECT * FROM ({top} (SELECT query_id, id, round(count(*) * {_DOUBLE(0.1)}, 6) AS score FROM ft JOIN {name}p USING (scope, term) GROUP BY ALL)) WHERE rank <= 40)"""  # noqa: E731
    return f"""docs AS (SELECT document_id, course_id AS scope FROM documents WHERE doc_kind IN ({listed}) AND status = 'ready' AND course_id IS NOT NULL),
  c0 AS (SELECT chunk_id AS id, min(document_id) AS document_id, min(parent_id) AS parent_id, min(chunk_index) AS chunk_index, min(page) AS page, min(text) AS text, min(metadata['unit']) AS unit, min(metadata['section_title']) AS section, min(metadata['toc_path']) AS toc FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1),
  ck AS (SELECT c0.*, scope FROM c0 JOIN docs USING (document_id)),
  ve AS (SELECT chunk_id AS id, min(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM chunk_embeddings WHERE embedding_model = '{_MODEL}' AND len(embedding) = {_SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {_SIZE} AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1),
  {_QN}, iv AS (SELECT id, scope, v FROM ve JOIN ck USING (id)), qv AS (SELECT query_id, scope, arg_min(v, id) AS q FROM qn JOIN iv USING (scope) GROUP BY ALL),
  near AS (SELECT * FROM ({top} (SELECT query_id, id, round(list_cosine_similarity(v, q), 6) AS score FROM qv JOIN iv USING (scope))) WHERE rank <= 40),
  ft AS (SELECT DISTINCT query_id, scope, term FROM (SELECT query_id, scope, regexp_replace(unnest({_FOCUS}), '[^a-zA-Z0-9]', '', 'g') AS term FROM qn) WHERE length(term) >= 3),
  {dense("anyt", "SELECT id, scope, text FROM ck WHERE text IS NOT NULL")},
  {dense("tit", "SELECT id, scope, concat_ws(' ', section, toc) AS text FROM ck WHERE coalesce(section, toc) IS NOT NULL")},
  {covers_sql(f"SELECT query_id, scope, unnest(regexp_extract_all(lower(text), {_WORD})) AS term FROM qn", "SELECT id, scope, text FROM ck")},
  full_ AS (SELECT * FROM ({top} sc) WHERE rank <= 40),
  wt AS (SELECT query_id, CASE WHEN {_HEAVY} THEN {_DOUBLE(0.85)} ELSE {_DOUBLE(1.0)} END AS wv, CASE WHEN {_HEAVY} THEN {_DOUBLE(1.75)} ELSE {_DOUBLE(1.0)} END AS wl FROM qn)"""


_UNION = f"""SELECT query_id, id, wv / (60 + rank) AS p FROM near JOIN wt USING (query_id) UNION ALL SELECT query_id, id, wl / (60 + rank) FROM full_ JOIN wt USING (query_id)
  UNION ALL SELECT query_id, id, wl * {_DOUBLE(1.1)} / (60 + rank) FROM anyt JOIN wt USING (query_id) UNION ALL SELECT query_id, id, wl * {_DOUBLE(0.8)} / (60 + rank) FROM tit JOIN wt USING (query_id)"""


def _fused_sql(kinds: tuple[str, ...], more: str = "", union: str = "") -> str:
    return f"""WITH {_lane_sql(kinds)}{more}, fu AS (SELECT query_id, id, round(sum(p), 10) AS fused, count(*) AS n_lists FROM ({_UNION}{union}) GROUP BY ALL)
  SELECT query_id, id, fused, n_lists, CAST(rank AS INTEGER) AS rank, vector_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS rank FROM fu) LEFT JOIN (SELECT query_id, id, score AS vector_score FROM near) USING (query_id, id) WHERE rank <= 24"""


def _study(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks = retrieval.scoped_chunks(table(spark, folder, "chunks"), table(spark, folder, "documents"), scope.STUDY)
    vectors = _vectors(spark, folder)
    return _asking(spark, folder, chunks, vectors), chunks, vectors


@query(_fused_sql(scope.STUDY))
def hybrid_study(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.hybrid(*_study(spark, folder))


_EXAM_LIST = f""", eq AS (SELECT DISTINCT question_id, course_id AS scope, document_id, page, prompt_text FROM exam_questions WHERE course_id IS NOT NULL),
  ep AS (SELECT question_id AS id, scope, unnest(regexp_extract_all(lower(prompt_text), {_WORD})) AS term FROM eq WHERE prompt_text IS NOT NULL),
  eh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM (SELECT query_id, id, round(count(*) * {_DOUBLE(0.1)}, 6) AS score FROM ft JOIN ep USING (scope, term) GROUP BY ALL)) WHERE rn <= 20),
  fc AS (SELECT document_id, page, id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY chunk_index NULLS LAST, id) AS rn FROM ck WHERE page IS NOT NULL) WHERE rn = 1),
  eb AS (SELECT query_id, fc.id, score, eq.question_id, row_number() OVER (PARTITION BY query_id, fc.id ORDER BY score DESC, eq.question_id) AS rn FROM eh JOIN eq ON eq.question_id = eh.id JOIN fc USING (document_id, page)),
  ql AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, question_id) AS rank FROM eb WHERE rn = 1)"""


@query(_fused_sql(scope.EXAM, _EXAM_LIST, f" UNION ALL SELECT query_id, id, {_DOUBLE(1.35)} / (60 + rank) FROM ql"))
def hybrid_exam(spark: SparkSession, folder: str) -> DataFrame:
    chunks = retrieval.scoped_chunks(table(spark, folder, "chunks"), table(spark, folder, "documents"), scope.EXAM)
    vectors = _vectors(spark, folder)
    questions = _asking(spark, folder, chunks, vectors)
    asked = views.questions(spark, folder).select("question_id", "scope", "document_id", "page", "prompt_text").distinct()
    return retrieval.hybrid(questions, chunks, vectors, more=retrieval.question_list(questions, asked, chunks))


def _outline(spark: SparkSession, folder: str) -> DataFrame:
    """Outlines of the courses: the pages on which each section is asked about."""
    rows = views.questions(spark, folder).where("unit IS NOT NULL AND section_title IS NOT NULL AND page IS NOT NULL")
    return rows.groupBy("scope", F.col("unit").alias("unit_id"), "section_title").agg(F.min("page").alias("page_start"), F.max("page").alias("page_end")).withColumn("unit_title", F.concat(F.lit("Unit "), "unit_id"))


_OUTLINE = f"""{_QN}, ol AS (SELECT course_id AS scope, unit AS unit_id, section_title, 'Unit ' || unit AS unit_title, min(page) AS page_start, max(page) AS page_end FROM exam_questions WHERE course_id IS NOT NULL AND unit IS NOT NULL AND section_title IS NOT NULL AND page IS NOT NULL GROUP BY ALL),
  tk AS (SELECT DISTINCT scope, unit_id, unnest(string_split_regex(lower(section_title), '[^a-z0-9]+')) AS t FROM ol),
  ph AS (SELECT DISTINCT * FROM (SELECT scope, unit_id, trim(lower(unit_title)) AS phrase FROM ol UNION ALL SELECT scope, unit_id, trim(lower(section_title)) FROM ol UNION ALL SELECT scope, unit_id, t FROM tk) WHERE length(phrase) >= 4),
  tm AS (SELECT scope, unit_id, t AS term FROM tk WHERE length(t) >= 5),
  hu AS (SELECT query_id, unit_id, sum(p) AS score FROM (SELECT query_id, unit_id, {_DOUBLE(3.0)} AS p FROM qn JOIN ph USING (scope) WHERE contains(lower(text), phrase) UNION ALL SELECT query_id, unit_id, {_DOUBLE(1.0)} FROM (SELECT query_id, scope, unnest({_FOCUS}) AS term FROM qn) JOIN tm USING (scope, term)) GROUP BY ALL HAVING sum(p) >= 2),
  ur AS (SELECT scope, unit_id, unit_title, min(page_start) AS page_start, max(page_end) AS page_end FROM ol GROUP BY ALL),
  hp AS (SELECT DISTINCT query_id, page_start, page_end FROM qn JOIN (SELECT scope, trim(lower(section_title)) AS phrase, page_start, page_end FROM ol UNION SELECT scope, trim(lower(unit_title)), page_start, page_end FROM ur) USING (scope) WHERE length(phrase) >= 4 AND contains(lower(text), phrase))"""


@query(f"WITH {_OUTLINE} SELECT query_id, unit_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS INTEGER) AS rank FROM hu")
def hint_units(spark: SparkSession, folder: str) -> DataFrame:
    outline = _outline(spark, folder)
    return hints.infer_units(_questions(spark, folder), hints.unit_phrases(outline), hints.unit_terms(outline))


@query(f"WITH {_OUTLINE} SELECT * FROM hp")
def hint_pages(spark: SparkSession, folder: str) -> DataFrame:
    return hints.page_ranges(_questions(spark, folder), hints.page_hints(_outline(spark, folder)))


_PATTERNS = """pt AS (SELECT DISTINCT * FROM (SELECT scope, unit_id, section_title, trim(lower(section_title)) AS phrase FROM ol UNION ALL SELECT scope, unit_id, section_title, trim(lower(unit_title)) FROM ol
    UNION ALL SELECT scope, unit_id, section_title, unnest(list_filter(string_split_regex(lower(section_title), '[^a-z0-9]+'), lambda t: length(t) >= 5)) FROM ol
    UNION ALL SELECT o.scope, o.unit_id, o.section_title, p.phrase FROM ol o JOIN (SELECT * FROM ph UNION SELECT scope, unit_id, term FROM tm) p ON p.scope = o.scope AND p.unit_id = o.unit_id) WHERE length(phrase) >= 4)"""


@query(f"""WITH {_OUTLINE}, {_PATTERNS}, dk AS (SELECT document_id, course_id AS scope, filename FROM documents WHERE doc_kind = 'past_paper' AND status = 'ready' AND course_id IS NOT NULL),
    pc AS (SELECT scope, filename, page, min(text) AS text FROM chunks c JOIN dk USING (document_id) WHERE length(trim(text, ' ')) >= 100 GROUP BY ALL),
    hs AS (SELECT pc.scope, filename, page, unit_id, section_title, sum(length(phrase)) AS score FROM pc JOIN pt ON pt.scope = pc.scope WHERE contains(lower(text), phrase) GROUP BY ALL),
    hb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, filename, page ORDER BY score DESC, unit_id, section_title) AS rn FROM hs) WHERE rn = 1), fu AS (SELECT scope, min(unit_id) AS first FROM ol GROUP BY 1)
    SELECT pc.scope, coalesce(unit_id, first, 'general') AS unit_id, coalesce(section_title, 'Unclassified') AS section_title, count(*) AS n FROM pc LEFT JOIN hb ON hb.scope = pc.scope AND hb.filename IS NOT DISTINCT FROM pc.filename AND hb.page IS NOT DISTINCT FROM pc.page LEFT JOIN fu ON fu.scope = pc.scope GROUP BY ALL""")
def past_paper_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The readable pages of past papers by the section that they ask for."""
    docs = scope.lane(table(spark, folder, "documents"), scope.EXAM).where("course_id IS NOT NULL").select("document_id", F.col("course_id").alias("scope"), F.col("filename").alias("file"))
    pages = table(spark, folder, "chunks").select("document_id", "page", "text").join(docs, "document_id")
    return hints.page_counts(pages, _outline(spark, folder))


def _reranked(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    questions, chunks, vectors = _study(spark, folder)
    hits = retrieval.with_parents(retrieval.hybrid(questions, chunks, vectors), chunks, table(spark, folder, "chunk_parents"))
    raw = 4 * F.coalesce("vector_score", F.lit(0.0)) - 2  # for want of a reranking model
    return questions, retrieval.rerank(hits, questions, retrieval.outline_hints(questions, _outline(spark, folder)), raw)


@query()
def retrieval_study(spark: SparkSession, folder: str) -> DataFrame:
    """The whole plan: lists, fusion, parents, boosts, gate and budget."""
    questions, ranked = _reranked(spark, folder)
    context, _ = retrieval.answerable(questions, ranked, ranking.GATES["study"])
    return context.select("query_id", "id", "rank", "page", "score", "kept")


@query()
def retrieval_status(spark: SparkSession, folder: str) -> DataFrame:
    questions, ranked = _reranked(spark, folder)
    return retrieval.answerable(questions, ranked, ranking.GATES["study"])[1]


_RND = "CAST(round(CAST({} AS DECIMAL(28,10)), {}) AS DOUBLE)".format
_UNIT_FEATURES = f"""{_ROWS}, us AS (SELECT scope, coalesce(unit,'Unmapped') AS label, count(*) AS n_rows FROM rows_ GROUP BY ALL), sh AS (SELECT scope, label, {_RND('100.0*n_rows/sum(n_rows) OVER (PARTITION BY scope)', 1)} AS weightage_pct FROM us),
  dy AS (SELECT scope, unit AS label, CAST(nullif(regexp_extract(paper_label,'(20[0-9]{{2}})',1),'') AS INTEGER) AS year FROM rows_), cy AS (SELECT scope, label, year, count(*) AS n FROM dy WHERE year IS NOT NULL GROUP BY ALL),
  ys AS (SELECT scope, count(DISTINCT year) AS years FROM cy GROUP BY 1), ox AS (SELECT *, row_number() OVER (PARTITION BY scope, label ORDER BY year) - 1 AS x FROM cy WHERE label IS NOT NULL),
  ow AS (SELECT scope, label, count(*) AS present, CASE WHEN count(*) > 1 THEN round(regr_slope(n, x), 4) END AS trend_slope FROM ox GROUP BY ALL),
  uf AS (SELECT sh.scope, sh.label, weightage_pct, CASE WHEN years IS NULL THEN 1.0 ELSE {_RND('CAST(coalesce(present,0) AS DOUBLE)/years', 4)} END AS recurrence_rate, trend_slope FROM sh LEFT JOIN ys ON ys.scope = sh.scope LEFT JOIN ow ON ow.scope = sh.scope AND ow.label = sh.label WHERE lower(sh.label) NOT IN ('unmapped','unclassified'))"""


@query(f"WITH {_UNIT_FEATURES} SELECT scope, label, weightage_pct, CAST(recurrence_rate AS DOUBLE) AS recurrence_rate, trend_slope FROM uf")
def unit_features(spark: SparkSession, folder: str) -> DataFrame:
    return analytics.unit_features(views.questions(spark, folder))


_TOPICS = f"""t0 AS (SELECT scope, section_title AS topic, count(*) AS n FROM rows_ WHERE section_title IS NOT NULL GROUP BY ALL), t1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY n DESC, topic) AS rn FROM t0) WHERE rn <= 10),
  pk AS (SELECT scope, max(n) AS peak FROM t1 GROUP BY 1), tf AS (SELECT scope, topic AS label, {_RND('100.0*n/peak', 4)} AS weightage_pct, {_RND('CAST(n AS DOUBLE)/peak', 4)} AS recurrence_rate, CAST(NULL AS DOUBLE) AS trend_slope FROM t1 JOIN pk USING (scope) WHERE trim(topic) <> '')"""


def _scored_sql(kind: str, rows: str, most: int) -> str:
    trend = "CASE WHEN trend_slope IS NULL THEN 0.0 WHEN high = low THEN 1.0 ELSE (trend_slope - low) / (high - low) END"
    share = "CASE WHEN top > 0 THEN weightage_pct / top ELSE 0.0 END"
    score = _RND(f"{_DOUBLE(0.45)} * ({share}) + {_DOUBLE(0.35)} * coalesce(recurrence_rate, 0.0) + {_DOUBLE(0.2)} * ({trend})", 4)
    reasons = f"list_filter([CASE WHEN {share} >= 0.6 THEN 'high_weightage' END, CASE WHEN recurrence_rate >= 0.5 THEN 'recurs_across_papers' END, CASE WHEN trend_slope > 0 THEN 'rising_trend' END], lambda x: x IS NOT NULL)"
    return f"""SELECT '{kind}' AS kind, scope, label, score, reasons, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY score DESC, lower(label), label) AS rank FROM (SELECT scope, label, {score} AS score, {reasons} AS reasons
      FROM {rows} JOIN (SELECT scope, max(weightage_pct) AS top, min(trend_slope) AS low, max(trend_slope) AS high FROM {rows} GROUP BY scope) USING (scope))) WHERE rank <= {most}"""


@query(f"WITH {_UNIT_FEATURES}, {_TOPICS} {_scored_sql('unit', 'uf', 5)} UNION ALL {_scored_sql('topic', 'tf', 5)}")
def unit_topic_predictions(spark: SparkSession, folder: str) -> DataFrame:
    questions = views.questions(spark, folder)
    units, topics = analytics.unit_features(questions), analytics.topic_features(analytics.top_topics(questions))
    return analytics.all_predictions(units.where("false"), units, topics)
