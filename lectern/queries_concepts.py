"""Queries of keyphrases, concepts and their labels, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import PHRASE_STOPWORDS
from lectern.operators import answering, concepts, labels
from lectern.plans import views
from lectern.queries import _Q, query

_STOP = ", ".join(f"'{w}'" for w in PHRASE_STOPWORDS)
_FLAT = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))".format
_WORDS = f"list_filter(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]{{1,}}'), lambda w: NOT list_contains([{_STOP}], lower(w)))"
_LONG = r"'([A-Za-z][A-Za-z\s\-]{2,}?)\s*\(([A-Z]{2,})\)'"
_RUNS = lambda n: f"list_transform(range(1, greatest(0, len(ws) - {n - 1}) + 1), lambda i: array_to_string(list_slice(ws, i, i + {n - 1}), ' '))"
_PHRASES = rf"""{_Q}, kt AS (SELECT question_id, course_id AS scope, trim(prompt_text, ' ') AS text FROM q WHERE trim(coalesce(prompt_text, ''), ' ') <> ''),
  kw AS (SELECT *, {_FLAT('text')} AS flat, {_WORDS} AS ws, regexp_extract_all(text, {_LONG}, 1) AS longs, regexp_extract_all(text, {_LONG}, 2) AS shorts FROM kt),
  kc AS (SELECT *, list_concat(flatten(list_transform(range(1, len(longs) + 1), lambda i: [trim(longs[i], ' '), shorts[i]])), regexp_extract_all(text, '\b[A-Z]{{2,}}\b'), {_RUNS(3)}, {_RUNS(2)}, {_RUNS(1)}) AS cs FROM kw),
  ke AS (SELECT question_id, scope, flat, longs, shorts, unnest(cs) AS written, unnest(range(len(cs))) AS place FROM kc),
  kn AS (SELECT *, {_FLAT('written')} AS phrase FROM ke),
  k1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, scope, phrase ORDER BY place) AS rn FROM kn WHERE length(phrase) >= 3 AND phrase NOT IN ({_STOP})) WHERE rn = 1),
  kp AS (SELECT *, string_split(flat, phrase) AS parts FROM k1),
  ks AS (SELECT question_id, scope, phrase, longs, shorts, round(least(1.0, (CASE WHEN len(parts) > 1 THEN list_sum(list_transform(range(1, len(parts)), lambda i: 1 / log2(CAST(list_sum(list_transform(list_slice(parts, 1, i), lambda p: length(p))) + (i - 1) * length(phrase) + 2 AS DOUBLE)))) / (len(parts) - 1) / (len(parts) - 1) ELSE 1.0 END)
    * CASE WHEN regexp_matches(written, '^\p{{Lu}}') THEN CAST(1.5 AS DOUBLE) ELSE 1.0 END * least(CAST(3.0 AS DOUBLE), 1 + (len(string_split(phrase, ' ')) - 1) * CAST(0.35 AS DOUBLE)) / CAST(2.5 AS DOUBLE)), 6) AS score FROM kp),
  kl AS (SELECT question_id, scope, score, coalesce(list_last(list_filter(list_transform(range(1, len(longs) + 1), lambda i: CASE WHEN {_FLAT('shorts[i]')} = phrase THEN {_FLAT('longs[i]')} END), lambda x: x IS NOT NULL)), phrase) AS phrase FROM ks),
  kb AS (SELECT question_id, scope, phrase, max(score) AS score FROM kl GROUP BY ALL),
  kr AS (SELECT question_id, scope, phrase, score FROM (SELECT *, row_number() OVER (PARTITION BY question_id, scope ORDER BY score DESC, length(phrase) DESC, phrase) AS rn FROM kb) WHERE rn <= 8)"""


@query(f"WITH {_PHRASES} SELECT * FROM kr")
def keyphrases(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.extract(views.questions(spark, folder))


_GENERIC = ", ".join(f"'{w}'" for w in dict.fromkeys(labels.GENERIC))
_ACRONYMS = ", ".join(f"'{w}'" for w in dict.fromkeys(labels.ACRONYMS))
_CONTENT = f"list_filter({{0}}, lambda w: NOT list_contains([{_GENERIC}], w))"
_TITLED = "array_to_string(list_transform({}, lambda w: upper(w[1]) || w[2:]), ' ')".format
_GARBAGE = f"len(list_filter(ws, lambda w: NOT list_contains([{_ACRONYMS}], w) AND (length(w) <= 2 OR (length(w) <= 3 AND w = upper(w) AND regexp_matches(w, '\\p{{L}}')) OR regexp_matches(w, '{labels.MISREAD}')))) > 0"


@query(rf"""WITH {_PHRASES}, pa AS (SELECT DISTINCT phrase FROM kr), pw AS (SELECT phrase, string_split(phrase, ' ') AS ws, {_CONTENT.format("string_split(phrase, ' ')")} AS cs FROM pa)
    SELECT phrase, CASE WHEN regexp_matches(phrase, '{labels.MISREAD}') OR len(ws) <= 1 OR regexp_matches(phrase, '{labels.OPEN_END}') THEN true WHEN regexp_matches(phrase, '{labels.NOISE_BEGIN}') AND len(ws) <= 4 THEN true WHEN {_GARBAGE} THEN true
      WHEN len(list_distinct(ws)) < len(ws) AND len(list_filter(ws, lambda w: length(w) > 4)) = 0 THEN true WHEN len(cs) = 0 THEN true WHEN len(ws) > len(cs) THEN len(cs) < 2 ELSE len(cs) = 2 AND len(list_filter(cs, lambda w: length(w) >= 5)) = 0 END AS noise,
      {_TITLED("string_split(regexp_replace(phrase, '" + labels.FILLER + "', ''), ' ')")} AS polished,
      CASE WHEN len(cs) >= 2 OR (len(cs) = 1 AND length(cs[1]) >= 6) THEN {_TITLED("cs")} END AS rebuilt, len(cs) AS content FROM pw""")
def phrase_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Every keyphrase as a label: whether it is noise, polished, of its content words alone."""
    phrase = F.col("phrase")
    rows = concepts.extract(views.questions(spark, folder)).select("phrase").distinct()
    return rows.select("phrase", labels.is_noise(phrase).alias("noise"), labels.polished(phrase).alias("polished"), labels.rebuilt(phrase).alias("rebuilt"), F.size(labels.content_words(phrase)).cast("long").alias("content"))


@query()
def concept_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.labelled(concepts.cluster(concepts.extract(views.questions(spark, folder))))


def _derived(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions = views.questions(spark, folder)
    phrases = concepts.extract(questions)
    named = concepts.labelled(concepts.cluster(phrases))
    terms = named.select("scope", F.explode("terms").alias("phrase"), F.col("label").alias("concept"))
    return questions, named, concepts.concept_links(questions, phrases, terms)


@query()
def derived_concept_links(spark: SparkSession, folder: str) -> DataFrame:
    return _derived(spark, folder)[2]


@query()
def derivation_stats(spark: SparkSession, folder: str) -> DataFrame:
    return concepts.derivation_stats(*_derived(spark, folder))


@query(f"""WITH {_Q}, s AS (SELECT course_id AS scope, section_title AS label, list_sort(list_distinct(list(unit) FILTER (unit IS NOT NULL))) AS units FROM q WHERE trim(section_title, ' ') <> '' GROUP BY ALL),
    w AS (SELECT scope, label, regexp_replace(trim(label, ' '), '\\s+', ' ', 'g') AS l, coalesce(list_filter(units, lambda u: lower(u) <> lower(label)), []) AS us FROM s)
    SELECT scope, label, 'Explain ' || l || CASE WHEN len(us) > 0 THEN ' (also: ' || array_to_string(list_slice(us, 1, 4), ', ') || ')' ELSE '' END || '. Use course notes and syllabus.' AS question FROM w""")
def concept_questions(spark: SparkSession, folder: str) -> DataFrame:
    """What is asked for each section of a course, its units as further terms."""
    rows = views.questions(spark, folder).where("trim(section_title) <> ''").groupBy("scope", F.col("section_title").alias("label")).agg(F.array_sort(F.collect_set("unit")).alias("units"))
    return rows.select("scope", "label", answering.concept_question(F.col("label"), F.col("units"), F.array().cast("array<string>")).alias("question"))


@query(f"""WITH {_Q}, t AS (SELECT course_id AS scope, section_title AS title, min(page) AS ordinal FROM q WHERE section_title IS NOT NULL GROUP BY ALL), u AS (SELECT course_id AS scope, section_title AS title, unit, row_number() OVER (PARTITION BY course_id ORDER BY unit, section_title) - 1 AS unit_no FROM (SELECT DISTINCT course_id, unit, section_title FROM q WHERE unit IS NOT NULL AND section_title IS NOT NULL)),
    z AS (SELECT a.scope, n = m AS placed FROM (SELECT scope, count(*) AS n FROM t GROUP BY 1) a JOIN (SELECT scope, count(*) AS m FROM u GROUP BY 1) b USING (scope)), p AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY ordinal NULLS FIRST, title) - 1 AS place FROM t)
    SELECT scope, md5(p.title) AS topic_id, CAST(min(unit_no) AS INTEGER) AS unit_no FROM p JOIN z USING (scope) JOIN u USING (scope) WHERE CASE WHEN placed THEN place = unit_no ELSE contains(lower(p.title), lower(u.title)) OR contains(lower(u.title), lower(p.title)) END GROUP BY scope, p.title""")
def topic_units(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of a course as topics, by page, matched to its sections in the order of their units."""
    questions = views.questions(spark, folder).where("section_title IS NOT NULL")
    topics = questions.groupBy("scope", F.col("section_title").alias("title")).agg(F.min("page").alias("ordinal")).withColumn("topic_id", F.md5("title"))
    listed = questions.where("unit IS NOT NULL").select("scope", "unit", F.col("section_title").alias("title")).distinct()
    units = listed.withColumn("unit_no", F.row_number().over(Window.partitionBy("scope").orderBy("unit", "title")) - 1).drop("unit")
    return answering.match_topics(topics, units)
