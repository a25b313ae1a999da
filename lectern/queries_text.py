"""Queries over parsed text: outlines, questions, keyphrases, concepts, page quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import exam_parse, outline
from lectern.plans import views
from lectern.queries import query
from lectern.session import table
from lectern.sources import readers

_PAGES = "p AS (SELECT document_id, page, min(text) AS text FROM page_texts GROUP BY 1,2), li AS (SELECT document_id, page, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM p WHERE text IS NOT NULL)"
_SEC = r"'^\s*([0-9]{1,2})\.([0-9]{1,2})\s+(\p{L}.*?)\s*$'"
_SPANS = f"""{_PAGES}, h AS (SELECT document_id, page, line_no, CAST(regexp_extract(line, {_SEC}, 1) AS INTEGER) AS major, CAST(regexp_extract(line, {_SEC}, 2) AS INTEGER) AS minor, regexp_extract(line, {_SEC}, 3) AS title FROM li WHERE regexp_matches(line, {_SEC})),
  f AS (SELECT document_id, major, minor, title, page AS page_start FROM (SELECT *, row_number() OVER (PARTITION BY document_id, major, minor ORDER BY page, line_no) AS rn FROM h) WHERE rn = 1),
  lp AS (SELECT document_id, max(page) AS last_page FROM p GROUP BY 1),
  sp AS (SELECT document_id, major, minor, title, page_start, greatest(page_start, coalesce(lead(page_start) OVER (PARTITION BY document_id ORDER BY page_start, major, minor) - 1, last_page)) AS page_end FROM f JOIN lp USING (document_id))"""


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    pages = views.pages(spark, folder)
    return outline.section_spans(outline.section_headings(pages), pages.groupBy("document_id").agg(F.max("page").alias("last_page")))


@query(f"WITH {_SPANS} SELECT * FROM sp")
def outline_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _spans(spark, folder)


@query(f"WITH {_SPANS} SELECT document_id, major, min(page_start) AS page_start, max(page_end) AS page_end, count(*) AS n_sections FROM sp GROUP BY 1,2")
def outline_units(spark: SparkSession, folder: str) -> DataFrame:
    return outline.unit_ranges(_spans(spark, folder))


_UNIT = r"'^\s*(?i:unit|chapter|module)\s*[-–—:.]?\s*((?i:[ivxl]+)|[0-9]{1,2})\b\s*[-–—:.]*\s*(.*?)\s*$'"


@query(f"""WITH {_PAGES}, u AS (SELECT document_id, page, line_no, lower(regexp_extract(line, {_UNIT}, 1)) AS r, regexp_extract(line, {_UNIT}, 2) AS title FROM li WHERE regexp_matches(line, {_UNIT})),
    m(r, unit_no) AS (VALUES {', '.join(f"('{k}',{v})" for k, v in outline.ROMAN.items())}) SELECT document_id, page, line_no, unit_no, title FROM u JOIN m USING (r)""")
def unit_headings(spark: SparkSession, folder: str) -> DataFrame:
    return outline.unit_headings(views.pages(spark, folder))


@query("""SELECT document_id, CAST(s AS INTEGER) AS page_start, CAST(least(page_count, s + 9) AS INTEGER) AS page_end FROM (SELECT document_id, page_count, unnest(range(1, page_count + 1, 10)) AS s FROM documents WHERE page_count > 0)""")
def stub_outline(spark: SparkSession, folder: str) -> DataFrame:
    return outline.page_buckets(table(spark, folder, "documents"))


@query()
def outline_json(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline_json(_spans(spark, folder))


@query()
def question_parse(spark: SparkSession, folder: str) -> DataFrame:
    papers = table(spark, folder, "documents").where("doc_kind = 'past_paper'").select("document_id")
    # pages of no known format are read as well: most of these tables' papers number their questions without a sign
    return exam_parse.parse_questions(views.pages(spark, folder).join(papers, "document_id", "left_semi"), skip=False)


_E = exam_parse
_M = lambda text, pattern: f"regexp_matches({text}, '{pattern}')"
_FORMATS = f"""pf0 AS (SELECT document_id, page, coalesce(min(text), '') AS text FROM page_texts GROUP BY 1,2),
  pf1 AS (SELECT *, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT {_M('l', _E.WATERMARK)}), chr(10)) AS c FROM pf0),
  pf2 AS (SELECT *, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS t, substr(regexp_replace(c, '^\\s+|\\s+$', '', 'g'), 1, 400) AS h, {_M('c', _E.PART_LINE)} AS parts, {_M('c', _E.COMPULSORY)} OR ({_M('c', _E.COMPULSORY_FIRST)} AND {_M('c', _E.COMPULSORY_NEXT)}) AS comp FROM pf1),
  pf AS (SELECT *, CASE WHEN NOT parts AND NOT comp AND ({_M('h', _E.GOES_ON)} OR ({_M('h', _E.CODE_SHOWN)} AND NOT {_M('h', _E.HEAD)} AND {_M('c', _E.GOES_ON)})) THEN 'continuation' WHEN length(t) < 100 THEN 'skip' WHEN comp THEN 'compulsory_q1' WHEN parts OR {_M('c', _E.NUMBERED)} THEN 'part_ab' ELSE 'skip' END AS format FROM pf2)"""


@query(f"WITH {_FORMATS} SELECT document_id, page, format FROM pf")
def page_formats(spark: SparkSession, folder: str) -> DataFrame:
    return views.pages(spark, folder).select("document_id", "page", exam_parse.paper_format(F.col("text")).alias("format"))


_START = f"({_M('substr(text, 1, 1500)', _E.PAPER_START)} OR {_M('substr(text, 1, 1500)', _E.CODE_LABEL)})"
_TEXT_PARTS = f"{_M('text', _E.PART_LINE)}"
_TEXT_COMP = f"({_M('text', _E.COMPULSORY)} OR ({_M('text', _E.COMPULSORY_FIRST)} AND {_M('text', _E.COMPULSORY_NEXT)}))"


@query(f"""WITH {_FORMATS} SELECT document_id, page, list_filter([CASE WHEN length(text) < 100 THEN 'unreadably_short' END, CASE WHEN format = 'skip' THEN 'format_skip' END,
    CASE WHEN {_START} AND len(regexp_extract_all(text, '{_E.LOOSE_CODE}')) = 0 THEN 'no_code_no' END, CASE WHEN {_START} AND format <> 'continuation' AND NOT {_TEXT_PARTS} AND NOT {_TEXT_COMP} THEN 'no_part_header' END], lambda x: x IS NOT NULL) AS reasons FROM pf""")
def page_drop_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return views.pages(spark, folder).select("document_id", "page", exam_parse.page_drops(F.col("text")).alias("reasons"))


@query(r"""SELECT document_id, paper_label, count(*) AS n_rows, count(DISTINCT nullif(regexp_extract(question_number,'^\s*([0-9]+)',1),'')) AS n_mains, CAST(count(*) FILTER (coalesce(regexp_matches(regexp_replace(lower(question_number),'[.()\s]','','g'),'^[0-9]+[a-g]$'),false)) AS BIGINT) AS n_subs FROM (SELECT DISTINCT * FROM exam_questions) GROUP BY ALL""")
def draft_counts(spark: SparkSession, folder: str) -> DataFrame:
    return exam_parse.draft_counts(table(spark, folder, "exam_questions").distinct(), "document_id", "paper_label")


_TREE_LINES = r"""tl AS (SELECT doc_id AS id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS node_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
  tn AS (SELECT id, node_no, length(regexp_extract(replace(line, chr(9), '    '), '^( *)', 1)) AS ind, trim(regexp_replace(trim(regexp_replace(line, '[\s\x0B]', ' ', 'g'), ' '), '^[-*•]\s*', ''), ' ') AS title FROM tl),
  tm AS (SELECT id, node_no, CASE WHEN ind = 0 THEN 0 WHEN ind < 4 THEN 1 ELSE 2 END AS level, title FROM tn WHERE title <> ''),
  tp AS (SELECT *, max(CASE WHEN level = 0 THEN node_no END) OVER w AS u, max(CASE WHEN level = 1 THEN node_no END) OVER w AS p FROM tm WINDOW w AS (PARTITION BY id ORDER BY node_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {_TREE_LINES} SELECT id, node_no, level, md5(title) AS title, CASE WHEN level = 1 THEN u WHEN level = 2 THEN CASE WHEN p > coalesce(u, -1) THEN p ELSE u END END AS parent_no FROM tp")
def pasted_trees(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's lines as an indented list."""
    return outline.pasted_tree(table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("title", F.md5("title"))


_SECTIONS = "sn AS (SELECT course_id AS document_id, unit AS unit_id, section_title AS title, min(page) AS page_start, max(page) AS page_end FROM exam_questions WHERE course_id IS NOT NULL AND unit IS NOT NULL AND section_title IS NOT NULL AND page IS NOT NULL GROUP BY ALL)"


def _course_sections(spark: SparkSession, folder: str) -> DataFrame:
    """The sections of each course as its outline, by the pages that ask for them."""
    rows = table(spark, folder, "exam_questions").where("course_id IS NOT NULL AND unit IS NOT NULL AND section_title IS NOT NULL AND page IS NOT NULL")
    return rows.groupBy(F.col("course_id").alias("document_id"), F.col("unit").alias("unit_id"), F.col("section_title").alias("title")).agg(F.min("page").alias("page_start"), F.max("page").alias("page_end"))


@query(f"""WITH {_SECTIONS}, o AS (SELECT document_id, count(DISTINCT unit_id) AS n_units, count(*) AS n_sections, bool_and(regexp_matches(title, '{outline.BUCKET_TITLE}')) AS is_bucket, avg(page_end - page_start + 1) AS span FROM sn GROUP BY 1)
    SELECT document_id, n_units, n_sections, is_bucket, n_sections >= 2 AND NOT is_bucket AS valid, CASE WHEN n_units BETWEEN 3 AND 12 THEN 'chapter' ELSE 'section' END AS granularity,
      CASE WHEN is_bucket OR n_sections < 3 THEN 'low' WHEN n_units BETWEEN 3 AND 12 AND span >= 3 THEN 'high' ELSE 'medium' END AS quality, n_sections > 30 AND n_units > 12 AS too_granular FROM o""")
def outline_quality(spark: SparkSession, folder: str) -> DataFrame:
    return outline.outline_checks(_course_sections(spark, folder))


@query(f"""WITH {_SECTIONS}, r AS (SELECT *, row_number() OVER w = 1 OR page_end - page_start + 1 >= 3 OR regexp_matches(title, '^\\s*([0-9]{{1,2}})\\.([0-9]{{1,2}})\\s+(\\p{{L}}.*?)\\s*$') AS op FROM sn WINDOW w AS (PARTITION BY document_id, unit_id ORDER BY page_start, page_end, title)),
    g AS (SELECT *, sum(CAST(op AS INTEGER)) OVER (PARTITION BY document_id, unit_id ORDER BY page_start, page_end, title) AS run FROM r) SELECT document_id, unit_id, max(CASE WHEN op THEN title END) AS title, min(page_start) AS page_start, max(page_end) AS page_end FROM g GROUP BY document_id, unit_id, run""")
def outline_merged(spark: SparkSession, folder: str) -> DataFrame:
    return outline.merge_short(_course_sections(spark, folder))


@query(rf"""WITH li0 AS (SELECT DISTINCT trim(unnest(string_split(text, chr(10))), ' ') AS title FROM page_texts WHERE text IS NOT NULL),
    ti AS (SELECT title, length(title) AS n, length(regexp_replace(title, '\P{{Nd}}', '', 'g')) AS dg, length(regexp_replace(title, '\P{{L}}', '', 'g')) AS le FROM li0)
    SELECT md5(title) AS title, NOT regexp_matches(title, '{outline.SUBUNIT}') AND (regexp_matches(title, '{outline.CHAPTER}') OR regexp_matches(title, '{outline.NUMBERED_CHAPTER}')) AS is_chapter,
      md5(coalesce(nullif(trim(regexp_replace(title, '{outline.CHAPTER_PREFIX}', ''), ' '), ''), title)) AS chapter_title,
      CAST(coalesce(nullif(regexp_extract(title, '{outline.SUBUNIT}', 1), ''), nullif(regexp_extract(title, '{outline.NUMBERED_SECTION}', 1), ''), nullif(regexp_extract(title, '{outline.MAJOR_UNIT}', 1), '')) AS INTEGER) AS major_unit,
      n BETWEEN 3 AND 120 AND NOT regexp_matches(title, '{outline.MATH}') AND NOT regexp_matches(title, '{outline.FORMULA}') AND dg <= n * 0.35 AND le >= 3 AS is_title FROM ti""")
def heading_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every different line of the pages as a heading: chapter, its title, its unit, whether it is one at all."""
    lines = table(spark, folder, "page_texts").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("title")).select(F.trim("title").alias("title")).distinct()
    t = F.col("title")
    return lines.select(F.md5(t).alias("title"), outline.is_chapter(t).alias("is_chapter"), F.md5(outline.chapter_title(t)).alias("chapter_title"), outline.major_unit(t).alias("major_unit"), outline.is_section_title(t).alias("is_title"))


@query(r"""SELECT question_id, CAST(nullif(regexp_extract(paper_label,'(20[0-9]{2})',1),'') AS INTEGER) AS year, nullif(regexp_extract(question_number,'^\s*([0-9]+)',1),'') AS main, coalesce(regexp_matches(regexp_replace(lower(question_number),'[.()\s]','','g'),'^[0-9]+[a-g]$'),false) AS is_subpart,
    CASE WHEN length(prompt_text) > 160 THEN rtrim(substr(prompt_text,1,157), ' ')||'...' ELSE prompt_text END AS snippet FROM (SELECT DISTINCT * FROM exam_questions)""")
def paper_code_year(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "exam_questions").distinct()
    number = F.col("question_number")
    return rows.select("question_id", fn.year_of(F.col("paper_label")).alias("year"), fn.main_number(number).alias("main"), fn.is_subpart(number).alias("is_subpart"), fn.snippet(F.col("prompt_text")).alias("snippet"))


@query()
def fuzzy_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """Each question against the next of its paper and section: the overlap of their prompts."""
    rows = views.questions(spark, folder).select("question_id", "document_id", "section_title", "prompt_text").where("section_title IS NOT NULL")
    from pyspark.sql import Window

    window = Window.partitionBy("document_id", "section_title").orderBy("question_id")
    pairs = rows.select("question_id", "prompt_text", F.lead("question_id").over(window).alias("other_id"), F.lead("prompt_text").over(window).alias("other_text")).where("other_id IS NOT NULL")
    return exam_parse.fuzzy_pairs(pairs, "prompt_text", "other_text").select("question_id", "other_id", "overlap")


@query("""WITH p AS (SELECT document_id, page, min(text) AS text, bool_or(used_ocr) AS u FROM page_texts GROUP BY 1,2), s AS (SELECT document_id, min(page) AS f, max(page) AS l, count(*) AS n FROM p GROUP BY 1),
    k AS (SELECT p.* FROM p JOIN s USING (document_id) WHERE ((page - f) % greatest(1, n // 12) = 0 AND (page - f) / greatest(1, n // 12) < 11) OR page = l),
    a AS (SELECT document_id, count(*) AS n_pages, round(avg(CASE WHEN length(trim(coalesce(text,''))) <= 50 THEN 1 ELSE 0 END),6) AS empty_ratio, round(avg(CASE WHEN coalesce(u,false) THEN 1 ELSE 0 END),6) AS ocr_ratio, round(avg(length(coalesce(text,''))),2) AS mean_chars FROM k GROUP BY 1)
    SELECT *, CASE WHEN empty_ratio >= 0.2 OR ocr_ratio >= 0.35 THEN 'ocr' ELSE 'native' END AS tier FROM a""")
def page_quality(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_texts").groupBy("document_id", "page").agg(F.min("text").alias("text"), F.max("used_ocr").alias("used_ocr"))
    return readers.page_quality(pages)
