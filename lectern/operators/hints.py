"""What a course's outline tells about a question: likely units and page ranges.

An outline is a table of sections (scope, unit_id, unit_title, section_title, page_start, page_end); the
longest has some hundred rows a scope, so questions meet the rows of their scope by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import focus_terms

#: Characters that a phrase, and a term of a section, has at least.
LEAST_PHRASE, LEAST_TERM = 4, 5
#: What a phrase and a term of a unit add to its score, and the score that makes a hint.
PHRASE, TERM, HINT = 3.0, 1.0, 2.0


def _tokens(title: Column, least: int) -> Column:
    return F.filter(F.split(F.lower(title), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def unit_phrases(outline: DataFrame) -> DataFrame:
    """(scope, unit_id, phrase): the titles of a unit and its sections in lower case, and the longer words of the sections' titles."""
    title = F.trim(F.lower("section_title"))
    both = F.concat(F.array(F.trim(F.lower("unit_title")), title), F.coalesce(_tokens(title, LEAST_PHRASE), F.array().cast("array<string>")))
    rows = outline.select("scope", "unit_id", F.explode(both).alias("phrase"))
    return rows.where(F.length("phrase") >= LEAST_PHRASE).distinct()


def unit_terms(outline: DataFrame) -> DataFrame:
    """(scope, unit_id, term): the words of five characters and more in the titles of a unit's sections."""
    return outline.select("scope", "unit_id", F.explode(_tokens(F.col("section_title"), LEAST_TERM)).alias("term")).distinct()


def page_hints(outline: DataFrame) -> DataFrame:
    """(scope, phrase, page_start, page_end): the pages of each section, and of each unit over its sections, by title."""
    phrase = lambda c: F.trim(F.lower(c)).alias("phrase")
    sections = outline.select("scope", phrase("section_title"), "page_start", "page_end")
    units = outline.groupBy("scope", "unit_id", "unit_title").agg(F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"))
    rows = sections.unionByName(units.select("scope", phrase("unit_title"), "page_start", "page_end"))
    return rows.where(F.length("phrase") >= LEAST_PHRASE).distinct()


def infer_units(questions: DataFrame, phrases: DataFrame, terms: DataFrame) -> DataFrame:
    """(query_id, unit_id, score, rank) of the units that a question hints at: 3 for each phrase of the unit
    that it holds and 1 for each of its focus terms among the unit's terms, from 2 on; ties by the unit.

    ``questions`` has (query_id, scope, text).
    """
    held = questions.join(phrases, "scope").where(F.contains(F.lower("text"), F.col("phrase"))).select("query_id", "unit_id", F.lit(PHRASE).alias("part"))
    words = questions.select("query_id", "scope", F.explode(focus_terms(F.col("text"))).alias("term"))
    shared = words.join(terms, ["scope", "term"]).select("query_id", "unit_id", F.lit(TERM).alias("part"))
    scored = held.unionByName(shared).groupBy("query_id", "unit_id").agg(F.sum("part").alias("score")).where(F.col("score") >= HINT)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return scored.withColumn("rank", F.row_number().over(window))


def page_ranges(questions: DataFrame, hints: DataFrame) -> DataFrame:
    """(query_id, page_start, page_end): the page ranges of the phrases that the question holds, each once."""
    met = questions.join(hints, "scope").where(F.contains(F.lower("text"), F.col("phrase")))
    return met.select("query_id", "page_start", "page_end").distinct()


def hint_lists(units: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, units array<string> in the order of their rank, ranges array<struct<page_start, page_end>>)."""
    listed = units.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "unit_id"))), lambda x: x["unit_id"]).alias("units"))
    paged = ranges.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("page_start", "page_end"))).alias("ranges"))
    return listed.join(paged, "query_id", "full_outer")


def section_patterns(outline: DataFrame) -> DataFrame:
    """(scope, unit_id, section_title, phrase): what tells a section in a text: its title and the longer words of it, and
    the phrases and terms of its unit; four characters at least."""
    own = F.concat(F.array(F.trim(F.lower("section_title")), F.trim(F.lower("unit_title"))), F.coalesce(_tokens(F.col("section_title"), LEAST_TERM), F.array().cast("array<string>")))
    sections = outline.select("scope", "unit_id", "section_title").distinct()
    rows = outline.select("scope", "unit_id", "section_title", F.explode(own).alias("phrase"))
    shared = unit_phrases(outline).unionByName(unit_terms(outline).withColumnRenamed("term", "phrase"))
    rows = rows.unionByName(sections.join(shared, ["scope", "unit_id"]))
    return rows.where(F.length("phrase") >= LEAST_PHRASE).distinct()


def page_counts(pages: DataFrame, outline: DataFrame, readable: int = 100, fallback: str = "Unclassified") -> DataFrame:
    """(scope, unit_id, section_title, n): the readable pages of each section, each page (scope, file, page, text) once.

    A page counts for the section whose phrases in it are longest together, the first by unit and title of
    equals; one without any for the fallback section of the scope's first unit, "general" without an outline.
    """
    once = pages.where(F.length(F.trim("text")) >= readable).groupBy("scope", "file", "page").agg(F.min("text").alias("text"))
    hay = once.select("scope", "file", "page", F.lower("text").alias("text"))
    met = hay.join(section_patterns(outline), "scope").where(F.contains("text", F.col("phrase")))
    scored = met.groupBy("scope", "file", "page", "unit_id", "section_title").agg(F.sum(F.length("phrase")).alias("score"))
    best = scored.groupBy("scope", "file", "page").agg(F.min(F.struct((-F.col("score")).alias("worse"), "unit_id", "section_title")).alias("best"))
    first = outline.groupBy("scope").agg(F.min("unit_id").alias("first"))
    rows = hay.drop("text").join(best, ["scope", "file", "page"], "left").join(first, "scope", "left")
    unit = F.coalesce("best.unit_id", "first", F.lit("general")).alias("unit_id")
    return rows.groupBy("scope", unit, F.coalesce("best.section_title", F.lit(fallback)).alias("section_title")).agg(F.count(F.lit(1)).alias("n"))
