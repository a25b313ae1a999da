"""Joins with a choice: first match, best match, ranges and merges by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key; Spark limits each task's groups before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def first_chunk_of_page(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each hit's first chunk on its page: (hit columns, chunk_id); of the hits of one chunk the best stays.

    ``hits`` has (hit_id, document_id, page, score). Hits on pages without chunks go.
    """
    first = first_per_key(chunks.where(F.col("page").isNotNull()).select("document_id", "page", "chunk_id", "chunk_index"), ["document_id", "page"], F.col("chunk_index").asc_nulls_last(), F.col("chunk_id"))
    found = hits.join(first.drop("chunk_index"), ["document_id", "page"])
    return first_per_key(found, ["chunk_id"], F.col("score").desc_nulls_last(), F.col("hit_id"))


def page_sections(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Each page with the first section whose page range holds it, null where none does.

    ``pages`` (document_id, page), ``sections`` (document_id, section_id, page_start, page_end), both
    1-based and inclusive. A range within an equi-join: the document keeps it distributed.
    """
    s = sections.select(F.col("document_id").alias("_doc"), "section_id", "page_start", "page_end")
    inside = (pages["document_id"] == s["_doc"]) & pages["page"].between(s["page_start"], s["page_end"])
    joined = pages.join(s, inside, "left").drop("_doc")
    return joined.groupBy("document_id", "page").agg(F.min_by("section_id", F.struct("page_start", "page_end", "section_id")).alias("section_id"))


def best_keyword_match(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """(text_id, pattern_id, score): for each text the pattern with the largest sum of the lengths of its
    words that the text has, ties to the smaller ordinal; texts without any word of a pattern go.

    ``texts`` (text_id, terms array<string>), ``phrases`` (pattern_id, ordinal, term). Texts and
    patterns meet on their words, not each with each.
    """
    tokens = texts.select("text_id", F.explode(F.array_distinct("terms")).alias("term"))
    scored = tokens.join(phrases.select("pattern_id", "ordinal", "term").distinct(), "term")
    sums = scored.groupBy("text_id", "pattern_id", "ordinal").agg(F.sum(F.length("term")).alias("score"))
    best = sums.groupBy("text_id").agg(F.max_by(F.struct("pattern_id", "score"), F.struct("score", -F.col("ordinal"))).alias("best"))
    return best.select("text_id", "best.*")


def fill_from(rows: DataFrame, hints: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``rows`` with the null or empty ``columns`` filled from ``hints``, which has ``key`` once."""
    named = hints.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(named, key, "left")
    return joined.select(*(F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c) if c in columns else c for c in rows.columns))


def compare_metrics(actual: DataFrame, expected: DataFrame, absolute: float = 0.0, relative: float = 0.0) -> DataFrame:
    """(name, actual, expected, delta, passed) over the names of both; a missing side fails."""
    joined = actual.withColumnRenamed("value", "actual").join(expected.withColumnRenamed("value", "expected"), "name", "full_outer")
    delta = F.col("actual") - F.col("expected")
    allowed = F.greatest(F.lit(absolute), F.abs("expected") * relative)
    return joined.select("name", "actual", "expected", delta.alias("delta"), F.coalesce(F.abs(delta) <= allowed, F.lit(False)).alias("passed"))


def replace_set(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The stored rows of other keys and all new rows: delete then insert, as one table."""
    return stored.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def get_or_create(stored: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """The stored rows and those asked for whose key isn't stored, each key once."""
    return stored.unionByName(asked.dropDuplicates([key]).join(stored.select(key), key, "left_anti"), allowMissingColumns=True)
