"""Scoring retrieval against a golden set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page_hit(pages: Column, expected: Column, tolerance: int = 1) -> Column:
    """Whether some retrieved page is within the tolerance of some expected page; false for null or empty."""
    near = F.exists(pages, lambda p: F.exists(expected, lambda e: F.abs(p - e) <= tolerance))
    return F.coalesce(near, F.lit(False))


def matched_pages(pages: Column, expected: Column, tolerance: int = 1) -> tuple[Column, Column]:
    """(matched, missed) of the expected pages."""
    near = lambda e: F.exists(pages, lambda p: F.abs(p - e) <= tolerance)
    return F.filter(expected, near), F.filter(expected, lambda e: ~near(e))


def scored(golden: DataFrame, results: DataFrame, tolerance: int = 1) -> DataFrame:
    """One row: hit rate over questions of the corpus, refusal rate over the others, and the counts.

    ``golden`` (query_id, in_corpus, expected_pages), ``results`` (query_id, status, pages). A missing
    result is a miss, and no refusal; without questions of a kind its rate is 1.
    """
    joined = golden.join(results, "query_id", "left")
    hit = page_hit(F.col("pages"), F.col("expected_pages"), tolerance)
    refused = F.coalesce(F.col("status") == "not_in_materials", F.lit(False))
    totals = joined.agg(
        F.count_if("in_corpus").alias("in_corpus"),
        F.count_if(F.col("in_corpus") & hit).alias("hits"),
        F.count_if(~F.col("in_corpus")).alias("out_of_corpus"),
        F.count_if(~F.col("in_corpus") & refused).alias("refusals"),
    )
    rate = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6)).otherwise(1.0)
    return totals.select("*", rate("hits", "in_corpus").alias("hit_rate"), rate("refusals", "out_of_corpus").alias("refusal_rate"))
