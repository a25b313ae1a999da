"""The base views that the queries read, made from the study tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import table

UNCLASSIFIED = "Unclassified"


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Each question row once, its course as scope; questions without a course go."""
    rows = table(spark, folder, "exam_questions").distinct()
    return rows.where(F.col("course_id").isNotNull()).withColumnRenamed("course_id", "scope")


def links(spark: SparkSession, folder: str) -> DataFrame:
    """(question_id, concept, weight): a question's unit by its confidence, its section by one half."""
    rows = table(spark, folder, "exam_questions").select("question_id", "unit", "section_title", "confidence").distinct()
    unit = rows.select("question_id", F.coalesce("unit", F.lit(UNCLASSIFIED)).alias("concept"), F.coalesce("confidence", F.lit(1.0)).cast("decimal(9,3)").alias("weight"))
    section = rows.where(F.col("section_title").isNotNull()).select("question_id", F.col("section_title").alias("concept"), F.lit(0.5).cast("decimal(9,3)").alias("weight"))
    return unit.unionByName(section)


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk once: (chunk_id, document_id, chunk_index, page, text)."""
    return table(spark, folder, "chunks").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("document_id", "chunk_index", "page", "text")))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each page once: (document_id, page, text)."""
    return table(spark, folder, "page_texts").groupBy("document_id", "page").agg(F.min("text").alias("text"))


def customers_tree(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, facts): region > nation > customer as a tree, the orders as weighted questions."""
    from lectern.operators.hierarchy import flatten

    key = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    region, nation, customer = (table(spark, folder, t) for t in ("region", "nation", "customer"))
    units = region.select(key("r", "r_regionkey").alias("unit_id"), F.col("r_name").alias("title"))
    parts = nation.select(key("n", "n_nationkey").alias("part_id"), key("r", "n_regionkey").alias("unit_id"), F.col("n_name").alias("title"))
    of = nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    topics = customer.join(of, "c_nationkey").select(key("c", "c_custkey").alias("topic_id"), key("n", "c_nationkey").alias("part_id"), key("r", "n_regionkey").alias("unit_id"), F.col("c_name").alias("title"))
    orders = table(spark, folder, "orders")
    facts = orders.select(key("c", "o_custkey").alias("node_id"), F.concat(F.lit("q"), F.col("o_orderkey")).alias("question_id"), F.lit(0.5).cast("decimal(9,3)").alias("weight"), F.pmod(F.col("o_orderkey"), F.lit(12)).cast("int").alias("marks"))
    return flatten(units, parts, topics), facts
