"""A tree of three levels: flattening, rollup over subtrees, ancestors and nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten(units: DataFrame, parts: DataFrame, topics: DataFrame) -> DataFrame:
    """(node_id, node_type, title, unit_id, part_id, parent_id) of units (unit_id, title), parts (part_id,
    unit_id, title) and subtopics (topic_id, part_id null or not, unit_id, title)."""
    u = units.select(F.col("unit_id").alias("node_id"), F.lit("unit").alias("node_type"), "title", "unit_id", F.lit(None).cast("string").alias("part_id"), F.lit(None).cast("string").alias("parent_id"))
    p = parts.select(F.col("part_id").alias("node_id"), F.lit("part").alias("node_type"), "title", "unit_id", "part_id", F.col("unit_id").alias("parent_id"))
    t = topics.select(F.col("topic_id").alias("node_id"), F.lit("subtopic").alias("node_type"), "title", "unit_id", "part_id", F.coalesce("part_id", "unit_id").alias("parent_id"))
    return u.unionByName(p).unionByName(t)


def rollup(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Metrics of every node over its subtree: (node_id, question_count, unique_questions, marks_total,
    link_long, link_short).

    ``facts`` has (node_id, question_id, weight decimal, marks). A question counts once per node, by its
    largest weight there, so children don't add up to their parent; link_long and link_short count links.
    Each fact goes to the node and its ancestors, three rows at most.
    """
    up = nodes.select("node_id", F.array_distinct(F.filter(F.array("node_id", "part_id", "unit_id"), lambda x: x.isNotNull())).alias("ancestors"))
    spread = facts.join(up, "node_id").select(F.explode("ancestors").alias("node_id"), "question_id", "weight", F.coalesce("marks", F.lit(1)).alias("marks"))
    once = spread.groupBy("node_id", "question_id").agg(F.max("weight").alias("w"), F.max("marks").alias("m"), F.count_if(F.col("marks") >= 8).alias("long"), F.count_if(F.col("marks") < 8).alias("short"))
    summed = once.groupBy("node_id").agg(
        F.sum("w").alias("sw"), F.count(F.lit(1)).alias("unique_questions"), F.sum(F.col("m") * F.col("w")).alias("smw"), F.sum("long").alias("link_long"), F.sum("short").alias("link_short")
    )
    return nodes.select("node_id").join(summed, "node_id", "left").select(
        "node_id",
        F.round(F.coalesce(F.col("sw").cast("double"), F.lit(0.0)), 4).alias("question_count"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("unique_questions", "link_long", "link_short")),
        F.round(F.coalesce(F.col("smw").cast("double"), F.lit(0.0)), 2).alias("marks_total"),
    )


def ancestor_titles(nodes: DataFrame) -> DataFrame:
    """(node_id, unit_title, part_title, subtopic_title)."""
    title = nodes.select(F.col("node_id").alias("_id"), F.col("title").alias("_title"))
    u, p = title.withColumnsRenamed({"_id": "unit_id", "_title": "unit_title"}), title.withColumnsRenamed({"_id": "part_id", "_title": "part_title"})
    joined = nodes.join(u, "unit_id", "left").join(p, "part_id", "left")
    return joined.select("node_id", "unit_title", "part_title", F.when(F.col("node_type") == "subtopic", F.col("title")).alias("subtopic_title"))


def nested(nodes: DataFrame) -> DataFrame:
    """(unit_id, title, children array<string>): each unit with the titles of its direct children, by their ids."""
    child = nodes.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("unit_id")).agg(F.array_sort(F.collect_list(F.struct("node_id", "title"))).alias("c"))
    child = child.select("unit_id", F.col("c.title").alias("children"))
    return nodes.where(F.col("node_type") == "unit").select(F.col("node_id").alias("unit_id"), "title").join(child, "unit_id", "left")
