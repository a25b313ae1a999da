"""Which rows a query sees: lanes, document sets, tree scopes and the checks of given ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STUDY = ("notes", "textbook", "syllabus")
EXAM = ("past_paper",)


def lane(documents: DataFrame, kinds: Sequence[str], status: str = "ready") -> DataFrame:
    """Documents of the kinds that are ready; null kind or status is outside every lane."""
    return documents.where(F.col("doc_kind").isin(*kinds) & (F.col("status") == status))


def within(rows: DataFrame, ids: DataFrame, column: str = "document_id") -> DataFrame:
    """Rows whose ``column`` is among the first column of ``ids``; no rows for no ids."""
    chosen = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
    return rows.join(chosen, column, "left_semi")


def missing(asked: DataFrame, existing: DataFrame, column: str) -> DataFrame:
    """The asked ids that don't exist, each once, null left out; empty when the scope is valid."""
    return asked.where(F.col(column).isNotNull()).select(column).distinct().join(existing, column, "left_anti")


def expand(chosen: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Documents in the scope of the ``chosen`` nodes (node_id).

    ``nodes`` has (node_id, node_type, unit_id, part_id) with types unit, part and subtopic; a unit
    reaches itself and all below, a part itself, its unit and its subtopics, a subtopic itself, its part
    and its unit. ``links`` has (node_id, document_id).
    """
    picked = nodes.join(chosen.select("node_id").distinct(), "node_id", "left_semi")
    units, parts, topics = (picked.where(F.col("node_type") == t) for t in ("unit", "part", "subtopic"))
    own = picked.select("node_id")
    below_units = nodes.join(units.select(F.col("node_id").alias("unit_id")), "unit_id", "left_semi").select("node_id")
    below_parts = nodes.where(F.col("node_type") == "subtopic").join(parts.select(F.col("node_id").alias("part_id")), "part_id", "left_semi").select("node_id")
    above = parts.select(F.col("unit_id").alias("node_id")).union(topics.select("unit_id")).union(topics.select("part_id")).where(F.col("node_id").isNotNull())
    reached = own.union(below_units).union(below_parts).union(above).distinct()
    return links.join(reached, "node_id", "left_semi").select("document_id").distinct()


def prioritised(documents: DataFrame, key: str, priority: Column, order: Column) -> DataFrame:
    """One row per ``key``: the smallest priority, then the smallest ``order``, then the smallest id."""
    best = documents.groupBy(key).agg(F.min_by(F.struct(*documents.columns), F.struct(priority, order, F.col("document_id"))).alias("best"))
    return best.select("best.*")
