"""Connected components of a graph given by its edges, without a driver-side step per node."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import cut_lineage


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node of its component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each node links its larger
    neighbours to the smallest it knows, then itself, until every edge leads to the smallest node. The
    number of steps is logarithmic in practice. Edges are cut by checkpoint in every round. Null ends
    and loops are left out. Raises RuntimeError when ``rounds`` don't suffice.
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = cut_lineage(current)
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        star = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        current = cut_lineage(star.where("a <> b").distinct())
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            tops = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(tops)
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
