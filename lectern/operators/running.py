"""Running sums over groups of any size.

A window partitioned by the group alone would sort a hot group in one task. Here the rows of a group
are cut into buckets that follow the order, summed within the bucket, and moved by the total of the
buckets before. Only the bucket totals, one narrow row per bucket, are seen per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` over the rows before it in its group.

    ``bucket`` must not fall as ``order`` rises; it bounds how many rows one task sorts. Rows equal in
    ``order`` come in any order, so end ``order`` with a unique column. Null values count 0; null keys
    form a group like any other.
    """
    cut = rows.withColumn("_bucket", F.coalesce(bucket.cast("long"), F.lit(-1))).withColumn("_value", F.coalesce(value.cast("long"), F.lit(0)))
    safe = {k: f"_key{i}" for i, k in enumerate(keys)}
    cut = cut.select("*", *(F.xxhash64(F.col(k), F.col(k).isNull()).alias(s) for k, s in safe.items()))
    group = [*safe.values()]
    cut = cut.repartition(*group, "_bucket")
    within = Window.partitionBy(*group, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*group, "_bucket").agg(F.sum("_value").alias("_total"))
    totals = totals.select(*group, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    summed = cut.withColumn("_within", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return summed.join(totals, [*group, "_bucket"]).withColumn(name, F.col("_within") + F.col("_offset")).drop(*group, "_bucket", "_value", "_within", "_offset")
