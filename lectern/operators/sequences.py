"""Operators over ordered rows: spans, sessions, neighbours, gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spans(starts: DataFrame, keys: Sequence[str], start: str, last: str) -> DataFrame:
    """``starts`` with span_end: the page before the next start, the ``last`` page for the last, the
    start at least. Equal starts follow the other columns."""
    window = Window.partitionBy(*keys).orderBy(start, *[c for c in starts.columns if c not in (*keys, start, last)])
    following = F.lead(start).over(window) - 1
    return starts.withColumn("span_end", F.greatest(F.col(start), F.coalesce(following, F.col(last))))


def sessions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], continues: Column) -> DataFrame:
    """``rows`` with session_no from 1: a row that doesn't continue opens a session."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("session_no", F.sum(F.when(continues, 0).otherwise(1)).over(window))


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, run_no, value, n_rows): equal neighbours put together; nulls equal each other."""
    window = Window.partitionBy(*keys).orderBy(*order)
    changed = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(window)) | (F.row_number().over(window) == 1)).cast("int"))
    numbered = changed.withColumn("run_no", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run_no").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n_rows"))


def strictly_rising(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``rising``: the value, or one more than the one before where it would not rise."""
    window = Window.partitionBy(*keys).orderBy(order)
    index = F.row_number().over(window)
    shifted = rows.withColumn("_i", index).withColumn("_v", F.col(value) - F.col("_i"))
    return shifted.withColumn("rising", F.max("_v").over(window.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i")).drop("_i", "_v")


def filled(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """``rows`` with ``filled``: null values put on the line between the known neighbours, the nearest
    known one at either end."""
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.col(order))
    known = rows.withColumns({
        "_v0": F.last(value, ignorenulls=True).over(back), "_x0": F.last(at, ignorenulls=True).over(back),
        "_v1": F.first(value, ignorenulls=True).over(ahead), "_x1": F.first(at, ignorenulls=True).over(ahead),
    })
    between = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col(order) - F.col("_x0")) / F.nullif(F.col("_x1") - F.col("_x0"), F.lit(0))
    value_at = F.coalesce(F.col(value), between, F.col("_v0"), F.col("_v1"))
    return known.withColumn("filled", F.floor(value_at).cast("int")).drop("_v0", "_x0", "_v1", "_x1")
