"""Ingest jobs: their latest state in batch, and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(jobs: DataFrame) -> DataFrame:
    """Each document's latest job by (created_at, job_id); rows without a document go."""
    known = jobs.where(F.col("document_id").isNotNull())
    return known.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status", "phase", "error", "created_at"), F.struct("created_at", "job_id")).alias("j")).select("document_id", "j.*")


def progress(status: Column) -> Column:
    # How far a job of a status is.
    return F.when(status == "completed", 100).when(status == "processing", 50).when(status == "failed", 0).when(status == "queued", 5).otherwise(0)


def claim_order(jobs: DataFrame, most: int) -> DataFrame:
    """The ``most`` queued jobs to take next: oldest first, then by id; a repeated job once."""
    queued = jobs.where(F.col("status") == "queued").select("job_id", "document_id", "phase", "created_at").dropDuplicates(["job_id"])
    return queued.orderBy(F.col("created_at").asc_nulls_last(), "job_id").limit(most)


def active_once(jobs: DataFrame) -> DataFrame:
    """One queued or processing job per document, the oldest."""
    active = jobs.where(F.col("status").isin("queued", "processing") & F.col("document_id").isNotNull())
    return active.groupBy("document_id").agg(F.min_by("job_id", F.struct("created_at", "job_id")).alias("job_id"))


def phase_for(tier: Column) -> Column:
    return F.when(tier == "native", "fast").when(tier.isin("ocr", "layout_defer"), "heavy").otherwise("full")


def windowed_counts(jobs: DataFrame, width: str = "1 day", late: str = "7 days") -> DataFrame:
    """(window_start, status, n) of a stream or table of jobs; a stream drops rows later than ``late``.

    An extension: tumbling windows over created_at with a watermark, repeated jobs counted once within it.
    """
    timed = jobs.where(F.col("created_at").isNotNull()).withColumn("created_at", F.col("created_at").cast("timestamp"))
    if jobs.isStreaming:
        timed = timed.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["job_id"])
    else:
        timed = timed.dropDuplicates(["job_id"])
    grouped = timed.groupBy(F.window("created_at", width).alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("window_start"), "status", "n")
