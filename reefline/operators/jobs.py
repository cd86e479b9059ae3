"""Extraction jobs: retry schedule and work selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from reefline.constants import FIRST_RETRY_SECONDS, MAX_RETRY_SECONDS


def retry_seconds(attempts: Column) -> Column:
    """Five minutes, doubled per attempt, at most six hours."""
    doublings = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(30))
    return F.least(F.lit(FIRST_RETRY_SECONDS) * F.pow(F.lit(2.0), doublings),
                   F.lit(MAX_RETRY_SECONDS)).cast("int")


def fail_jobs(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Jobs after one failure report each (source_document_id, error, retryable, failed_at)."""
    report = failures.select("source_document_id", F.struct("error", "retryable", "failed_at").alias("f"))
    joined = jobs.join(report, "source_document_id", "left")
    hit = F.col("f").isNotNull()
    final = ~F.col("f.retryable") | (F.col("attempts") >= F.col("max_attempts"))
    delay = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.when(final, F.lit(0)).otherwise(
        retry_seconds(F.col("attempts"))).cast("decimal(18,6)"))
    return joined.withColumns({
        "status": F.when(hit & final, "dead_letter").when(hit, "retrying").otherwise(F.col("status")),
        "available_at": F.when(hit, F.col("f.failed_at") + delay).otherwise(F.col("available_at")),
        "leased_until": F.when(~hit, F.col("leased_until")),
        "last_error": F.when(hit, F.col("f.error")).otherwise(F.col("last_error")),
    }).select(*jobs.columns)


def due_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Queued or retrying jobs whose time has come, and leases that ran out."""
    waiting = F.col("status").isin("queued", "retrying") & (F.col("available_at") <= now)
    expired = (F.col("status") == "leased") & (
        F.col("leased_until").isNull() | (F.col("leased_until") <= now))
    return jobs.filter(waiting | expired)
