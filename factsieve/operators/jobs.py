"""Job records: latest state, restart reconciliation, log tails."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from factsieve import settings


def new_jobs(requests: DataFrame, method: str, parent_revision: int, auto_verify: bool = True) -> DataFrame:
    """Queued job rows for accepted requests."""
    return requests.filter(F.col("status") == "accepted").select(
        F.concat(F.lit("J"), "request_id").alias("job_id"),
        F.lit("train_and_verify" if auto_verify else "train_only").alias("job_type"),
        F.lit("queued").alias("status"), "request_id", F.lit(method).alias("method"),
        F.lit(parent_revision).cast("long").alias("parent_revision"), F.lit(auto_verify).alias("auto_verify"),
        F.current_timestamp().alias("created_at"))


def latest_jobs(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Latest status per key; equal times are settled by job id."""
    latest = F.max(F.struct("created_at", "job_id", "status"))
    return events.groupBy(key).agg(latest.alias("e"), F.count(F.lit(1)).alias("n_events")).select(
        key, F.col("e.status").alias("status"), F.col("e.created_at").alias("updated_at"), "n_events")


def list_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.col("created_at").desc(), "job_id")


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("status").isin(*settings.ACTIVE_STATUSES))


def reconcile_jobs(jobs: DataFrame) -> DataFrame:
    """After a restart no worker carries an unfinished job any more: such rows fail."""
    stale = F.col("status").isin(*settings.ACTIVE_STATUSES)
    message = F.concat(F.lit("no worker carried this job over a restart; it was left as "), F.col("status"))
    kept_error = F.col("error") if "error" in jobs.columns else F.lit(None).cast("string")
    kept_end = F.col("finished_at") if "finished_at" in jobs.columns else F.lit(None).cast("timestamp")
    others = [c for c in jobs.columns if c not in ("status", "error", "finished_at")]
    return jobs.select(
        *others, F.when(stale, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stale, message).otherwise(kept_error).alias("error"),
        F.when(stale, F.current_timestamp()).otherwise(kept_end).alias("finished_at"))


def log_tail(logs: DataFrame, column: str, lines: int = settings.LOG_TAIL_LINES) -> DataFrame:
    """Last lines of a log text, as an array; a final line break opens no line."""
    split = F.split(F.regexp_replace(column, r"(\r\n|\n|\r)\z", ""), r"\r\n|\n|\r")
    rows = F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(split)
    return logs.withColumn("log_tail", F.slice(rows, F.greatest(F.size(rows) - (lines - 1), F.lit(1)), lines))


def stale_jobs(latest: DataFrame, now, timeout_seconds: int) -> DataFrame:
    """Of ``latest_jobs`` the active ones without news for longer than the timeout: what the stream's timers find, as a batch."""
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return latest.filter(F.col("status").isin(*settings.ACTIVE_STATUSES) & (age > timeout_seconds))
