"""Jobs and their progress as an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINAL = ["completed", "failed", "cancelled"]
#: Share of a job's progress that each stage takes, from - to.
STAGES = {"repo": (0, 30, 100), "file": (0, 40, 100)}
INSIDE = {"read": (0, 0), "chunk": (10, 10), "embed": (20, 80), "store": (80, 80), "done": (100, 100)}


def effective_progress(status: Column, progress: Column) -> Column:
    """100 for a completed job, else what was said, within 0 and 100."""
    return F.when(status == "completed", 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(progress, F.lit(0.0)))))


def state(events: DataFrame) -> DataFrame:
    """(job_id, type, status, progress, message, started_at, updated_at, events): the last state of each job.

    Repeated rows count once; late rows take their place by time, equal times go by status and progress. All aggregates
    are combined map-side, so a long job costs one row per task.
    """
    clean = events.where(F.col("job_id").isNotNull())
    rank = F.when(F.col("status").isin(FINAL), 1).otherwise(0)
    last = F.max_by(F.struct("type", "status", "message"), F.struct("ts", rank, F.coalesce("progress", F.lit(-1.0)), F.coalesce("status", F.lit("")), F.coalesce("message", F.lit("")))).alias("l")
    known = F.when(F.col("progress").isNotNull(), F.struct("ts", "progress"))
    g = clean.groupBy("job_id").agg(last, F.max_by("progress", known).alias("p"), F.min("ts").alias("started_at"), F.max("ts").alias("updated_at"), F.countDistinct("status", "progress", "message", "ts").alias("events"))
    return g.select("job_id", "l.type", "l.status", effective_progress(F.col("l.status"), F.col("p")).alias("progress"), "l.message", "started_at", "updated_at", "events")


def cancel(states: DataFrame, job_id: str) -> DataFrame:
    """A running job is failed with a message; others stay."""
    hit = (F.col("job_id") == job_id) & (F.col("status") == "running")
    return states.withColumns({"status": F.when(hit, "failed").otherwise(F.col("status")), "message": F.when(hit, "Job cancelled by user").otherwise(F.col("message"))})


def statistics(states: DataFrame) -> DataFrame:
    """Counts by status and the mean duration of completed jobs in seconds (0 if none)."""
    took = F.unix_micros("updated_at") - F.unix_micros("started_at")
    return states.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.avg(F.when(F.col("status") == "completed", took / 1e6)), F.lit(0.0)).alias("avg_duration"))


def active(states: DataFrame) -> DataFrame:
    return states.where(F.col("status") == "running")


def cleanup(states: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Without finished jobs older than so many hours."""
    old = F.col("status").isin(FINAL) & (F.col("updated_at") < now - F.expr(f"interval {hours} hours"))
    return states.where(~F.coalesce(old, F.lit(False)))


def latest_progress(events: DataFrame) -> DataFrame:
    """(job_id, progress, message, ts) of the last event of each job; completion says 100, failure 0."""
    rank = F.when(F.col("status").isin(FINAL), 1).otherwise(0)
    g = events.where(F.col("job_id").isNotNull()).groupBy("job_id").agg(F.max_by(F.struct("status", "progress", "message", "ts"), F.struct("ts", rank, F.coalesce("progress", F.lit(-1.0)), F.coalesce("status", F.lit("")), F.coalesce("message", F.lit("")))).alias("x"))
    shown = F.when(F.col("x.status") == "completed", 100.0).when(F.col("x.status") == "failed", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("x.progress"))))
    return g.select("job_id", shown.alias("progress"), "x.message", "x.ts")


def progress_cleanup(progress: DataFrame, now: Column) -> DataFrame:
    """Without finished progress older than an hour."""
    return progress.where(~F.coalesce((F.col("progress") == 100) & (F.col("ts") < now - F.expr("interval 1 hour")), F.lit(False)))


def progress_statistics(subscriptions: DataFrame, progress: DataFrame) -> DataFrame:
    """(jobs_with_subscribers, subscribers, cached) of subscriptions (job_id, subscriber) and latest progress."""
    s = subscriptions.agg(F.countDistinct("job_id").alias("jobs_with_subscribers"), F.count("*").alias("subscribers"))
    return s.crossJoin(F.broadcast(progress.agg(F.count("*").alias("cached"))))  # one row each


def interpolated(kind: Column, part: Column, stage: Column, share: Column) -> Column:
    """Progress of a job: kind repo or file, part land or process, stage within processing, share 0..1 of the stage."""
    edge = F.when(kind == "repo", 30.0).otherwise(40.0)
    low = F.coalesce(*[F.when(stage == s, float(a)) for s, (a, _) in INSIDE.items()], F.lit(0.0))
    high = F.coalesce(*[F.when(stage == s, float(b)) for s, (_, b) in INSIDE.items()], F.lit(0.0))
    inside = low + (high - low) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    return F.when(part == "land", edge * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(edge + (100 - edge) * inside / 100)


def stage_progress(kind: str, part: str, stage: str, share: float) -> float:
    """interpolated() for one event on the driver."""
    edge = STAGES[kind][1]
    share = max(0.0, min(1.0, share))
    if part == "land":
        return edge * share
    low, high = INSIDE.get(stage, (0, 0))
    return edge + (100 - edge) * (low + (high - low) * share) / 100
