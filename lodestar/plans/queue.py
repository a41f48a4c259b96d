"""What a job queue would do next, as queries over its table.

The table has job_id, lane, priority, seq, state (queued, running, done, failed),
due_at, durable, attempts, permanent, worker, renewed_at.  Rows are claimed by
whoever owns the table; Spark has no row locks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import backoff_ms

ATTEMPTS = 3


def next_jobs(jobs: DataFrame, now: Column, concurrency: int) -> DataFrame:
    """The jobs to start: the highest priority first, then the oldest, one per lane that
    is not busy, as many as there are free places."""
    running = jobs.where("state = 'running'")
    ready = jobs.where("state = 'queued' and durable").where(F.coalesce(F.col("due_at") <= now, F.lit(True)))
    free = ready.join(running.select("lane").distinct(), "lane", "left_anti")
    first = free.groupBy("lane").agg(F.min_by(F.struct(*free.columns), F.struct(-F.col("priority"), F.col("seq"))).alias("j")).select("j.*")
    order = Window.orderBy(F.desc("priority"), "seq")
    places = running.agg((F.lit(concurrency) - F.count("*")).alias("places"))
    return first.withColumn("turn", F.row_number().over(order)).join(places, F.lit(True)).where("turn <= places").drop("turn", "places")


def abandoned(jobs: DataFrame, now: Column, lease_seconds: int) -> DataFrame:
    """Running jobs whose worker has not renewed its lease in time."""
    return jobs.where("state = 'running'").where(F.unix_seconds(now) - F.unix_seconds("renewed_at") > lease_seconds)


def retries(jobs: DataFrame, now: Column) -> DataFrame:
    """Failed jobs that are tried again, and when."""
    again = jobs.where(f"state = 'failed' and attempts < {ATTEMPTS} and not coalesce(permanent, false)")
    wait = (backoff_ms(F.col("attempts")) / 1000).cast("long")
    return again.withColumn("due_at", F.timestamp_seconds(F.unix_seconds(now) + wait))


def lost_audits(audits: DataFrame, outstanding: DataFrame, cutoff: Column) -> DataFrame:
    """Open audits from before the cutoff that no outstanding job stands for."""
    return audits.where("status in ('queued', 'running')").where(F.col("created_at") < cutoff).join(outstanding.select("audit_id"), "audit_id", "left_anti")
