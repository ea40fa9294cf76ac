"""Job lifecycle in batch and as Structured Streaming state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.errors import JobError

# fixed values: statuses and progress bands
STATUSES = ["PENDING", "RUNNING", "COMPLETED", "FAILED"]
TERMINAL = ["COMPLETED", "FAILED"]
STAGES = [(10, "ingest"), (40, "chunk"), (80, "analyse"), (100, "report")]
OF_EVENT = {"signup": "PENDING", "view": "RUNNING", "click": "RUNNING", "purchase": "COMPLETED"}


def from_events(events: DataFrame) -> DataFrame:
    """events as job_event(job_id, seq, ts, status)."""
    status = F.lit("FAILED")
    for kind, name in OF_EVENT.items():
        status = F.when(F.col("event_type") == kind, name).otherwise(status)
    return events.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), "ts", status.alias("status"))


def lifecycle(log: DataFrame) -> DataFrame:
    """Present state of each job: last status, first event, first RUNNING, last terminal event. One partial aggregation."""
    return log.groupBy("job_id").agg(
        F.max_by("status", "seq").alias("status"), F.min("ts").alias("created_at"), F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"), F.max(F.when(F.col("status").isin(TERMINAL), F.col("ts"))).alias("completed_at"),
    )


def by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def progress_changes(rows: DataFrame, order: str) -> DataFrame:
    """Rows whose progress differs from the job's row before, with the stage of the progress."""
    stage = F.lit("done")
    for most, name in reversed(STAGES):
        stage = F.when(F.col("progress") < most, name).otherwise(stage)
    before = F.lag("progress").over(Window.partitionBy("job_id").orderBy(order))
    return rows.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("progress"))).select("job_id", order, "progress", stage.alias("stage"))


STATE = "status string, created_at timestamp, started_at timestamp, completed_at timestamp, seq long"


def lifecycle_stream(log: DataFrame) -> DataFrame:
    """The lifecycle as keyed streaming state: an updated row per job and micro-batch. Late events of a batch are put in order by seq."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, created, started, completed, last = state.get if state.exists else (None, None, None, None, -1)
        for frame in frames:
            for row in frame.sort_values("seq").itertuples():
                created = row.ts if created is None else min(created, row.ts)
                if row.status == "RUNNING":
                    started = row.ts if started is None else min(started, row.ts)
                if row.status in TERMINAL:
                    completed = row.ts if completed is None else max(completed, row.ts)
                if row.seq > last:
                    status, last = row.status, row.seq
        state.update((status, created, started, completed, int(last)))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "created_at": [created], "started_at": [started], "completed_at": [completed]})

    return log.groupBy("job_id").applyInPandasWithState(update, "job_id long, status string, created_at timestamp, started_at timestamp, completed_at timestamp", STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Event-time window counts with a watermark (an extension)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


class JobStore:
    """In-process record store with the lifecycle's rules."""

    def __init__(self) -> None:
        self.jobs: dict[str, dict[str, Any]] = {}

    def create(self, job_id: str, at: Any = None) -> dict[str, Any]:
        if job_id in self.jobs:
            raise JobError(f"job {job_id} exists already")
        self.jobs[job_id] = {"job_id": job_id, "status": "PENDING", "progress": 0, "created_at": at, "started_at": None, "completed_at": None}
        return dict(self.jobs[job_id])

    def update(self, job_id: str, status: str | None = None, progress: int | None = None, at: Any = None, **more: Any) -> dict[str, Any]:
        if job_id not in self.jobs:
            raise JobError(f"job {job_id} is unknown")
        job = self.jobs[job_id]
        if status == "RUNNING" and job["started_at"] is None:
            job["started_at"] = at
        if status in TERMINAL:
            job["completed_at"] = at
        job |= {k: v for k, v in {"status": status, "progress": progress, **more}.items() if v is not None}
        return dict(job)

    def get(self, job_id: str) -> dict[str, Any] | None:
        return dict(self.jobs[job_id]) if job_id in self.jobs else None

    def delete(self, job_id: str) -> None:
        self.jobs.pop(job_id, None)

    def count_by_status(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for job in self.jobs.values():
            out[job["status"]] = out.get(job["status"], 0) + 1
        return out
