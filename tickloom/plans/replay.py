"""Replay of a time range through the live plan, and row-by-row comparison of both outputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.query import BadRequest, instant
from tickloom.sources.readers import in_range

KEY = ["instrument", "feature_name", "feature_version", "window_start"]


def compare(live: DataFrame, replay: DataFrame, null_safe: bool = True) -> DataFrame:
    """Full outer pairs by KEY with a flag per field that differs; a row on one side only is named. Values compare without regard to scale.

    Without null_safe, rows with a null in KEY meet none.
    """
    a, b = live.alias("l"), replay.alias("r")
    on = None
    for k in KEY:
        e = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) if null_safe else F.col(f"l.{k}") == F.col(f"r.{k}")
        on = e if on is None else on & e
    side = lambda c: [F.col(f"l.{c}"), F.col(f"r.{c}")]
    have_l, have_r = F.col("l.feature_name").isNotNull(), F.col("r.feature_name").isNotNull()
    differs = lambda c: have_l & have_r & ~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = a.join(b, on, "full_outer").select(
        *[F.coalesce(*side(k)).alias(k) for k in KEY], F.col("l.value").alias("live_value"), F.col("r.value").alias("replay_value"), differs("value").alias("value_differs"),
        differs("window_end").alias("window_end_differs"), differs("input_count").alias("input_count_differs"), (have_l & ~have_r).alias("live_only"), (~have_l & have_r).alias("replay_only"),
    )
    return out.withColumn("diverges", F.col("value_differs") | F.col("window_end_differs") | F.col("input_count_differs") | F.col("live_only") | F.col("replay_only"))


def divergence_counts(pairs: DataFrame) -> DataFrame:
    flags = ("value_differs", "window_end_differs", "input_count_differs", "live_only", "replay_only", "diverges")
    return pairs.groupBy("feature_name").agg(F.count("*").alias("pairs"), *[F.sum(F.col(c).cast("bigint")).alias(c) for c in flags])


@dataclass
class Job:
    id: str
    start: str
    end: str
    status: str = "PENDING"
    rows: int = 0
    location: str = ""
    error: str = ""
    _done: object = field(default=None, repr=False)


class Jobs:
    """Replay jobs, one at a time, each writing its own folder with a .replay suffix."""

    def __init__(self, plan: Callable[[DataFrame], DataFrame], out: str, warm_up: str | None = None):
        self.plan, self.out, self.warm_up, self.jobs = plan, out, warm_up, {}
        self.pool = ThreadPoolExecutor(1)

    def submit(self, events: DataFrame, start: str, end: str) -> Job:
        if instant(start) > instant(end):
            raise BadRequest("start is after end")
        job = Job(uuid.uuid4().hex, start, end)
        self.jobs[job.id] = job
        job._done = self.pool.submit(self._run, job, events)
        return job

    def _run(self, job: Job, events: DataFrame) -> None:
        job.status, job.location = "RUNNING", f"{self.out}/{job.id}.replay"
        try:
            # State such as volume buckets starts at warm_up, so a replay need not begin cold.
            found = self.plan(in_range(events, self.warm_up or job.start, job.end)).where(F.col("window_start") >= F.lit(job.start).cast("timestamp"))
            found.write.mode("overwrite").parquet(job.location)
            job.rows = events.sparkSession.read.parquet(job.location).count()
            job.status = "COMPLETED"
        except Exception as e:  # noqa: BLE001  a failed job is a result
            job.status, job.error = "FAILED", str(e)

    def list(self) -> list[Job]:
        """All jobs, the last submitted first."""
        return [*self.jobs.values()][::-1]

    def get(self, job_id: str, wait: bool = False) -> Job:
        job = self.jobs[job_id]
        if wait:
            job._done.result()
        return job
