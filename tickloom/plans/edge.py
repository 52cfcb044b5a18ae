"""What services at the edge call: taking in events, publishing them, replaying a range to a handler, and counting what passes."""

from __future__ import annotations

import time
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import validation
from tickloom.sources.readers import in_range

SHAPES = schemas.SHAPES


def answers(events: DataFrame, kind: str, now) -> DataFrame:
    """event_id, status (201 taken, 400 refused) and message (the failed rules) of each event posted."""
    v = validation.validate(events, kind, now)
    return v.select("event_id", F.when(F.size("reasons") == 0, 201).otherwise(400).alias("status"), F.concat_ws("; ", "reasons").alias("message"))


def posted(spark: SparkSession, rows: list[dict], kind: str) -> DataFrame:
    """The events of a request's body, missing fields null."""
    if kind not in SHAPES:
        raise ValueError(f"unknown kind of event: {kind!r}")
    shape = spark.createDataFrame([], SHAPES[kind]).schema
    return spark.createDataFrame([tuple(r.get(c) for c in shape.names) for r in rows], shape)


def publish(events: DataFrame, kind: str, root: str, now) -> tuple[DataFrame, Observation]:
    """Append valid events under root/topic=<kind's topic>, dead letters under root/topic=events.deadletter.

    Ranges of (instrument, time, id) are dealt to tasks by sampled bounds, so a hot instrument is written by many; files are in order, and so are rows within them. Returns the answers and what the write counted.
    """
    seen = Observation("published")
    good, dead = validation.split(events, kind, now)
    topic = schemas.TOPICS[kind]
    order = ("instrument", "event_time", "event_id")
    # Counted behind the shuffle: what is before it also runs to find the bounds.
    out = metered(good.repartitionByRange(*order).sortWithinPartitions(*order), seen)
    out.write.mode("append").parquet(f"{root}/topic={topic}")
    dead.write.mode("append").parquet(f"{root}/topic=events.deadletter")
    return answers(events, kind, now), seen


def metered(df: DataFrame, seen: Observation, time: str = "event_time") -> DataFrame:
    """df; once it has run, seen.get holds the rows, their first and last time. Counted in passing, without another job."""
    return df.observe(seen, F.count("*").alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def counters(marked: DataFrame) -> DataFrame:
    """By instrument, of rows marked late or not: events received, accepted and late, windows with accepted events, and volume of unknown side among these."""
    ok = ~F.col("late")
    return marked.groupBy("instrument").agg(
        F.count("*").alias("received"), F.count_if(ok).alias("accepted"), F.count_if(F.col("late")).alias("late"), F.count_distinct(F.when(ok, F.col("window_start"))).alias("windows"),
        F.coalesce(F.sum(F.when(ok & (F.col("side") == "UNKNOWN"), F.col("size"))), F.lit(0)).alias("unknown_volume"),
    )


@dataclass
class Replayed:
    rows: int
    elapsed_ms: int


def replay_to(events: DataFrame, start, end, handler: Callable[[DataFrame], None], record_time: str = "event_time") -> Replayed:
    """Give the handler the range by record time, both ends included; how many rows it read and how long it took. The handler must run the frame it is given whole."""
    seen, began = Observation(), time.monotonic()
    handler(metered(in_range(events, start, end, record_time, closed=True), seen, record_time))
    return Replayed(seen.get["rows"], round(1000 * (time.monotonic() - began)))


@dataclass
class QueryMetrics:
    """Requests and their seconds by backend."""

    requests: dict[str, int] = field(default_factory=lambda: defaultdict(int))
    seconds: dict[str, float] = field(default_factory=lambda: defaultdict(float))

    def timed(self, backend: str, run: Callable):
        began = time.monotonic()
        try:
            return run()
        finally:
            self.requests[backend] += 1
            self.seconds[backend] += time.monotonic() - began
