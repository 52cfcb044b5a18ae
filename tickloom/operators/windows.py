"""Event-time windows with the exact late and close rules of a per-partition watermark.

The watermark is the least, over the partitions seen so far, of the latest event time of each; it is moved by every arrival. An arrival is
late if its window's end is not after it. A window is closed once its end is not after the watermark of the last arrival. The set of partitions is known up front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.running import running


def tumbling(size: str, time: str = "event_time") -> list[Column]:
    w = F.window(time, size)
    return [w["start"].alias("window_start"), w["end"].alias("window_end")]


def assign(df: DataFrame, size: str, time: str = "event_time") -> DataFrame:
    """Floor to the size from the epoch, end exclusive."""
    return df.withColumn("_w", F.window(time, size)).select(*df.columns, F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"))


def fence(df: DataFrame, instrument: str, exchange_id: str | None = None) -> DataFrame:
    """Only one instrument's events; put before anything that watches time."""
    keep = F.col("instrument") == instrument
    return df.where(keep & (F.col("exchange_id") == exchange_id) if exchange_id else keep)


def watermarked(df: DataFrame, size: str, partitions: Sequence[int], chunk: Column) -> DataFrame:
    """df with window_start, window_end, watermark (after each arrival, in seq order per instrument), late, and final_watermark (after the last arrival)."""
    d = assign(df, size).withColumn("_chunk", chunk)
    tops = {f"_wm{p}": ("max", F.when(F.col("partition") == p, F.col("event_time"))) for p in partitions}
    d = running(d, ["instrument"], "_chunk", ["seq"], ends="_end", **tops)
    least = lambda names: F.least(*map(F.col, names)) if len(names) > 1 else F.col(names[0])
    ends = [f"_end{n}" for n in tops]
    d = d.withColumns({"watermark": least(list(tops)), "final_watermark": least(ends)})
    return d.withColumn("late", F.col("window_end") <= F.col("watermark")).drop("_chunk", *tops, *ends)


def closed(marked: DataFrame, flush: bool = False) -> DataFrame:
    """Accepted events of closed windows; flush closes all."""
    ok = marked.where("not late")
    return ok if flush else ok.where("window_end <= final_watermark")
