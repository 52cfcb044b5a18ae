"""Typed, versioned state of streams: running it, and reading it from checkpoints."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql.streaming import StatefulProcessor

#: Typed state lives in column families, which this store has.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(grouped: GroupedData, processor: StatefulProcessor, out: str) -> DataFrame:
    """The processor over a grouped stream, append mode, without timers."""
    grouped._df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return grouped.transformWithStateInPandas(processor, out, "Append", "None")


def framed(ddl: str, rows: list[tuple]) -> pd.DataFrame:
    """Rows as a frame whose columns keep their values as they are, whatever is null."""
    kinds = {x.split()[0]: "datetime64[us]" if x.endswith(" timestamp") else "object" for x in ddl.split(", ")}
    return pd.DataFrame({c: pd.Series([r[k] for r in rows], dtype=kind) for k, (c, kind) in enumerate(kinds.items())})


#: Rows that are Python objects at once, of those that a batch brings or tells.
ROWS = 10_000


def ordered(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """A key's rows of a batch in order, ROWS at a time. All of them are held, as columns: a stream's batches bound them."""
    d = pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable")
    for lo in range(0, len(d), ROWS):
        yield d.iloc[lo : lo + ROWS]


class WrongVersion(ValueError):
    """A checkpoint's state was made by other rules."""


def variables(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The stateful operators in a checkpoint: id, name, store, partitions, and the batches whose state is there."""
    return spark.read.format("state-metadata").load(checkpoint).select("operatorId", "operatorName", "stateStoreName", "numPartitions", "minBatchId", "maxBatchId")


def rows(spark: SparkSession, checkpoint: str, variable: str, batch: int | None = None) -> DataFrame:
    """A state variable's rows in a checkpoint: the group's key, and value (or user_map_key and user_map_value), after a batch (the last)."""
    r = spark.read.format("statestore").option("stateVarName", variable)
    return (r if batch is None else r.option("batchId", batch)).load(checkpoint)


def check(spark: SparkSession, checkpoint: str, version: str, variable: str = "clock") -> None:
    """Before a restart: refuse a checkpoint with state of another version. One that has no state yet is fine."""
    try:
        found = rows(spark, checkpoint, variable).select("value.version").distinct().limit(2).collect()
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "NO_COMMITTED_BATCH", "OFFSET_LOG_UNAVAILABLE", "does not exist", "STDS_")):
            return
        raise
    if wrong := [r.version for r in found if r.version != version]:
        raise WrongVersion(f"state of {', '.join(sorted(map(str, wrong)))}, not {version}")
