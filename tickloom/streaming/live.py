"""The feature plan over unbounded input.

`closed_windows` uses the built-in watermark (a window closes once its end is not after it; late rows are judged by the watermark of the batch
before). The engine in `streaming.engine` has the exact rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from tickloom.plans import replay, sinks

def closed_windows(events: DataFrame, feature: Callable[[DataFrame], DataFrame], delay: str = "0 seconds") -> DataFrame:
    """The same feature function as in batch, over a stream; write in append mode."""
    return feature(events.withWatermark("event_time", delay))


def paired(live: DataFrame, again: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Live and replayed features as they arrive, compared once both are there; one that no partner reached within the delay is told as missing.

    State is bounded by the watermarks of both sides, so nothing is forgotten because of too many keys.
    """
    return replay.compare(live.withWatermark("window_start", delay), again.withWatermark("window_start", delay), null_safe=False)


def archive(features: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Long-form features to Parquet under root/topic=/instrument=/year=..., each once; read root as a whole."""
    out = sinks.feature_files(features).writeStream.format("parquet").option("path", root).option("compression", "snappy")
    return out.option("checkpointLocation", checkpoint).partitionBy("topic", *sinks.HOUR)


def record(records: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Raw records as gzip lines by topic, source, instrument and hour, each once."""
    lines = sinks.raw_lines(records).drop("partition", "offset", "timestamp")
    return lines.writeStream.format("text").option("path", root).option("compression", "gzip").option("checkpointLocation", checkpoint).partitionBy("topic", "source", *sinks.HOUR)


def fan_out(df: DataFrame, clients: dict[str | None, Callable[[list], None]], refused: list[tuple[str | None, str]] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch target: each client gets the rows of its feature (None: all), a bounded piece at a time. A client that fails is dropped and told in `refused`.

    A batch holds closed windows only; its rows stream to the driver once, partition by partition, whatever the number of clients.
    """

    def send(batch: DataFrame, _: int) -> None:
        def give(piece: list) -> None:
            for name, call in list(clients.items()):
                if rows := [r for r in piece if name is None or r["feature_name"] == name]:
                    try:
                        call(rows)
                    except Exception as e:  # noqa: BLE001  one client's failure is not another's
                        clients.pop(name)
                        if refused is not None:
                            refused.append((name, str(e)))

        piece = []
        for row in batch.toLocalIterator():
            piece.append(row)
            if len(piece) == PIECE:
                give(piece)
                piece = []
        give(piece)

    return send


#: Rows given to a client at once.
PIECE = 1000
