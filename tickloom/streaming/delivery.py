"""A batch of a stream delivered to several sinks, each once: events that pass, and dead letters for those that cannot be decoded or break a rule.

A stream repeats a batch whose end it has not written down. A ledger in the shared folder says which sink has which batch of which query, so a
repetition writes only where the first attempt did not get to. A sink's batch is a folder of its own, written whole (an attempt that broke off is
replaced); readers take the folders that the ledger names. A write that fails is tried again a bounded number of times, then the query fails and its
restart repeats the batch. What cannot be decoded never could be, so it is not tried again: it goes to the dead letters at once, with its bytes.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import validation
from tickloom.sources import files

LEDGER = "_ledger"
DEAD = "events.deadletter"
#: Attempts of a write, and seconds between them.
ATTEMPTS, PAUSE = 3, 1.0
LETTER = "payload string, reason string, source string, rejected_at timestamp"


class Ledger:
    """Which batches of a query a sink has."""

    def __init__(self, root: str, query: str, attempts: int = ATTEMPTS, pause: float = PAUSE):
        self.root, self.query, self.attempts, self.pause = root.rstrip("/"), query, attempts, pause

    def has(self, sink: str, batch: int) -> bool:
        return f"{batch:020d}" in files.listed(f"{self.root}/{LEDGER}/{self.query}/{sink}")

    def path(self, sink: str, batch: int) -> str:
        return f"{self.root}/{sink}/query={self.query}/batch={batch}"

    def once(self, sink: str, batch: int, write: Callable[[str], None]) -> bool:
        """Write a sink's batch, unless it has it; whether it was written now."""
        if self.has(sink, batch):
            return False
        for k in range(self.attempts):
            try:
                write(self.path(sink, batch))
                break
            except Exception:
                if k + 1 == self.attempts:
                    raise
                time.sleep(self.pause)
        files.put(f"{self.root}/{LEDGER}/{self.query}/{sink}/{batch:020d}", b"")
        return True


def decoded(records: DataFrame, kind: str, now) -> tuple[DataFrame, DataFrame]:
    """Raw records (RAW) as (events of a kind that pass, dead letters). Bytes that are no such event are their letter's payload, in base64 where they are no text."""
    shape = schemas.SHAPES[kind]
    text = F.try_validate_utf8(F.col("value").cast("string"))
    d = records.withColumn("_text", text).withColumn("_e", F.from_json("_text", f"{shape}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_e").isNull() | F.col("_e._bad").isNotNull()
    poison = d.where(bad).select(F.coalesce("_text", F.translate(F.base64("value"), "\r\n", "")).alias("payload"), F.lit("not decodable").alias("reason"), F.lit(None).cast("string").alias("source"), F.lit(now).cast("timestamp").alias("rejected_at"))
    good, dead = validation.split(d.where(~bad).select("_e.*").drop("_bad"), kind, now)
    return good, dead.unionByName(poison)


def deliver(kind: str, root: str, query: str, now=None, ledger: Ledger | None = None, write: Callable[[DataFrame, str], None] | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch target for a stream of raw records. `now` is the time that events may not be after: the batch's own unless given."""
    book = ledger or Ledger(root, query)
    put = write or (lambda df, path: df.write.mode("overwrite").parquet(path))

    def send(batch: DataFrame, number: int) -> None:
        told = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime()) if now is None else now
        good, dead = decoded(batch, kind, told)
        for sink, df in ((schemas.TOPICS[kind], good), (DEAD, dead)):
            book.once(sink, number, lambda path, df=df: put(df, path))

    return send


def delivered(spark: SparkSession, root: str, query: str, sink: str, schema: str) -> DataFrame:
    """What a sink has of a query: the batches that its ledger names."""
    book = Ledger(root, query)
    paths = [book.path(sink, int(n)) for n in files.listed(f"{book.root}/{LEDGER}/{query}/{sink}")]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
