"""Bounded reads, JSON decoding, raw logs, catalog and SQL passthrough."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas


def in_range(df: DataFrame, start, end, time: str = "event_time", closed: bool = False) -> DataFrame:
    """[start, end) by default; both ends with closed=True. Reaches the scan as a pushed filter."""
    upper = F.col(time) <= F.lit(end).cast("timestamp") if closed else F.col(time) < F.lit(end).cast("timestamp")
    return df.where((F.col(time) >= F.lit(start).cast("timestamp")) & upper)


def decode(df: DataFrame, ddl: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """JSON records by schema: (good rows, rows that do not parse)."""
    j = df.withColumn("_j", F.from_json(F.col(value).cast("string"), ddl + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("_j").isNull() | F.col("_j._bad").isNotNull()
    return j.where(~bad).select("_j.*").drop("_bad"), j.where(bad).drop("_j")


def raw_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or plain) of the raw log, each (topic, partition, offset) once."""
    fields = "topic string, partition int, offset bigint, timestamp bigint, key string"
    t = spark.read.text(path).withColumn("e", F.from_json("value", fields))
    return t.select("e.*", F.get_json_object("value", "$.valueBase64").alias("value_base64"), F.col("value").alias("line")).dropDuplicates(["topic", "partition", "offset"])


def ticks(records: DataFrame) -> DataFrame:
    """Trades (TICK) in records of a raw log; records of other shapes are left out. A record that says no time is an end. seq is the trade's own, else its time: the order within a batch."""
    ddl = "instrument struct<symbol: string>, event_id bigint, event_us bigint, price decimal(18,8), size decimal(18,8), side string, seq bigint"
    d = records.withColumn("e", F.from_json("value", ddl)).where("e.instrument.symbol is not null and e.event_id is not null")
    return d.select(F.col("e.instrument.symbol").alias("instrument"), "e.event_id", F.timestamp_micros("e.event_us").alias("event_time"), "e.price", "e.size", "e.side", "partition", F.coalesce("e.seq", "e.event_us").alias("seq"))


def feature_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(schemas.FEATURE).parquet(path)


def feature_tail(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """New rows of the written features whose topic matches the pattern; rows without a value are skipped."""
    ddl = "event_id string, instrument string, value decimal(28,8), window_start timestamp, window_end timestamp, input_count bigint, code_version string, topic string, year int, month string, day string, hour string"
    return spark.readStream.schema(ddl).option("basePath", root).parquet(root).where(F.col("topic").rlike(pattern) & F.col("value").isNotNull())


def catalog(spark: SparkSession) -> DataFrame:
    """The active feature definitions, by name."""
    rows = [(f, "v1", a, "1 minute", True, "BTC-USDT") for f, a in zip(schemas.FEATURES, ("VWAP", "OBI", "MICRO_PRICE", "VPIN"), strict=True)]
    return spark.createDataFrame(rows, "name string, version string, aggregation string, window_duration string, active boolean, instrument string")


def sql(spark: SparkSession, text: str, args: list | dict | None = None) -> DataFrame:
    """Any Spark SQL, with bound parameters."""
    return spark.sql(text, args=args)
