"""Read-only feature time series with partition pruning."""

from __future__ import annotations

import re
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BadRequest(ValueError):
    """What an HTTP edge would answer with 400."""


class StorageUnavailable(RuntimeError):
    """What an HTTP edge would answer with 503: the store did not answer, so that nothing is known of the rows."""


def check_names(feature: str, instrument: str) -> None:
    if not re.fullmatch(r"[A-Za-z0-9._-]+", feature):
        raise BadRequest(f"feature: {feature!r}")
    if not re.fullmatch(r"[A-Za-z0-9-]+", instrument):
        raise BadRequest(f"instrument: {instrument!r}")


def instant(text: str) -> datetime:
    """An ISO 8601 time as an instant in UTC; one without an offset is in UTC."""
    try:
        t = datetime.fromisoformat(text)
    except ValueError as e:
        raise BadRequest(str(e)) from e
    return t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)


def series(df: DataFrame, start, end, limit: int | None = None) -> DataFrame:
    """window_start >= start and window_end <= end, by window_start; a negative limit is ignored, 0 gives nothing."""
    d = df.where((F.col("window_start") >= F.lit(start).cast("timestamp")) & (F.col("window_end") <= F.lit(end).cast("timestamp"))).orderBy("window_start")
    return d if limit is None or limit < 0 else d.limit(limit)


def feature_series(spark: SparkSession, root: str, feature: str, instrument: str, start: str, end: str, limit: int | None = None, version: str = "v1") -> DataFrame:
    """window_start, window_end, value, input_count from a written feature folder. A folder that is not there has no rows; other errors are raised."""
    check_names(feature, instrument)
    a, b = instant(start), instant(end)
    if a > b:
        raise BadRequest("start is after end")
    try:
        d = spark.read.option("basePath", root).parquet(f"{root}/topic=features.{feature}.{version}/instrument={instrument}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "window_start timestamp, window_end timestamp, value decimal(28,8), input_count bigint")
        raise
    except Exception as e:
        raise StorageUnavailable(str(e)) from e
    # Folders are named in UTC. The range's days prune folders by one composed key; the columns' own bounds do the rest.
    day = F.col("year").cast("int") * 10000 + F.col("month").cast("int") * 100 + F.col("day").cast("int")
    d = d.where(day.between(a.year * 10000 + a.month * 100 + a.day, b.year * 10000 + b.month * 100 + b.day))
    return series(d.select("window_start", "window_end", "value", "input_count"), a, b, limit)


def table_series(spark: SparkSession, table: str, instrument: str, start: str, end: str, limit: int | None = None) -> DataFrame:
    """The same from a feature's table. A table that is not there has no rows."""
    if not re.fullmatch(r"[a-z0-9_]+[.]features_[a-z0-9_]+", table):
        raise BadRequest(f"table: {table!r}")
    check_names("table", instrument)
    a, b = instant(start), instant(end)
    if a > b:
        raise BadRequest("start is after end")
    if not spark.catalog.tableExists(table):
        return spark.createDataFrame([], "window_start timestamp, window_end timestamp, value decimal(28,8), input_count bigint")
    return series(spark.table(table).where(F.col("instrument") == instrument).select("window_start", "window_end", "value", "input_count"), a, b, limit)


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row by `order` for each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(*keys, "r.*")
