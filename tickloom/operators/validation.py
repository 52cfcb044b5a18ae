"""Rules over events: every failed rule is named; no reasons means valid. `now` is a parameter, so results do not depend on the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARLIEST = "2020-01-01 00:00:00"


def _rule(bad: Column, said: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(said))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def rules(kind: str, columns: list[str], now) -> list[Column]:
    t = F.col("event_time")
    now = F.lit(now).cast("timestamp")
    out = [_rule(_blank(c), f"{c} is required") for c in ("event_id", "source", "instrument") if c in columns]
    out += [F.when(t.isNull(), F.lit("event_time is required")), F.when(t < F.lit(EARLIEST).cast("timestamp"), F.lit("event_time is before 2020-01-01")), F.when(t > now + F.expr("interval 5 minutes"), F.lit("event_time is in the future"))]
    if "ingest_time" in columns:
        out += [F.when(F.col("ingest_time").isNull(), F.lit("ingest_time is required")), F.when(t > F.col("ingest_time") + F.expr("interval 30 seconds"), F.lit("event_time is ahead of ingest_time"))]
    if kind == "trade":
        out += [_rule(F.col("price") <= 0, "price must be positive"), _rule(F.col("size") < 0, "size must not be negative")]
    elif kind == "candle":
        out += [_rule(F.col("high") < F.col("low"), "high is below low"), _rule(F.col("window_start") >= F.col("window_end"), "window is empty"), _rule(F.col("volume") < 0, "volume must not be negative")]
    elif kind == "book":
        out += [_rule(F.size("bids") < 1, "bids are empty"), _rule(F.size("asks") < 1, "asks are empty")] + [_rule(F.col("depth") <= 0, "depth must be positive")] * ("depth" in columns)
    elif kind == "delta":
        out += [_rule(_blank("order_id"), "order_id is required"), _rule((F.col("action") != "DELETE") & (F.col("price") <= 0), "price must be positive"), _rule(F.col("quantity") < 0, "quantity must not be negative")]
    return out


def validate(df: DataFrame, kind: str, now) -> DataFrame:
    """df with `reasons`, the messages of failed rules in order."""
    return df.withColumn("reasons", F.array_compact(F.array(*rules(kind, df.columns, now))))


def split(df: DataFrame, kind: str, now) -> tuple[DataFrame, DataFrame]:
    """(valid events, dead letters: payload, reason, source, rejected_at)."""
    v = validate(df, kind, now)
    source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
    dead = v.where(F.size("reasons") > 0).select(F.to_json(F.struct(*df.columns)).alias("payload"), F.concat_ws("; ", "reasons").alias("reason"), source.alias("source"), F.lit(now).cast("timestamp").alias("rejected_at"))
    return v.where(F.size("reasons") == 0).drop("reasons"), dead


def known_instruments(df: DataFrame, instruments: DataFrame, known: bool = True) -> DataFrame:
    """Events of instruments in (or not in) the reference table."""
    return df.join(instruments.select("instrument"), "instrument", "left_semi" if known else "left_anti")
