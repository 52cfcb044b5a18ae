"""Signal quality: as-of price, forward return at a horizon, Pearson correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.running import running


def asof_price(events: DataFrame) -> DataFrame:
    """events (instrument, event_time, seq, price or null) with asof_price: the last price at or before each row."""
    d = events.withColumn("_day", F.to_date("event_time"))
    return running(d, ["instrument"], "_day", ["event_time", "seq"], asof_price=("last", F.col("price"))).drop("_day")


def forward_return(events: DataFrame, signal: Column, horizon_seconds: int) -> DataFrame:
    """For rows where signal is not null: entry, and exit at the first later event once the horizon has passed; unresolved rows are left out.

    A signal puts a probe at its time plus the horizon among the events. Read backwards in time, the last event met before a probe is the first
    at or after it, so one running value per day answers all probes: n log n in a series' rows, and a hot instrument is spread over days.
    """
    d = asof_price(events).withColumns({"signal": signal, "us": F.unix_micros("event_time")})
    d = d.withColumn("probe", F.explode(F.expr("if(signal is not null and asof_price is not null, array(false, true), array(false))")))
    x = F.when(~F.col("probe"), F.struct("us", "seq", "asof_price"))
    at = F.when(F.col("probe"), F.col("us") + horizon_seconds * 1_000_000).otherwise(F.col("us"))
    d = d.select("instrument", "event_time", "seq", "signal", "asof_price", "probe", x.alias("event"), (-at).alias("_back"), (-F.col("seq")).alias("_behind"), (-F.expr("(us + if(probe, %d, 0)) div 86400000000" % (horizon_seconds * 1_000_000))).alias("_day"))
    d = running(d, ["instrument"], "_day", ["_back", "probe", "_behind"], x=("last", F.col("event"))).where("probe and x is not null")
    ret = (F.col("x.asof_price").cast("double") - F.col("asof_price").cast("double")) / F.nullif(F.col("asof_price").cast("double"), F.lit(0.0))
    return d.select("instrument", "event_time", "seq", F.col("signal").cast("double").alias("signal"), F.col("asof_price").alias("entry"), F.col("x.asof_price").alias("exit"), F.timestamp_micros("x.us").alias("exit_time"), ret.alias("forward_return"))


def information_coefficient(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson correlation and count; null below two rows or without variance. NaN rows are skipped."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    g = d.groupBy(*by).agg(F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("vx"), F.var_pop(y).alias("vy"), F.count("*").alias("n"))
    return g.select(*by, F.when((F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0), F.try_divide(F.col("c"), F.sqrt(F.col("vx") * F.col("vy")))).alias("ic"), "n")
