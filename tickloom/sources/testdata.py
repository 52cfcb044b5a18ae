"""Market views of the driver's tables: trades from events, books from lineitem and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table with ts as an instant (UTC sessions)."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    side = F.when(F.col("event_type").isin("purchase", "signup"), "BUY").when(F.col("event_type").isin("view", "error"), "SELL").otherwise("UNKNOWN")
    return e.select(
        F.concat(F.lit("U"), (F.col("user_id") % 8).cast("string")).alias("instrument"), "event_id", F.col("ts").cast("timestamp").alias("event_time"), F.col("value").cast("decimal(18,8)").alias("price"),
        F.get_json_object("props", "$.k").cast("decimal(18,8)").alias("size"), side.alias("side"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("seq"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades in an arrival order that is not that of their times: up to two hours late."""
    late = F.unix_seconds("event_time") + (F.col("event_id") * 37 % 121) * 60
    return trades(spark, sf_dir).withColumn("seq", late * 1_000_000 + F.col("event_id") % 1_000_000)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot an order: bids price falling, asks price rising; ties by size."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_quantity > 0")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_custkey")
    level = lambda p: f"struct({p} as p, l_quantity as q)"
    # Levels are gathered per order: a handful of lines each.
    side = lambda cond, p: F.expr(f"sort_array(collect_list(case when {cond} then {level(p)} end))")
    g = lines.withColumn("p", F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double")).groupBy("l_orderkey").agg(side("l_returnflag = 'A'", "-p").alias("b"), side("l_returnflag <> 'A'", "p").alias("a"))
    conv = lambda c, sign: F.expr(f"transform({c}, x -> struct(cast({sign}x.p as decimal(18,8)) as price, cast(x.q as decimal(18,8)) as size))")
    return g.join(o, g["l_orderkey"] == o["o_orderkey"]).select(
        F.concat(F.lit("C"), (F.col("o_custkey") % 4).cast("string")).alias("instrument"), F.col("l_orderkey").alias("event_id"), F.col("o_orderdate").cast("timestamp").alias("event_time"), conv("b", "-").alias("bids"), conv("a", "").alias("asks")
    )
