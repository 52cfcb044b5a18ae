"""Vendor messages to events: one projection each, bad messages kept with their reasons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.running import running

#: Arrivals of a series that one task numbers.
STRETCH = 10_000
#: What one connection carries at most, and the depth streams that carry whole books.
MOST_STREAMS = 1024
WHOLE_DEPTH = r"depth(5|10|20)(@100ms)?"

_COMBINED = "stream string, data struct<s:string,p:string,q:string,m:boolean,lastUpdateId:bigint,bids:array<array<string>>,asks:array<array<string>>>"
_LISTED = "event string, code string, msg string, arg struct<channel:string,instId:string>, data array<struct<instId:string,tradeId:string,px:string,sz:string,side:string,ts:string,bids:array<array<string>>,asks:array<array<string>>>>"


def normal_symbol(c: Column) -> Column:
    """btcusdt -> BTC-USDT; suffix USDT, then USD, else quote UNKNOWN."""
    u = F.upper(c)
    base4, base3 = F.substring(u, F.lit(1), F.length(u) - 4), F.substring(u, F.lit(1), F.length(u) - 3)
    return F.when(u.endswith("USDT"), F.concat(base4, F.lit("-USDT"))).when(u.endswith("USD"), F.concat(base3, F.lit("-USD"))).otherwise(F.concat(u, F.lit("-UNKNOWN")))


def _levels(c: str, drop_zero: bool) -> Column:
    made = f"transform({c}, x -> struct(try_cast(x[0] as decimal(18,8)) as price, try_cast(x[1] as decimal(18,8)) as size))"
    return F.expr(f"filter({made}, x -> x.size > 0)" if drop_zero else made)


def _numbered(df: DataFrame, arrival: str = "arrival") -> DataFrame:
    """1, 2, 3... per series in arrival order, before anything is refused, so a refused message leaves a gap.

    A series is numbered by stretches of arrivals, each told how many came before. Structs, as a null instrument or kind is a series too.
    """
    d = df.withColumns({"_series": F.struct("source", "instrument", "kind"), "_stretch": F.struct(F.expr(f"{arrival} div {STRETCH}").alias("s"))})
    return running(d, ["_series"], "_stretch", ["arrival"], sequence_number=("sum", F.lit(1))).drop("_series", "_stretch")


def combined_stream(raw: DataFrame, source: str = "binance") -> DataFrame:
    """(arrival, ingest_time, value) of a combined stream: `<symbol>@trade` and `<symbol>@depth...` messages."""
    m = raw.withColumn("j", F.from_json("value", _COMBINED)).withColumns({"symbol": F.split("j.stream", "@")[0], "feed": F.split("j.stream", "@")[1]})
    kind = F.when(F.col("feed") == "trade", "trade").when(F.col("feed").startswith("depth"), "book")
    m = m.withColumns({"source": F.lit(source), "kind": kind, "instrument": normal_symbol(F.col("symbol"))})
    trade, d = F.col("kind") == "trade", "j.data."
    reason = (
        F.when(F.col("j.stream").isNull(), "not a combined stream message").when(F.col("kind").isNull(), "unknown stream")
        .when(trade & (F.lower(d + "s") != F.lower("symbol")), "symbol does not match stream").when(trade & F.expr("try_cast(j.data.p as decimal(18,8)) is null"), "bad price")
        .when((F.col("kind") == "book") & F.col(d + "bids").isNull(), "no levels")
    )
    out = _numbered(m.withColumn("reason", reason))
    event_time = F.when(trade, F.timestamp_millis(F.expr("try_cast(get_json_object(value, '$.data.T') as bigint)"))).otherwise(F.col("ingest_time"))
    bids, asks = _levels("j.data.bids", True), _levels("j.data.asks", True)
    return out.select(
        "arrival", "source", "kind", "instrument", "sequence_number", event_time.alias("event_time"), "ingest_time", F.expr("try_cast(j.data.p as decimal(18,8))").alias("price"), F.expr("try_cast(j.data.q as decimal(18,8))").alias("size"),
        F.when(trade, F.when(F.col(d + "m"), "SELL").otherwise("BUY")).alias("side"), F.get_json_object("value", "$.data.t").alias("exchange_trade_id"), bids.alias("bids"), asks.alias("asks"), F.greatest(F.size(bids), F.size(asks)).alias("depth"), "reason", "value",
    )


def listed_stream(raw: DataFrame, source: str = "okx") -> DataFrame:
    """(arrival, ingest_time, value) of a venue that sends lists of items by channel. Acks and pongs give nothing, each item fails alone."""
    m = raw.withColumn("j", F.from_json("value", _LISTED)).where("value <> 'pong' and (j.event is null or j.event = 'error')")
    m = m.select("arrival", "ingest_time", "value", F.col("j.event").alias("event"), F.col("j.arg").alias("arg"), F.posexplode_outer("j.data").alias("item", "d"))
    kind = F.when(F.col("arg.channel") == "trades", "trade").when(F.col("arg.channel") == "books5", "book")
    name = F.coalesce("d.instId", "arg.instId")
    m = m.withColumns({"source": F.lit(source), "kind": kind, "instrument": name, "arrival": F.struct("arrival", "item")})
    reason = (
        F.when(F.col("event") == "error", "venue error").when(F.col("arg.channel").isNull(), "not a channel message").when(F.col("kind").isNull(), "unknown channel")
        .when(~name.rlike("^[A-Z0-9]+-[A-Z0-9]+$"), "not BASE-QUOTE").when((F.col("kind") == "trade") & F.expr("try_cast(d.px as decimal(18,8)) is null"), "bad price")
        .when((F.col("kind") == "book") & ((F.coalesce(F.size("d.bids"), F.lit(0)) < 1) | (F.coalesce(F.size("d.asks"), F.lit(0)) < 1)), "empty side")
    )
    out = _numbered(m.withColumn("reason", reason), "arrival.arrival")
    side = F.when(F.col("d.side") == "buy", "BUY").when(F.col("d.side") == "sell", "SELL").otherwise("UNKNOWN")
    bids, asks = _levels("d.bids", False), _levels("d.asks", False)
    return out.select(
        "arrival", "source", "kind", "instrument", "sequence_number", F.timestamp_millis(F.expr("try_cast(d.ts as bigint)")).alias("event_time"), "ingest_time", F.expr("try_cast(d.px as decimal(18,8))").alias("price"),
        F.expr("try_cast(d.sz as decimal(18,8))").alias("size"), F.when(F.col("kind") == "trade", side).alias("side"), F.col("d.tradeId").alias("exchange_trade_id"), bids.alias("bids"), asks.alias("asks"), F.greatest(F.size(bids), F.size(asks)).alias("depth"), "reason", "value",
    )


def stream_names(instruments: list[str], streams: list[str]) -> list[str]:
    """`<symbol>@<stream>` of each configured instrument and stream, each once and in order of first mention."""
    symbols, kinds = dict.fromkeys(x.strip().lower() for x in instruments), dict.fromkeys(streams)
    if not symbols or not kinds:
        raise ValueError("at least one instrument and one stream are needed")
    if sum(k.startswith("depth") for k in kinds) > 1:
        raise ValueError("more than one book depth")
    if bad := [k for k in kinds if k.startswith("depth") and not re.fullmatch(WHOLE_DEPTH, k)]:
        raise ValueError(f"no stream of whole books: {bad[0]!r}")
    if len(symbols) * len(kinds) > MOST_STREAMS:
        raise ValueError(f"{len(symbols) * len(kinds)} streams, but a connection carries {MOST_STREAMS}")
    return [f"{s}@{k}" for s in symbols for k in kinds]
