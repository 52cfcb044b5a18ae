"""The window features as aggregates over (window, instrument): the same columns in batch and stream."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.exact import event_id, ratio8
from tickloom.operators.running import running

CODE_VERSION = "tickloom-1"


def _sums() -> list[Column]:
    return [F.sum((F.col("price") * F.col("size")).cast("decimal(37,16)")).alias("pv"), F.sum("size").alias("v"), F.sum("price").alias("p"), F.count("*").alias("trade_count")]


def _vwap() -> Column:
    zero = F.col("v") == 0
    mean = ratio8(F.col("p"), F.col("trade_count").cast("decimal(20,8)"))
    return F.when(zero, mean).otherwise(ratio8(F.col("pv"), F.when(~zero, F.col("v"))))


def vwap(df: DataFrame, size: str) -> DataFrame:
    """Sum of price x size over sum of size, else the mean price; a row for each window with a trade."""
    g = df.groupBy("instrument", F.window("event_time", size).alias("w")).agg(*_sums())
    return g.select("instrument", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), _vwap().alias("vwap"), F.bround("pv", 8).alias("sum_price_times_size"), F.col("v").alias("sum_size"), "trade_count")


def last_snapshot(books: DataFrame, size: str) -> DataFrame:
    """The last snapshot of each window by (event_time, event_id)."""
    s = F.max_by(F.struct("event_id", "bids", "asks"), F.struct("event_time", "event_id"))
    g = books.groupBy("instrument", F.window("event_time", size).alias("w")).agg(s.alias("s"))
    return g.select("instrument", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "s.*")


def _volume(side: str, levels: int) -> Column:
    return F.expr(f"aggregate(slice({side}, 1, {levels}), cast(0 as decimal(28,8)), (a, x) -> cast(a + x.size as decimal(28,8)))")


def _obi(levels: int) -> dict[str, Column]:
    bid, ask = _volume("bids", levels), _volume("asks", levels)
    value = F.when(bid + ask == 0, F.lit(0).cast("decimal(28,8)")).otherwise(ratio8(bid - ask, F.when(bid + ask != 0, bid + ask)))
    used = F.greatest(F.least(F.lit(levels), F.size("bids")), F.least(F.lit(levels), F.size("asks")))
    return {"obi": value, "bid_volume": bid, "ask_volume": ask, "levels": used}


def obi(books: DataFrame, size: str, levels: int = 5) -> DataFrame:
    """(bid - ask) / (bid + ask) volume of the top levels of the last snapshot; 0 without volume."""
    if levels <= 0:
        raise ValueError("levels must be positive")
    return last_snapshot(books, size).select("instrument", "window_start", "window_end", *[c.alias(n) for n, c in _obi(levels).items()], "event_id")


def _micro() -> dict[str, Column]:
    bp, bv, ap, av = (F.get(F.col(s), F.lit(0))[c] for s in ("bids", "asks") for c in ("price", "size"))
    total = bv + av
    num = (bp * av).cast("decimal(37,16)") + (ap * bv).cast("decimal(37,16)")
    value = F.when(total == 0, ratio8(bp + ap, F.lit(2))).otherwise(ratio8(num, F.when(total != 0, total)))
    return {"micro_price": value, "best_bid": bp, "best_ask": ap, "bid_volume": bv, "ask_volume": av}


def micro_price(books: DataFrame, size: str) -> DataFrame:
    """Best prices weighed by the other side's volume; only where the last snapshot has both sides."""
    d = last_snapshot(books, size).where("size(bids) > 0 and size(asks) > 0")
    return d.select("instrument", "window_start", "window_end", *[c.alias(n) for n, c in _micro().items()], "event_id")


#: Buckets of volume whose imbalances one task sums up, or `history` where that is more.
STRETCH = 1_000_000


def _trade_windows(trades: DataFrame, size: str, bucket: Decimal | int, history: int) -> DataFrame:
    """Per window the sums of `vwap` and the volume buckets of `vpin`, of one running pass: m buckets closed by its end, vpin (null below `history`).

    A trade is at most two parts of buckets and a run of whole buckets between them, all of one imbalance; of a run only the last `history` can be in
    the trail of a window, since none ends before the trade does. Parts are summed by bucket and windows by their start in one aggregate. A trail is a difference of two sums of
    runs, so it is taken within a stretch of buckets (and `history` before it): no task has all of a series, and work does not grow with the buckets that a trade fills.
    """
    unit = int(Decimal(bucket) * 10**8)
    if unit <= 0 or history <= 0:
        raise ValueError("bucket and history must be positive")
    d = trades.withColumns({"u": (F.col("size") * 100000000).cast("decimal(38,0)"), "day": F.to_date("event_time")})
    d = running(d, ["instrument"], "day", ["event_time", "event_id"], hi=("sum", F.col("u")))
    d = d.withColumns({"hi": F.col("hi").cast("decimal(38,0)"), "lo": (F.col("hi") - F.col("u")).cast("decimal(38,0)")})
    v = f"cast({unit} as decimal(38,0))"
    sign = F.when(F.col("side") == "BUY", 1).when(F.col("side") == "SELL", -1).otherwise(0)
    d = d.withColumns({"sign": sign, "a": F.expr(f"lo div {v}"), "b": F.expr(f"if(u > 0, (hi - 1) div {v}, lo div {v})"), "w": F.window("event_time", size)})
    # at: a bucket's number or a window's start; of: how many buckets (0: a window); signed: volume by side in a part, of one bucket in a run.
    part = lambda at, of, signed: f"named_struct('at', {at}, 'of', {of}, 'signed', cast({signed} as decimal(38,0)))"
    rows = f"""array({part("unix_micros(w.start)", "0L", "null")}, if(u > 0, {part("b", "1L", f"sign * (hi - greatest(lo, cast(b * {v} as decimal(38,0))))")}, null),
        if(b > a and b - a <= {history}, {part("a", "1L", f"sign * (cast((a + 1) * {v} as decimal(38,0)) - lo)")}, null),
        if(b - a > 1, {part(f"greatest(a + 1, b - {history})", f"b - greatest(a + 1, b - {history})", f"sign * {v}")}, null))"""
    d = d.withColumn("r", F.explode(F.expr(rows))).where("r is not null")
    # What a window sums is null in the rows of buckets.
    d = d.select("instrument", "r.*", "hi", "side", *[F.when(F.col("r.of") == 0, F.col(c)).alias(c) for c in ("price", "size")], F.when(F.col("r.of") == 0, F.col("w.end")).alias("window_end"))
    unknown = F.sum(F.when(F.col("side") == "UNKNOWN", F.col("size")).otherwise(F.lit(0).cast("decimal(18,8)")))
    g = d.groupBy("instrument", "at", "of").agg(F.abs(F.sum("signed")).alias("imb"), F.max("hi").alias("hi"), F.max("window_end").alias("window_end"), unknown.alias("unknown_volume"), *_sums())
    wide = max(STRETCH, history)
    g = g.withColumn("m", F.expr(f"if(of = 0, hi div {v}, null)"))
    # Runs go to each stretch that they are in or up to `history` before; a window asks its stretch for the sums up to m and up to m - history.
    places = f"""if(of = 0, array(named_struct('stretch', greatest(m - 1, 0) div {wide}, 'x', m), named_struct('stretch', greatest(m - 1, 0) div {wide}, 'x', m - {history})),
        transform(sequence(at div {wide}, (at + of - 1 + {history}) div {wide}), s -> named_struct('stretch', s, 'x', at)))"""
    g = g.withColumn("place", F.explode(F.expr(places))).select("*", "place.*").drop("place")
    order = W.partitionBy("instrument", "stretch").orderBy("x", "of").rowsBetween(W.unboundedPreceding, 0)
    run = F.when(F.col("of") > 0, F.struct((F.col("at") + F.col("of")).alias("end"), "imb"))
    g = g.withColumns({"upto": F.coalesce(F.sum(F.when(F.col("of") > 0, F.col("of") * F.col("imb"))).over(order), F.lit(0)).cast("decimal(38,0)"), "run": F.last(run, ignorenulls=True).over(order)})
    over = F.coalesce(F.greatest(F.col("run.end") - F.col("x"), F.lit(0)) * F.col("run.imb"), F.lit(0)).cast("decimal(38,0)")
    g = g.where("of = 0").withColumn("upto", (F.col("upto") - over).cast("decimal(38,0)"))
    kept = ["window_end", "m", "unknown_volume", "pv", "v", "p", "trade_count"]
    trail = (F.max("upto") - F.min("upto")).cast("decimal(28,0)")  # sums only grow
    g = g.groupBy("instrument", "stretch", "at").agg(trail.alias("trail"), *[F.first(c).alias(c) for c in kept])
    value = ratio8((F.col("trail") * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(37,8)"), F.lit(history * unit).cast("decimal(27,0)") * F.lit("0.00000001").cast("decimal(8,8)"))
    return g.withColumns({"vpin": F.when(F.col("m") >= history, value), "window_start": F.timestamp_micros("at")}).drop("stretch", "at", "trail")


def vpin(trades: DataFrame, size: str, bucket: Decimal | int, history: int) -> DataFrame:
    """Order-flow imbalance of the last `history` full volume buckets at each window's end.

    Volumes are exact integers of 1e-8; trades of an instrument run in (event_time, event_id) order, day by day with carried totals.
    """
    g = _trade_windows(trades, size, bucket, history).where("vpin is not null")
    return g.select("instrument", "window_start", "window_end", "vpin", F.col("m").alias("buckets_closed"), "unknown_volume", "trade_count")


def candles(trades: DataFrame, size: str) -> DataFrame:
    o = F.struct("event_time", "event_id")
    g = trades.groupBy("instrument", F.window("event_time", size).alias("w")).agg(
        F.min_by("price", o).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", o).alias("close"), F.sum("size").alias("volume"), F.count("*").alias("trade_count")
    )
    return g.select("instrument", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "open", "high", "low", "close", "volume", "trade_count")


GENERIC = {
    "COUNT": lambda c: F.count(c).cast("double"), "SUM": lambda c: F.sum(c).cast("double"), "AVG": lambda c: F.avg(c.cast("double")), "MIN": lambda c: F.min(c).cast("double"), "MAX": lambda c: F.max(c).cast("double"),
    "FIRST": lambda c: F.min_by(c, F.struct("event_time", "event_id")).cast("double"), "LAST": lambda c: F.max_by(c, F.struct("event_time", "event_id")).cast("double"), "STDDEV": lambda c: F.stddev_samp(c.cast("double")),
}


def generic(df: DataFrame, aggregation: str, column: str, size: str, slide: str | None = None) -> DataFrame:
    """A definition's aggregate by name over tumbling or sliding windows: an extension of the four features."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    g = df.groupBy("instrument", w.alias("w")).agg(GENERIC[aggregation](F.col(column)).alias("value"))
    return g.select("instrument", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "value")


def _named(feature: Column, version: str, value: Column, n: Column) -> list[Column]:
    return [
        event_id(feature, F.lit(version), F.col("instrument"), F.unix_millis("window_start")).alias("event_id"), F.col("instrument"), feature.alias("feature_name"), F.lit(version).alias("feature_version"),
        value.cast("decimal(28,8)").alias("value"), F.col("window_start"), F.col("window_end"), n.cast("bigint").alias("input_count"), F.lit(CODE_VERSION).alias("code_version"),
    ]


def long_form(df: DataFrame, feature: str, value: str, count: str | None, version: str = "v1", values: dict[str, str] | None = None) -> DataFrame:
    """Any feature as (event_id, instrument, feature_name, ..., value, input_count). values: key -> column of the map of further numbers, added when given."""
    cols = _named(F.lit(feature), version, F.col(value), F.col(count) if count else F.lit(1))
    if values:
        pairs = [x for k, c in values.items() for x in (F.lit(k), F.col(c).cast("decimal(28,8)"))]
        cols.append(F.create_map(*pairs).alias("values"))
    return df.select(*cols)


#: Further numbers that consumers get with a volume-weighted price: fixed key names.
VWAP_VALUES = {"sumPriceTimesSize": "sum_price_times_size", "sumSize": "sum_size", "tradeCount": "trade_count"}

#: Feature -> (its input, its value from a row of that input's windows). Another feature of these inputs is one more line.
REGISTRY: dict[str, tuple[str, Callable[[int], Column]]] = {
    "vwap.1m": ("trades", lambda levels: _vwap()),
    "vpin": ("trades", lambda levels: F.col("vpin")),
    "obi": ("books", lambda levels: _obi(levels)["obi"]),
    "micro_price": ("books", lambda levels: F.when((F.size("bids") > 0) & (F.size("asks") > 0), _micro()["micro_price"])),
}


def all_features(trades: DataFrame, books: DataFrame | None, size: str, levels: int = 5, bucket: Decimal | int = 1, history: int = 1) -> DataFrame:
    """Every registered feature in long form: the one plan for live and replay. Features of one input come from one row a window, those without a value left out."""
    if levels <= 0:
        raise ValueError("levels must be positive")
    inputs = {"trades": _trade_windows(trades, size, bucket, history)} | ({} if books is None else {"books": last_snapshot(books, size)})
    out = None
    for name, d in inputs.items():
        own = [F.struct(F.lit(k).alias("name"), value(levels).alias("value")) for k, (of, value) in REGISTRY.items() if of == name]
        n = F.col("trade_count") if name == "trades" else F.lit(1)
        rows = d.select("instrument", "window_start", "window_end", n.alias("n"), F.explode(F.array(*own)).alias("f")).where("f.value is not null")
        rows = rows.select(*_named(F.col("f.name"), "v1", F.col("f.value"), F.col("n")))
        out = rows if out is None else out.unionByName(rows)
    return out
