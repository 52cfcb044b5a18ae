"""Named queries over the driver's tables, one for each operator."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schemas, session
from tickloom.functions import exact
from tickloom.operators import book, features, signals, validation, windows
from tickloom.operators.running import running
from tickloom.plans import edge, query, replay, sinks
from tickloom.sources import rawlog, readers, testdata, venues
from tickloom.streaming import delivery, engine, live, metrics, state, sync
from tickloom.streaming import signals as judge

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
D = "double"


def q(f):
    Q[f.__name__] = f
    return f


def _doubles(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(D) for c in cols})


def _vwap(size):
    return lambda s, d: _doubles(features.vwap(testdata.trades(s, d), size), "vwap", "sum_price_times_size", "sum_size")


for _name, _size in (("vwap_1m", "1 minute"), ("vwap_1h", "1 hour"), ("vwap_1d", "1 day")):
    Q[_name] = _vwap(_size)


@q
def vwap_zero_size(s, d):
    return _doubles(features.vwap(testdata.trades(s, d).where("size = 0"), "1 day"), "vwap", "sum_price_times_size", "sum_size")


@q
def obi_daily(s, d):
    return _doubles(features.obi(testdata.books(s, d), "1 day"), "obi", "bid_volume", "ask_volume")


@q
def micro_price_daily(s, d):
    return _doubles(features.micro_price(testdata.books(s, d), "1 day"), "micro_price", "best_bid", "best_ask", "bid_volume", "ask_volume")


@q
def vpin(s, d):
    return _doubles(features.vpin(testdata.trades(s, d), "1 day", 500, 5), "vpin", "unknown_volume")


@q
def candles(s, d):
    return _doubles(features.candles(testdata.trades(s, d), "1 hour"), "open", "high", "low", "close", "volume")


def _few(run):
    """These streams have a handful of keys: as many partitions of state as that, whatever the session's tables are shuffled to."""

    @functools.wraps(run)
    def call(s, *args, **kwargs):
        with session.setting(s, "spark.sql.shuffle.partitions", "8"):
            return run(s, *args, **kwargs)

    return call


#: Arrivals that a batch of these streams takes, about: what a task of Python holds of a batch does not grow with the input.
BATCH = 500_000


def _parts(df, by):
    """df in order of `by`, part by part: about BATCH rows each, and two at least, so that streams are stopped and started again. Also whether it is the last.

    The rows are written once, in order, so that a part's read is bounded by the files' own statistics.
    """
    n = max(2, -(-df.count() // BATCH))
    kept = session.settled(df.repartitionByRange(max(8, n), by).sortWithinPartitions(by), "arrivals")
    ends = kept.agg(F.percentile_approx(by, [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    ends = sorted(set(ends))
    for k in range(len(ends) + 1):
        lo, hi = (F.col(by) > ends[k - 1] if k else F.lit(True)), (F.col(by) <= ends[k] if k < len(ends) else F.lit(True))
        yield kept.where(lo & hi), k == len(ends)


def _agg(a):
    return lambda s, d: features.generic(testdata.trades(s, d), a, "price", "1 day")


for _a in features.GENERIC:
    Q[f"agg_{_a.lower()}"] = _agg(_a)


@q
def agg_sliding(s, d):
    return features.generic(testdata.trades(s, d), "MAX", "price", "2 days", "1 day")


@q
def session_windows(s, d):
    g = testdata.trades(s, d).groupBy("instrument", F.session_window("event_time", "20 minutes").alias("w")).agg(F.count("*").alias("trade_count"))
    return g.select("instrument", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "trade_count")


def _checked(s, d):
    t = testdata.trades(s, d).withColumns({"source": F.when(F.col("event_id") % 11 == 0, "").otherwise("feed"), "price": F.when(F.col("event_id") % 7 == 0, -F.col("price")).otherwise(F.col("price"))})
    return t.withColumn("ingest_time", F.when(F.col("event_id") % 13 == 0, F.col("event_time") - F.expr("interval 31 seconds")).otherwise(F.col("event_time")))


@q
def validate_counts(s, d):
    v = validation.validate(_checked(s, d), "trade", "2024-01-20 00:00:00")
    return v.groupBy(F.concat_ws("; ", "reasons").alias("reasons")).agg(F.count("*").alias("n"))


@q
def dead_letter(s, d):
    bad = validation.split(_checked(s, d), "trade", "2024-01-20 00:00:00")[1]
    return bad.select(F.get_json_object("payload", "$.event_id").cast("bigint").alias("event_id"), "reason", "source", "rejected_at")


@q
def valid_trades(s, d):
    return validation.split(_checked(s, d), "trade", "2024-01-20 00:00:00")[0].select("event_id", "instrument", F.col("price").cast(D).alias("price"))


@q
def fenced(s, d):
    return windows.assign(windows.fence(testdata.trades(s, d), "U3"), "1 hour").select("event_id", "window_start", "window_end")


@q
def late_split(s, d):
    m = windows.watermarked(testdata.arrivals(s, d), "1 hour", [0, 1, 2], F.expr("seq div 1000000 div 86400"))
    return m.select("event_id", "instrument", "window_start", "watermark", "late")


@q
def closed_windows(s, d):
    m = windows.watermarked(testdata.arrivals(s, d), "1 hour", [0, 1, 2], F.expr("seq div 1000000 div 86400"))
    return windows.closed(m).groupBy("instrument", "window_start").agg(F.count("*").alias("n"))


def _signals(s, d):
    return testdata.trades(s, d).withColumns({"price": F.when(F.col("event_id") % 3 == 0, F.col("price")), "sig": F.when(F.col("event_id") % 3 == 1, F.col("size"))})


@q
def asof_price(s, d):
    return signals.asof_price(_signals(s, d)).select("event_id", F.col("asof_price").cast(D).alias("asof_price"))


def _returns(s, d):
    return signals.forward_return(_signals(s, d), F.col("sig"), 3600)


@q
def forward_return(s, d):
    return _doubles(_returns(s, d), "entry", "exit").select("instrument", F.col("seq").alias("event_id"), "signal", "entry", "exit", "exit_time", F.round("forward_return", 9).alias("forward_return"))


@q
def forward_return_ic(s, d):
    return signals.information_coefficient(_returns(s, d), "signal", "forward_return", ["instrument"]).withColumn("ic", F.round("ic", 7))


def _plan(t):
    return features.all_features(t, None, "1 hour", bucket=500, history=5)


@q
def live_replay_diff(s, d):
    t = testdata.trades(s, d)
    live = _plan(t)
    again = _plan(readers.in_range(t.where("event_id % 50 <> 7"), "2024-01-01 00:00:00", "2024-01-20 00:00:00"))
    return replay.divergence_counts(replay.compare(live, again))


@q
def replay_range(s, d):
    return _doubles(features.vwap(readers.in_range(testdata.trades(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00"), "1 hour"), "vwap").select("instrument", "window_start", "vwap", "trade_count")


@q
def replay_callback_range(s, d):
    r = readers.in_range(testdata.trades(s, d), "2024-01-05 00:00:00", "2024-01-06 00:00:00", closed=True)
    return r.groupBy("instrument").agg(F.count("*").alias("n"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))


def _deltas(s, d):
    action = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "view", "MODIFY").otherwise("ADD")
    t = testdata.events(s, d)
    side = F.when(F.expr("event_id div 5") % 2 == 0, "BUY").otherwise("SELL")
    return t.select(
        F.concat(F.lit("U"), (F.expr("event_id div 5") % 8).cast("string")).alias("instrument"), F.expr("cast(event_id div 5 as string)").alias("order_id"), side.alias("side"), F.round("value", 0).alias("price"), F.get_json_object("props", "$.k").cast(D).alias("quantity"), action.alias("action"), F.col("event_id").alias("seq"), F.col("ts").alias("event_time")
    )


@q
def l3_levels(s, d):
    return book.levels(_deltas(s, d))


@q
def l3_bbo(s, d):
    return book.best(book.levels(_deltas(s, d)))


@q
def sequence_gaps(s, d):
    return book.sequence_gaps(_deltas(s, d).where("seq % 97 not in (5, 6)").withColumn("venue", F.lit("all")), ["venue"])


@q
def l3_contiguous(s, d):
    t = _deltas(s, d).withColumn("venue", (F.col("seq") % 1).cast("int"))
    t = t.crossJoin(t.agg((F.max("seq") - 3).alias("hole"))).where("seq <> hole").drop("hole")  # near the end, so that all but the last deltas are applied
    snap = s.createDataFrame([(0, 100)], "venue int, snapshot_seq bigint")
    return book.contiguous(t, snap, ["venue"]).groupBy("venue").agg(F.count("*").alias("applied"), F.max("seq").alias("last_seq"))


@q
def feature_range_query(s, d):
    f = features.long_form(features.vwap(testdata.trades(s, d), "1 hour"), "vwap.1m", "vwap", "trade_count").where("instrument = 'U3'")
    return query.series(f, "2024-01-02 00:00:00", "2024-01-10 00:00:00", 50).select("window_start", "window_end", F.col("value").cast(D).alias("value"), "input_count")


@q
def latest_snapshot(s, d):
    b = testdata.books(s, d)
    return query.latest(b, ["instrument"], ["event_time", "event_id"], ["event_id", "event_time", "bids", "asks"]).select("instrument", "event_id", "event_time", F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"))


def _raw(s, d):
    """Raw records with tombstones, text that is no JSON, bytes that are no UTF-8, null keys, repeated JSON keys, white space around, things after the object, and fields of other types."""
    e = testdata.events(s, d)
    kind = F.col("event_id") % 10
    symbol = F.when(kind == 6, F.lit("7")).otherwise(F.concat(F.lit('"U'), (F.col("user_id") % 8).cast("string"), F.lit('"')))
    head = F.when(kind == 3, '{"source":"old","source":"').when(kind == 4, '\t\n {"source":"').otherwise('{"source":"')
    tail = F.when(kind == 5, '},"price":1.500} x').when(kind == 7, '},"price":1.500}\r\n').otherwise('},"price":1.500}')
    js = F.concat(head, F.col("event_type"), F.lit('","instrument":{"symbol":'), symbol, tail)
    value = F.when(kind == 0, None).when(kind == 1, F.lit("not json").cast("binary")).when(kind == 2, F.unhex(F.lit("7BFF7D"))).otherwise(js.cast("binary"))
    key = F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string"))
    return e.select(F.lit("events.trade").alias("topic"), (F.col("user_id") % 3).cast("int").alias("partition"), F.col("event_id").alias("offset"), F.unix_millis("ts").alias("timestamp"), key.alias("key"), value.alias("value"))


@q
def raw_dedup(s, d):
    root = session.work_dir(s, "raw")
    for _ in range(2):  # the second write repeats every record
        sinks.write_raw(_raw(s, d).withColumn("timestamp", F.lit(1_704_067_200_000)), root)
    t = readers.raw_log(s, root)
    return t.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"), F.count("key").alias("keys"), F.count("value_base64").alias("not_json"))


@q
def raw_groups(s, d):
    return sinks.raw_groups(_raw(s, d)).withColumns({"month": F.col("month").cast("int"), "day": F.col("day").cast("int"), "hour": F.col("hour").cast("int")})


@q
def raw_encoding(s, d):
    return sinks.raw_lines(_raw(s, d)).select("offset", "line", "source", "instrument")


def _present(s, d):
    """Rows and instruments of each feature that the tables give."""
    f = features.all_features(testdata.trades(s, d), testdata.books(s, d), "1 day", bucket=500, history=5)
    return f.groupBy(F.col("feature_name").alias("name")).agg(F.count("*").alias("n"), F.count_distinct("instrument").alias("instruments"))


@q
def feature_catalog(s, d):
    """Active definitions, with what there is of each."""
    c = readers.catalog(s).where("active").join(_present(s, d), "name", "left")
    return c.select("name", "version", "aggregation", "window_duration", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("instruments", F.lit(0)).alias("instruments"))


@q
def known_instruments(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("U"), F.col("n_nationkey").cast("string")).alias("instrument")).where("instrument in ('U1', 'U3', 'U5')")
    t = testdata.trades(s, d)
    a, b = validation.known_instruments(t, n), validation.known_instruments(t, n, known=False)
    return a.groupBy("instrument").agg(F.count("*").alias("n")).withColumn("known", F.lit(True)).unionByName(b.groupBy("instrument").agg(F.count("*").alias("n")).withColumn("known", F.lit(False)))


@q
def sequence_numbers(s, d):
    e = testdata.events(s, d)
    value = F.when(F.col("event_id") % 9 == 0, F.lit('{"stream":"btcusdt@trade","data":{"s":"ETHUSDT","t":1,"p":"1","q":"1","T":0,"m":true}}')).otherwise(
        F.concat(F.lit('{"stream":"btcusdt@trade","data":{"s":"BTCUSDT","t":'), F.col("event_id").cast("string"), F.lit(',"p":"'), F.col("value").cast("string"), F.lit('","q":"1.5","T":'), F.unix_millis("ts").cast("string"), F.lit(',"m":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit("}}"))
    )
    p = venues.combined_stream(e.select(F.col("event_id").alias("arrival"), F.col("ts").alias("ingest_time"), value.alias("value")))
    return p.select("arrival", "instrument", F.col("sequence_number").cast("bigint").alias("sequence_number"), "side", F.col("event_time").alias("event_time"), F.coalesce("reason", F.lit("")).alias("reason"))


@q
def feature_topics(s, d):
    """Topic and table of each feature that there is."""
    c = _present(s, d).join(readers.catalog(s).select("name", "version"), "name")
    return c.select("name", exact.topic(F.col("name"), F.col("version")).alias("topic"), exact.table_name(F.col("name")).alias("table_name"), "n")


@q
def feature_tables(s, d):
    """Features saved to a table each, twice over half of the instruments, and one instrument's series read back."""
    root = session.work_dir(s, "tables")
    database = "tickloom_" + root.rsplit("-", 1)[1]
    s.sql(f"create database {database} location '{root}/database'")
    f = features.all_features(testdata.trades(s, d), testdata.books(s, d), "1 day", bucket=500, history=5)
    for part in ("instrument in ('U1', 'U3')", "instrument not in ('U1', 'U3')"):
        saved = sinks.save_tables(f.where(part), ["vwap.1m", "obi", "vpin"], f"{root}/features", database)
    one = query.table_series(s, saved[0].location, "U3", "2024-01-02T00:00:00Z", "2024-01-10T00:00:00Z")
    n = [s.table(t.location).groupBy("feature_name").agg(F.count("*").alias("n")) for t in saved]
    told = n[0].unionByName(n[1]).unionByName(n[2]).select("feature_name", F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast(D).alias("value"), "n")
    return told.unionByName(one.select(F.lit("series").alias("feature_name"), "window_start", F.col("value").cast(D).alias("value"), F.col("input_count").alias("n")))


@q
def uuid7_time(s, d):
    e = testdata.events(s, d)
    made = F.concat(F.lpad(F.lower(F.hex(F.unix_millis("ts"))), 12, "0"), F.lpad(F.lower(F.hex("event_id")), 20, "0"))
    dashed = F.regexp_replace(made, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return e.select("event_id", exact.uuid7_millis(dashed).alias("millis"))


@q
def ingest_answers(s, d):
    return edge.answers(_checked(s, d), "trade", "2024-01-20 00:00:00")


@q
def published_topics(s, d):
    f = features.long_form(features.vwap(testdata.trades(s, d), "1 day"), "vwap.1m", "vwap", "trade_count")
    return f.groupBy(sinks.checked_topic("features.", F.col("feature_name"), F.col("feature_version")).alias("topic"), "instrument").agg(F.count("*").alias("n"), F.sum("input_count").alias("inputs"))


@q
def features_long(s, d):
    return features.all_features(testdata.trades(s, d), testdata.books(s, d), "1 day", bucket=500, history=5).select("instrument", "feature_name", "window_start", F.col("value").cast(D).alias("value"), "input_count")


@q
def sql_passthrough(s, d):
    testdata.events(s, d).createOrReplaceTempView("events_sql")
    return readers.sql(s, "select event_type, count(*) as n, max(ts) as last_time from events_sql where event_id >= :least group by event_type", {"least": 0})


@q
def vwap_large(s, d):
    """Volumes of cheap tokens: a day's notional is beyond 10^14."""
    t = testdata.trades(s, d).withColumn("size", (F.col("size") + F.lit(9_000_000_000)).cast("decimal(18,8)"))
    return features.vwap(t, "1 day").select("instrument", "window_start", F.round(F.col("vwap").cast(D), 4).alias("vwap"), F.col("sum_size").cast(D).alias("sum_size"), "trade_count")


@q
def vpin_large(s, d):
    """Each trade fills some nine billion buckets."""
    t = testdata.trades(s, d).withColumn("size", (F.col("size") + F.lit(9_000_000_000)).cast("decimal(18,8)"))
    return features.vpin(t, "1 day", 1, 5).select("instrument", "window_start", F.round(F.col("vpin").cast(D), 8).alias("vpin"), "buckets_closed", "trade_count")


@q
def feature_values(s, d):
    f = features.long_form(features.vwap(testdata.trades(s, d), "1 day"), "vwap.1m", "vwap", "trade_count", values=features.VWAP_VALUES)
    return f.select("instrument", "window_start", *[F.col("values")[k].cast(D).alias(c) for k, c in features.VWAP_VALUES.items()])


def _marked(s, d):
    return windows.watermarked(testdata.arrivals(s, d), "1 hour", [0, 1, 2], F.expr("seq div 1000000 div 86400"))


@q
def accepted_features(s, d):
    """Features of the events that were not late, in windows that have closed."""
    f = features.all_features(windows.closed(_marked(s, d)), None, "1 hour", bucket=500, history=5)
    return f.select("instrument", "feature_name", "window_start", F.col("value").cast(D).alias("value"), "input_count")


@_few
def _engine(s, d, name=None, counters=None):
    """What the stream engine tells, stopped after each part and started again from its checkpoint; the last part ends the input."""
    root = session.work_dir(s, "exact-stream")
    t = testdata.arrivals(s, d)
    for part, last in _parts(t, "seq"):
        part = part.unionByName(engine.ended(t)) if last else part
        part.write.mode("append").parquet(f"{root}/in")
        out = engine.ExactEngine(3600, [0, 1, 2], "500", 5).told(s.readStream.schema(t.schema).parquet(f"{root}/in"))
        w = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")
        run = (w.queryName(name) if name else w).trigger(availableNow=True).start()
        run.awaitTermination()
        if counters:
            counters.wait(run)
    return s.read.schema(engine.TOLD).parquet(f"{root}/out")


@q
def exact_stream(s, d):
    """The features of the stream engine."""
    return engine.features(_engine(s, d)).select("instrument", "feature_name", "window_start", F.col("value").cast(D).alias("value"), "input_count")


@q
def late_stream(s, d):
    """The arrivals that were too late for the stream engine."""
    return engine.late(_engine(s, d)).select("instrument", "window_start", "event_id", "event_time")


@q
def revised_vwap(s, d):
    """Prices of closed windows, with those arrivals in them that came too late."""
    return _doubles(engine.revised(_engine(s, d)), "value")


@q
def stream_counters(s, d):
    """What a listener has counted while the stream engine ran, over its restart."""
    counters = metrics.Counters()
    s.streams.addListener(counters)
    try:
        _engine(s, d, "counted", counters)
    finally:
        s.streams.removeListener(counters)
    t = counters.totals["counted"]
    return s.createDataFrame([(t["received"], t["late"], t["received"] - t["late"], t["features"])], "received bigint, late bigint, accepted bigint, emitted bigint")


@_few
def _judged(s, d):
    """Signals judged by the stream, stopped half-way and started again."""
    root = session.work_dir(s, "signals")
    t = _signals(s, d)
    half = t.agg(F.percentile_approx(F.unix_micros("event_time"), 0.5)).first()[0]
    for part in (F.unix_micros("event_time") <= half, F.unix_micros("event_time") > half):
        t.where(part).write.mode("append").parquet(f"{root}/in")
        out = judge.judged(s.readStream.schema(t.schema).parquet(f"{root}/in"), F.col("sig"), 3600)
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(judge.OUT).parquet(f"{root}/out")


@q
def signal_stream(s, d):
    return judge.returns(_judged(s, d)).select("instrument", F.col("seq").alias("event_id"), "signal", "entry", "exit", "exit_time", F.round("forward_return", 9).alias("forward_return"))


@q
def signal_stream_ic(s, d):
    return judge.correlation(_judged(s, d)).withColumn("ic", F.round("ic", 7))


@q
def delivered_stream(s, d):
    """Raw events, some undecodable and some against the rules, delivered as a stream to their topic and the dead letters, in two batches."""
    root = session.work_dir(s, "delivered")
    c = _checked(s, d).withColumns({"event_id": F.col("event_id").cast("string"), "number": F.col("event_id")})
    body = F.to_json(F.struct("event_id", "event_time", "ingest_time", "source", "instrument", "price", "size", "side")).cast("binary")
    value = F.when(F.col("number") % 17 == 0, F.lit("no json").cast("binary")).when(F.col("number") % 19 == 0, F.unhex(F.lit("7BFF"))).otherwise(body)
    raw = c.select(F.lit("raw").alias("topic"), F.lit(0).alias("partition"), F.col("number").alias("offset"), F.lit(0).cast("bigint").alias("timestamp"), F.lit(None).cast("string").alias("key"), value.alias("value"))
    send = delivery.deliver("trade", root, "trades", "2024-01-20 00:00:00")
    for part in ("offset % 2 = 0", "offset % 2 = 1"):
        raw.where(part).write.mode("append").parquet(f"{root}/in")
        s.readStream.schema(raw.schema).parquet(f"{root}/in").writeStream.foreachBatch(send).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    good = delivery.delivered(s, root, "trades", "events.trade", schemas.TRADE).select(F.lit("events.trade").alias("topic"), F.lit("").alias("reason"))
    dead = delivery.delivered(s, root, "trades", delivery.DEAD, delivery.LETTER).select(F.lit(delivery.DEAD).alias("topic"), "reason")
    return good.unionByName(dead).groupBy("topic", "reason").agg(F.count("*").alias("n"))


@q
def decoded_events(s, d):
    """JSON of several shapes by one schema: what parses, with absent fields null, and what does not."""
    e = testdata.events(s, d)
    kind = F.col("event_id") % 6
    js = F.to_json(F.struct("event_id", "event_type", F.col("value").alias("price"))).cast("string")
    value = F.when(kind == 0, F.lit("{broken")).when(kind == 1, F.lit('{"event_id":"x"}')).when(kind == 2, F.lit('{"other":1}')).otherwise(js)
    good, bad = readers.decode(e.select(value.alias("value")), "event_id bigint, event_type string, price double")
    one = lambda df, what, c: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"), F.count(c).alias("with_id"))
    return one(good, "good", F.col("event_id")).unionByName(one(bad, "bad", F.lit(None)))


@q
def archived_tail(s, d):
    """Features archived as a stream, once although the stream is run again, and those of a pattern tailed from the archive."""
    root = session.work_dir(s, "archived")
    f = features.all_features(testdata.trades(s, d), None, "1 day", bucket=500, history=5)
    for part in ("instrument < 'U4'", "instrument >= 'U4'"):
        f.where(part).write.mode("append").parquet(f"{root}/in")
        for _ in range(2):
            live.archive(s.readStream.schema(f.schema).parquet(f"{root}/in"), f"{root}/archive", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    tail = readers.feature_tail(s, f"{root}/archive", "^features[.]vwap[.]").select("instrument", "window_start", "value", "input_count")
    tail.writeStream.format("parquet").option("path", f"{root}/tail").option("checkpointLocation", f"{root}/tailing").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(tail.schema).parquet(f"{root}/tail").select("instrument", "window_start", F.col("value").cast(D).alias("value"), "input_count")


@q
def fanned_out(s, d):
    """What clients of one feature, of all, and one that fails get of a stream of features."""
    root = session.work_dir(s, "fanned")
    f = features.all_features(testdata.trades(s, d), None, "1 day", bucket=500, history=5)
    f.write.parquet(f"{root}/in")
    got, refused = {"vwap.1m": [0, 0], "all": [0, 0]}, []

    def client(name):
        def take(rows):
            got[name][0] += len(rows)
            got[name][1] += sum(r["input_count"] for r in rows)

        return take

    def broken(rows):
        raise OSError("gone")

    send = live.fan_out(f, {"vwap.1m": client("vwap.1m"), None: client("all"), "vpin": broken}, refused)
    s.readStream.schema(f.schema).parquet(f"{root}/in").writeStream.foreachBatch(send).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return s.createDataFrame([(k, *v) for k, v in got.items()] + [(f"refused {k}: {why}", 0, 0) for k, why in refused], "client string, n bigint, inputs bigint")


@q
def replay_jobs(s, d):
    """Jobs over two ranges, one told in another zone, and one that is refused: their status, rows and sums."""
    jobs = replay.Jobs(lambda t: features.all_features(t, None, "1 hour", bucket=500, history=5), session.work_dir(s, "jobs"))
    t = testdata.trades(s, d)
    done = [jobs.get(jobs.submit(t, a, b).id, wait=True) for a, b in (("2024-01-05T00:00:00+00:00", "2024-01-06T00:00:00+00:00"), ("2024-01-08T05:00:00+05:00", "2024-01-08T20:00:00+00:00"))]
    out = None
    for k, job in enumerate(done):
        g = s.read.parquet(job.location).groupBy("feature_name").agg(F.count("*").alias("n"), F.sum("input_count").alias("inputs"))
        g = g.select(F.lit(k).alias("job"), F.lit(job.status).alias("status"), "feature_name", "n", "inputs")
        out = g if out is None else out.unionByName(g)
    try:
        jobs.submit(t, "2024-01-06T00:00:00+05:00", "2024-01-05T00:00:00Z")
    except query.BadRequest as e:
        out = out.unionByName(s.createDataFrame([(2, str(e), None, 0, 0)], out.schema))
    return out


@q
@_few
def engine_state(s, d):
    """Windows that the stream engine holds open once the input stops without an end, read from its checkpoint."""
    root = session.work_dir(s, "engine-state")
    t = testdata.arrivals(s, d)
    for part, _ in _parts(t, "seq"):
        part.write.mode("append").parquet(f"{root}/in")
        out = engine.ExactEngine(3600, [0, 1, 2], "500", 5).run(s.readStream.schema(t.schema).parquet(f"{root}/in"))
        out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    state.check(s, f"{root}/state", engine.VERSION)
    w = state.rows(s, f"{root}/state", "windows")
    return w.select(F.col("key.instrument").alias("instrument"), F.timestamp_micros("user_map_key.start").alias("window_start"), F.col("user_map_value.n").alias("n"), (F.col("user_map_value.v").cast(D) / engine.UNIT).alias("volume"))


def _numbered(t):
    """Trades in arrival order (seq) with their offsets by partition, without holes; ends are counted apart."""
    t = t.withColumns({"_chunk": F.expr("seq div 1000000 div 86400"), "_end": F.col("event_time").isNull()})
    return running(t, ["partition"], "_chunk", ["seq", "instrument"], offset=("sum", F.lit(1))).drop("_chunk")


def _log(t):
    """Numbered trades as raw records; ends under a topic of their own."""
    said = F.struct(F.lit("feed").alias("source"), F.struct(F.col("instrument").alias("symbol")).alias("instrument"), "event_id", F.unix_micros("event_time").alias("event_us"), "price", "size", "side", "seq")
    topic, part = F.when(F.col("_end"), "events.end").otherwise("events.trade"), F.when(F.col("_end"), 0).otherwise(F.col("partition"))
    return t.select(topic.alias("topic"), part.cast("int").alias("partition"), (F.col("offset") - 1).cast("bigint").alias("offset"), F.coalesce(F.unix_millis("event_time"), F.lit(0)).alias("timestamp"), F.col("instrument").alias("key"), F.to_json(said).cast("binary").alias("value"))


#: Times that the live engine is started at most: between, it runs on from part to part.
STARTS = 8


@q
@_few
def live_features(s, d):
    """Trades recorded as they arrive, read back from the log as a live stream, and turned into features; the recorder is stopped after each part and started again, the engine after an eighth of the parts (one at least)."""
    root = session.work_dir(s, "live")
    t = testdata.arrivals(s, d)
    exact = engine.ExactEngine(3600, [0, 1, 2], "500", 5)
    # A part has of each partition the records that follow those before; ends are in the last.
    parts, tasks = [part for part, _ in _parts(session.settled(_numbered(t.unionByName(engine.ended(t))), "numbered"), "seq")], s.sparkContext.defaultParallelism
    each = -(-len(parts) // STARTS)
    for lo in range(0, len(parts), each):
        run = None
        try:
            for part in parts[lo : lo + each]:
                # Whatever files a part's rows come from, all tasks make and record them; their order within a part is told by their numbers.
                _log(part.repartition(tasks)).write.mode("append").parquet(f"{root}/in")
                rawlog.record(s.readStream.schema(schemas.RAW).parquet(f"{root}/in"), f"{root}/log", f"{root}/recorder").trigger(availableNow=True).start().awaitTermination()
                if run is None:
                    out = exact.run(readers.ticks(rawlog.live(s, f"{root}/log")))
                    w = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")
                    run = w.trigger(processingTime="500 milliseconds").start()
                # The recorder commits a part at once, so that the engine takes it as one batch, and it is told before the next is recorded.
                run.processAllAvailable()
        finally:
            if run is not None:
                run.stop()
    return s.read.schema(engine.FEATURE).parquet(f"{root}/out").select("instrument", "feature_name", "window_start", F.col("value").cast(D).alias("value"), "input_count")


@q
def recorded_stream(s, d):
    """Raw records of any bytes through the recorder, in two batches, and read back."""
    root = session.work_dir(s, "recorded")
    raw = _raw(s, d).withColumn("timestamp", F.lit(1_704_067_200_000))
    for part in ("offset % 3 = 0", "offset % 3 <> 0"):
        raw.where(part).write.mode("append").parquet(f"{root}/in")
        rawlog.record(s.readStream.schema(raw.schema).parquet(f"{root}/in"), f"{root}/log", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    t = rawlog.whole(s, f"{root}/log")
    return t.groupBy("topic", "partition").agg(F.count("*").alias("n"), F.max("offset").alias("last_offset"), F.count("key").alias("keys"), F.count("value").alias("objects"))


@q
def operational_counts(s, d):
    return _doubles(edge.counters(_marked(s, d)), "unknown_volume")


@q
def published_events(s, d):
    root = session.work_dir(s, "published")
    edge.publish(_checked(s, d), "trade", root, "2024-01-20 00:00:00")
    good, dead = (s.read.parquet(f"{root}/topic={t}").agg(F.count("*").alias("n")).withColumn("topic", F.lit(t)) for t in ("events.trade", "events.deadletter"))
    return good.unionByName(dead)


@q
def feature_files(s, d):
    """Written under their folders and served from them, by instants of other zones."""
    root = session.work_dir(s, "features")
    sinks.write_features(features.long_form(features.vwap(testdata.trades(s, d), "1 day"), "vwap.1m", "vwap", "trade_count"), root)
    f = query.feature_series(s, root, "vwap.1m", "U3", "2024-01-02T05:00:00+05:00", "2024-01-09T19:00:00-05:00")
    return f.select("window_start", "window_end", F.col("value").cast(D).alias("value"), "input_count")


def _k():
    return F.get_json_object("props", "$.k").cast(D)


@q
def rule_counts(s, d):
    """Rules of candles, books and deltas: how many rows fail which."""
    e = testdata.events(s, d).withColumns({"instrument": F.lit("I"), "event_time": F.col("ts"), "k": _k()})
    candle = e.withColumns({"high": F.col("value"), "low": F.col("k"), "volume": F.col("k") - 50, "window_start": F.col("ts"), "window_end": F.expr("ts + make_interval(0, 0, 0, 0, cast(event_id % 3 - 1 as int))")}).drop("value")
    book_ = testdata.books(s, d).withColumn("depth", F.size("bids"))
    delta = e.withColumns({"order_id": F.when(F.col("event_id") % 10 == 0, " ").otherwise(F.col("event_id").cast("string")), "price": F.col("value") - 100, "quantity": F.col("k") - 50, "action": F.when(F.col("event_type") == "error", "DELETE").otherwise("ADD")})
    out = None
    for kind, df in (("candle", candle), ("book", book_), ("delta", delta)):
        v = validation.validate(df, kind, "2024-01-20 00:00:00").groupBy(F.lit(kind).alias("kind"), F.concat_ws("; ", "reasons").alias("reasons")).agg(F.count("*").alias("n"))
        out = v if out is None else out.unionByName(v)
    return out


def _messages(s, d, *parts):
    e = testdata.events(s, d).withColumn("k", F.get_json_object("props", "$.k"))
    return e.select(F.col("event_id").alias("arrival"), F.col("ts").alias("ingest_time"), F.concat(*[F.col(p[1:]).cast("string") if p.startswith("@") else F.lit(p) for p in parts]).alias("value"))


@q
def book_messages(s, d):
    m = _messages(s, d, '{"stream":"ethusd@depth5","data":{"lastUpdateId":', "@event_id", ',"bids":[["', "@value", '","', "@k", '"],["1","0"]],"asks":[["2.5","1"]]}}')
    p = venues.combined_stream(m)
    best = lambda c: F.get(F.col(c), F.lit(0))["price"].cast(D)
    return p.select("arrival", "instrument", "kind", F.col("sequence_number").cast("bigint").alias("sequence_number"), F.size("bids").alias("n_bids"), F.size("asks").alias("n_asks"), best("bids").alias("bid"), best("asks").alias("ask"), "depth", "event_time")


@q
def listed_messages(s, d):
    """Two items a message, the second of a market that is no BASE-QUOTE pair."""
    m = _messages(s, d, '{"arg":{"channel":"trades","instId":"BTC-USDT"},"data":[{"instId":"BTC-USDT","tradeId":"', "@event_id", '","px":"', "@value", '","sz":"', "@k", '","side":"sell","ts":"1747000000000"},{"instId":"BTC-USDT-SWAP","tradeId":"1","px":"5","sz":"2","side":"buy","ts":"1"}]}')
    p = venues.listed_stream(m)
    return p.select("arrival.arrival", "arrival.item", "instrument", F.col("sequence_number").cast("bigint").alias("sequence_number"), "side", F.col("price").cast(D).alias("price"), F.col("size").cast(D).alias("size"), "event_time", "exchange_trade_id", F.coalesce("reason", F.lit("")).alias("reason"))


#: Books that stay in step, or not: S0 has no snapshot, S2 misses a delta, S3 gets one last, S4 too but is snapshotted again, S5 gets all twice.
def _arrived(s, d):
    t = _deltas(s, d).withColumns({"instrument": F.concat(F.lit("S"), (F.col("seq") % 6).cast("string")), "id": F.col("seq"), "seq": F.expr("seq div 6")})
    t = t.where("instrument <> 'S2' or seq <> 20")
    arrival = F.expr("(id + id * 7919 % 60) * 1000000 + id % 1000000")
    t = t.withColumn("arrival", F.when(F.col("instrument").isin("S3", "S4") & (F.col("seq") == 30), F.col("id") + F.lit(10**15)).otherwise(arrival))
    twice = t.where("instrument = 'S5'").withColumn("arrival", F.col("arrival") + 200 * 10**6)
    return t.unionByName(twice).select("instrument", "arrival", "seq", "order_id", "side", "price", "quantity", "action", "event_time")


def _snapshots(t):
    """One before anything else, and one more of S4 half-way through the numbers it got."""
    first = t.where("instrument <> 'S0'").select("instrument").distinct().select("instrument", F.lit(0).cast("long").alias("arrival"), F.lit(9).cast("long").alias("snapshot_seq"))
    again = t.where("instrument = 'S4'").groupBy("instrument").agg(F.floor(F.max("seq") / 2).alias("snapshot_seq"))
    at = t.where("instrument = 'S4' and seq <> 30").groupBy("instrument", "seq").agg(F.max("arrival").alias("arrival"))
    again = again.join(at, "instrument").where("seq = snapshot_seq").select("instrument", F.col("arrival").cast("long").alias("arrival"), F.col("snapshot_seq").cast("long").alias("snapshot_seq"))
    return first.unionByName(again)


@q
def sync_states(s, d):
    """Books by order of arrival: without a snapshot, in step, desynchronised by too many deltas that wait, and in step again."""
    t = _arrived(s, d)
    return book.sync_state(t, _snapshots(t), ["instrument"], held=40)


@q
@_few
def sync_stream(s, d):
    """The same from the stream of snapshots and the stream of deltas, stopped after each part and started again from its checkpoint."""
    root = session.work_dir(s, "sync-stream")
    t = _arrived(s, d)
    snaps = session.settled(_snapshots(t), "snapshots")
    done = None
    for part, last in _parts(t, "arrival"):
        top = part.agg(F.max("arrival")).first()[0]
        mine = (F.lit(True) if done is None else F.col("arrival") > done) & (F.lit(True) if last else F.col("arrival") <= top)
        done = top
        part.write.mode("append").parquet(f"{root}/deltas")
        snaps.where(mine).write.mode("append").parquet(f"{root}/snapshots")
        told = sync.synced(s.readStream.schema(t.schema).parquet(f"{root}/deltas"), s.readStream.schema(snaps.schema).parquet(f"{root}/snapshots"), held=40)
        w = told.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append")
        w.trigger(availableNow=True).start().awaitTermination()
    return sync.states(s.read.schema(sync.OUT).parquet(f"{root}/out"))


def _naive(run):
    """Instants as UTC wall times, as SQL engines without zones have them."""

    @functools.wraps(run)
    def call(s, d):
        df = run(s, d)
        return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})

    return call


Q.update({k: _naive(v) for k, v in Q.items()})
