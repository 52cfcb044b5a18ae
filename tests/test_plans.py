from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.test_features import T0, ticks
from tickloom.operators import features
from tickloom.plans import query, replay, sinks
from tickloom.sources import readers, venues
from tickloom.streaming import engine, live


def plan(t):
    return features.all_features(t, None, "1 minute", bucket=20, history=3)


def some(spark, n=200):
    return ticks(spark, [(i * 2, 100 + i % 13, 1 + i % 5, ("BUY", "SELL", "UNKNOWN")[i % 3], 0) for i in range(n)])


def test_replay_equals_live_and_divergence_is_found(spark, tmp_path):
    t = some(spark)
    jobs = replay.Jobs(plan, str(tmp_path))
    job = jobs.get(jobs.submit(t, "2026-05-11 14:00:00", "2026-05-11 15:00:00").id, wait=True)
    assert job.status == "COMPLETED" and job.rows == plan(t).count()
    again = spark.read.parquet(job.location)
    assert replay.compare(plan(t), again).where("diverges").count() == 0
    off = again.withColumn("value", F.when(F.col("feature_name") == "vpin", F.col("value") + 1).otherwise(F.col("value")).cast("decimal(28,8)"))
    counts = {r.feature_name: r.diverges for r in replay.divergence_counts(replay.compare(plan(t), off)).collect()}
    assert counts["vwap.1m"] == 0 and counts["vpin"] > 0


def test_written_features_are_served(spark, tmp_path):
    f = plan(some(spark))
    root = str(tmp_path / "features")
    sinks.write_features(f, root)
    got = query.feature_series(spark, root, "vwap.1m", "I", "2026-05-11T14:01:00", "2026-05-11T14:03:00")
    assert [r.window_start for r in got.collect()] == [T0 + timedelta(minutes=1), T0 + timedelta(minutes=2)]
    assert query.feature_series(spark, root, "vwap.1m", "I", "2026-05-11T14:00:00", "2026-05-11T15:00:00", 0).count() == 0
    assert query.feature_series(spark, root, "nothing", "I", "2026-05-11T14:00:00", "2026-05-11T15:00:00").count() == 0
    with pytest.raises(query.BadRequest):
        query.feature_series(spark, root, "vwap'--", "I", "2026-05-11T14:00:00", "2026-05-11T15:00:00")


def test_exact_engine_in_stream_equals_batch_plan(spark, tmp_path):
    t = some(spark, 100)
    path = str(tmp_path / "in")
    t.where("seq < 40").coalesce(1).write.mode("append").parquet(path)
    t.where("seq >= 40").coalesce(1).write.mode("append").parquet(path)
    exact = engine.ExactEngine(60, [0], "20", 3)
    stream = exact.run(spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path))
    q = stream.writeStream.format("memory").queryName("exact").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.feature_name, r.window_start): (r.value, r.input_count) for r in spark.table("exact").collect()}
    last = max(k[1] for k in got)
    want = {(r.feature_name, r.window_start): (r.value, r.input_count) for r in plan(t).collect() if r.window_start <= last}
    assert got == want and last == T0 + timedelta(minutes=2)


def test_builtin_watermark_stream(spark, tmp_path):
    t = some(spark, 100)
    path = str(tmp_path / "in")
    t.coalesce(1).write.parquet(path)
    s = live.closed_windows(spark.readStream.schema(t.schema).parquet(path), lambda d: features.vwap(d, "1 minute"))
    q = s.writeStream.format("memory").queryName("built").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("built")
    assert got.count() == 3 and got.join(features.vwap(t, "1 minute"), ["instrument", "window_start", "vwap"]).count() == 3


def raw(spark, *lines):
    return spark.createDataFrame([(i, T0, v) for i, v in enumerate(lines)], "arrival bigint, ingest_time timestamp, value string")


def test_venue_parsers(spark):
    one = '{"stream":"btcusdt@trade","data":{"s":"BTCUSDT","t":7,"p":"67500.10","q":"0.0015","T":1747000000000,"m":false}}'
    depth = '{"stream":"btcusdt@depth20","data":{"lastUpdateId":1,"bids":[["10","1"],["9","0"]],"asks":[["11","2"]]}}'
    r = venues.combined_stream(raw(spark, one, "junk", depth, '{"stream":"btcusdt@kline","data":{}}')).orderBy("arrival").collect()
    assert (r[0].instrument, r[0].side, r[0].price, r[0].exchange_trade_id, r[0].reason) == ("BTC-USDT", "BUY", D("67500.10000000"), "7", None)
    assert r[1].reason and r[3].reason == "unknown stream" and len(r[2].bids) == 1 and r[2].depth == 1
    trade = '{"arg":{"channel":"trades","instId":"BTC-USDT"},"data":[{"instId":"BTC-USDT","tradeId":"1","px":"5","sz":"2","side":"sell","ts":"1747000000000"},{"instId":"BTC-USDT-SWAP","tradeId":"2","px":"5","sz":"2","side":"buy","ts":"1"}]}'
    empty = '{"arg":{"channel":"books5","instId":"BTC-USDT"},"data":[{"bids":[],"asks":[["1","1","0","1"]],"ts":"1"}]}'
    r = venues.listed_stream(raw(spark, trade, '{"event":"subscribe"}', "pong", '{"event":"error","code":"1","msg":"x"}', empty)).orderBy("arrival").collect()
    assert [x.reason for x in r] == [None, "not BASE-QUOTE", "venue error", "empty side"] and r[0].side == "SELL"


def test_raw_log_keeps_digits(spark, tmp_path):
    rows = [("t", 0, 1, 0, "k", b'{"source":"x","instrument":{"symbol":"BTC-USDT"},"size":0.00150}'), ("t", 0, 2, 0, "k", b"nope"), ("t", 0, 3, 0, None, None), ("t", 0, 4, 0, "k", b'{"a":1} trailing')]
    d = sinks.raw_lines(spark.createDataFrame(rows, "topic string, partition int, offset bigint, timestamp bigint, key string, value binary")).orderBy("offset").collect()
    assert "0.00150" in d[0].line and [x.source for x in d] == ["x", "_unparsed", "_unknown", "_unparsed"]
    sinks.write_raw(spark.createDataFrame(rows * 2, "topic string, partition int, offset bigint, timestamp bigint, key string, value binary"), str(tmp_path / "raw"))
    assert readers.raw_log(spark, str(tmp_path / "raw")).count() == 4


def test_decode_separates_bad_json(spark):
    good, bad = readers.decode(spark.createDataFrame([('{"a":1}',), ("{oops",)], "value string"), "a int")
    assert [r.a for r in good.collect()] == [1] and bad.count() == 1
