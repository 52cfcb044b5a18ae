"""Delivery to two sinks, signals, counters and state of streams; ordered writes of a hot instrument; feature tables and streams read back."""

import glob
import json
import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tests.memory import Handle
from tests.test_features import T0
from tickloom import schemas
from tickloom.operators import features
from tickloom.plans import edge, query, sinks
from tickloom.sources import readers
from tickloom.streaming import delivery, engine, metrics, signals, state


def event(i, price=1.0):
    return {"event_id": f"e{i}", "event_time": "2026-05-11T14:00:00Z", "ingest_time": "2026-05-11T14:00:00Z", "source": "feed", "instrument": "BTC-USDT", "price": price, "size": 1.0, "side": "BUY"}


def raw(spark, lo, hi):
    """Of ten records one is no JSON, one no text, two break a rule."""
    value = lambda i: {0: b"nope", 1: b"\xff\x00", 2: json.dumps(event(i, -1.0)).encode(), 3: json.dumps(event(i, 0.0)).encode()}.get(i % 10, json.dumps(event(i)).encode())
    return spark.createDataFrame([("raw", 0, i, 0, None, bytearray(value(i))) for i in range(lo, hi)], schemas.RAW)


NOW = "2026-05-11 15:00:00"


def test_a_failure_between_both_sinks_loses_and_repeats_nothing(spark, tmp_path):
    at, calls = str(tmp_path), []

    def write(df, path):
        calls.append(path)
        df.write.mode("overwrite").parquet(path)
        if "deadletter" in path and "batch=1" in path and sum("deadletter" in c and "batch=1" in c for c in calls) <= 2:
            raise OSError("store is away")  # after its files are there

    def run(send):
        s = spark.readStream.schema(schemas.RAW).parquet(f"{at}/in")
        s.writeStream.foreachBatch(send).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()

    raw(spark, 0, 50).write.mode("append").parquet(f"{at}/in")
    send = lambda attempts: delivery.deliver("trade", f"{at}/out", "q", NOW, delivery.Ledger(f"{at}/out", "q", attempts, 0), write)
    run(send(2))
    raw(spark, 50, 100).write.mode("append").parquet(f"{at}/in")
    with pytest.raises(Exception, match="store is away"):
        run(send(2))
    assert sum("events.trade" in c and "batch=1" in c for c in calls) == 1 and sum("deadletter" in c and "batch=1" in c for c in calls) == 2
    got = lambda sink, shape: delivery.delivered(spark, f"{at}/out", "q", sink, shape)
    assert (got("events.trade", schemas.TRADE).count(), got(delivery.DEAD, delivery.LETTER).count()) == (60, 20)
    run(send(2))  # the restart repeats the batch: the first sink has it, the second's is written whole
    assert sum("events.trade" in c and "batch=1" in c for c in calls) == 1
    good, dead = got("events.trade", schemas.TRADE), got(delivery.DEAD, delivery.LETTER)
    assert sorted(r.event_id for r in good.collect()) == sorted(f"e{i}" for i in range(100) if i % 10 > 3)
    assert {r.reason: r.n for r in dead.groupBy("reason").agg(F.count("*").alias("n")).collect()} == {"not decodable": 20, "price must be positive": 20}
    assert {r.payload for r in dead.where("reason = 'not decodable'").collect()} == {"nope", "/wA="}


def test_signals_equal_brute_force_and_write_what_they_touch(monkeypatch):
    monkeypatch.setattr(signals, "PIECE", 4)
    r = random.Random(6)
    for _ in range(20):
        at, rows = 0, []
        for k in range(160):
            at += r.choice((0, 1, 2, 15))
            rows.append((at, k, r.choice((None, r.randint(1, 9))), r.choice((None, None, float(r.randint(-5, 5))))))
        price, priced = None, []
        for us, k, p, s in rows:
            price = price if p is None else float(p)
            priced.append((us, k, s, price))
        want = []
        for us, k, s, p in priced:
            if s is not None and p is not None and (x := next((q for q in priced if q[0] >= us + 20), None)):
                want.append((us, k, s, p, x[3], x[0]))
        handle, got = Handle(), []
        for a in range(0, 160, 23):
            e = signals.Signals(20)
            e.init(handle)
            got += list(e.take(iter(rows[a : a + 23])))
        assert got == want
        waiting = sum(len(v[0]) for v in handle.states["waiting"].held.values())
        assert waiting <= sum(s is not None for _, _, s, _ in priced) - len(want) + 4


def test_moments_merge_to_the_correlation():
    r = random.Random(1)
    x = [r.gauss(3, 2) for _ in range(300)]
    y = [a * 0.3 + r.gauss(0, 1) for a in x]
    parts = [signals.Moments() for _ in range(7)]
    for k, (a, b) in enumerate(zip(x, y, strict=True)):
        parts[k % 7] = parts[k % 7].merge(signals.Moments(1, a, b))
    r.shuffle(parts)
    m = signals.Moments()
    for p in parts:
        m = m.merge(p)
    assert m.n == 300 and abs(m.told() - np.corrcoef(x, y)[0, 1]) < 1e-12
    assert signals.Moments(1, 1.0, 1.0).told() is None and signals.Moments().merge(signals.Moments()).told() is None


def test_counters_count_each_batch_once():
    c = metrics.Counters()
    row = lambda **k: SimpleNamespace(asDict=lambda: k)
    told = lambda batch, **k: c.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(batchId=batch, id="1", name="q", timestamp="2026-05-11T14:00:10.000Z", observedMetrics={"in": row(**k)})))
    told(0, received=5, last_time=T0)
    told(0, received=5, last_time=T0)
    told(1, received=2, last_time=None)
    assert c.totals["q"]["received"] == 7 and c.last["q"]["last_time"] == T0 and math.isfinite(c.lag["q"])


def test_state_is_listed_and_another_version_refused(spark, tmp_path, monkeypatch):
    at = str(tmp_path)
    state.check(spark, f"{at}/none", engine.VERSION)
    t = spark.range(90).selectExpr("concat('I', id % 2) as instrument", "id as event_id", "timestamp'2026-05-11 14:00:00' + make_interval(0,0,0,0,0,0,id * 2) as event_time", "cast(id + 1 as decimal(18,8)) as price", "cast(1 as decimal(18,8)) as size", "'BUY' as side", "0 as partition", "id as seq")
    t.write.parquet(f"{at}/in")
    out = engine.ExactEngine(60, [0]).run(spark.readStream.schema(t.schema).parquet(f"{at}/in"))
    out.writeStream.format("noop").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    (op,) = state.variables(spark, f"{at}/c").collect()
    assert op.operatorName.startswith("transformWithState") and op.maxBatchId >= 0
    one = state.rows(spark, f"{at}/c", "windows").where("key.instrument = 'I1'").select("user_map_key.start", "user_map_value.n", "user_map_value.v").collect()
    assert [(r.n, int(r.v)) for r in one] == [(15, 15 * 10**8)]
    assert state.rows(spark, f"{at}/c", "buckets").count() == 2
    state.check(spark, f"{at}/c", engine.VERSION)
    with pytest.raises(state.WrongVersion, match="engine-1, not engine-2"):
        state.check(spark, f"{at}/c", "engine-2")


@pytest.fixture
def many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_instrument_is_written_by_many_tasks_in_order(many_tasks, tmp_path):
    spark, at = many_tasks, str(tmp_path)
    e = spark.range(4000).selectExpr("cast(id as string) as event_id", "timestamp'2026-05-11 14:00:00' + make_interval(0,0,0,0,0,0,(id * 7919) % 4000) as event_time", "timestamp'2026-05-11 16:00:00' as ingest_time", "'feed' as source", "'BTC-USDT' as instrument", "1.0 as price", "1.0 as size", "'BUY' as side")
    edge.publish(e.repartition(3), "trade", f"{at}/p", "2026-05-11 16:00:00")
    files = sorted(glob.glob(f"{at}/p/topic=events.trade/*.parquet"))
    times = [pq.read_table(f, columns=["event_time"]).column(0).to_pylist() for f in files]
    assert len([t for t in times if t]) == 4 and all(t == sorted(t) for t in times)
    ranges = sorted((t[0], t[-1]) for t in times if t)
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:], strict=False)) and max(map(len, times)) < 2000
    r = spark.range(4000).selectExpr("'t' as topic", "0 as partition", "id as offset", "1704067200000L + id as timestamp", "'k' as key", """cast('{"source":"s","instrument":{"symbol":"A"}}' as binary) as value""")
    sinks.write_raw(r, f"{at}/raw")
    assert len(glob.glob(f"{at}/raw/topic=t/source=s/instrument=A/*/*/*/*/*.gz")) == 4 and readers.raw_log(spark, f"{at}/raw").count() == 4000


def test_features_are_saved_to_tables_and_streamed(spark, tmp_path):
    at = str(tmp_path)
    t = spark.range(300).selectExpr("concat('I-', id % 3) as instrument", "id as event_id", "timestamp'2026-05-11 14:00:00' + make_interval(0,0,0,0,0,0,id) as event_time", "cast(id + 1 as decimal(18,8)) as price", "cast(2 as decimal(18,8)) as size", "if(id % 2 = 0, 'BUY', 'SELL') as side", "0 as partition", "id as seq")
    f = features.all_features(t, None, "1 minute", bucket=20, history=2)
    spark.sql(f"create database saved location '{at}/db'")
    try:
        n = {r[0]: r[1] for r in f.where("instrument <> 'I-2'").groupBy("feature_name").count().collect()}
        written = sinks.save_tables(f.where("instrument <> 'I-2'"), ["vwap.1m", "vpin"], f"{at}/f", "saved")
        assert written == [sinks.Written("saved.features_vwap_1m", n["vwap.1m"], "tables"), sinks.Written("saved.features_vpin", n["vpin"], "tables")]
        names = [w.location for w in sinks.save_tables(f.where("instrument = 'I-2'"), ["vwap.1m", "vpin"], f"{at}/f", "saved")]
        assert names == [w.location for w in written]
        want = sorted((r.window_start, r.value) for r in f.where("feature_name = 'vwap.1m' and instrument = 'I-2'").collect())
        got = query.table_series(spark, names[0], "I-2", "2026-05-11T15:00:00+01:00", "2026-05-11T15:00:00Z").collect()
        assert [(r.window_start, r.value) for r in got] == want and spark.table(names[0]).count() == f.where("feature_name = 'vwap.1m'").count()
        assert query.table_series(spark, "saved.features_none", "I-2", "2026-05-11", "2026-05-12").count() == 0
        with pytest.raises(query.BadRequest):
            query.table_series(spark, "saved.features_x; drop", "I-2", "2026-05-11", "2026-05-12")
    finally:
        spark.sql("drop database saved cascade")
    long = f.withColumns({"event_time": F.col("window_end"), "values": F.lit(None).cast("map<string,decimal(28,8)>")})
    long.select(*spark.createDataFrame([], schemas.FEATURE).columns).write.parquet(f"{at}/s")
    s = readers.feature_stream(spark, f"{at}/s")
    s.writeStream.format("memory").queryName("streamed").option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("streamed").count() == f.count()
