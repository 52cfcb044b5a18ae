import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.test_features import T0
from tests.test_plans import plan, some
from tickloom import schemas
from tickloom.operators import book, signals
from tickloom.plans import edge, sinks
from tickloom.sources import readers
from tickloom.streaming import live

NOW = "2026-05-12 00:00:00"


def test_forward_return_equals_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in ("A", "B"):
        t = datetime(2026, 5, 10, 20)
        for i in range(150):
            t += timedelta(seconds=rng.choice((0, 0, 1, 60, 3600, 9000)))
            rows.append((k, t, i, rng.choice((None, D(rng.randint(1, 9)))), rng.choice((None, 1.0, 2.0))))
    for horizon in (1, 60, 3600, 200_000):
        want = set()
        for k in ("A", "B"):
            own = sorted((r for r in rows if r[0] == k), key=lambda r: r[1:3])
            price = None
            asof = [price := r[3] if r[3] is not None else price for r in own]
            for r, p in zip(own, asof, strict=True):
                later = [(x[1], x[2], q) for x, q in zip(own, asof, strict=True) if x[1] >= r[1] + timedelta(seconds=horizon)]
                if r[4] is not None and p is not None and later:
                    want.add((k, r[2], p, min(later)[2], min(later)[0]))
        d = spark.createDataFrame(rows, f"instrument string, event_time timestamp, seq bigint, price {schemas.NUMBER}, sig double")
        got = signals.forward_return(d, F.col("sig"), horizon).collect()
        assert {(r.instrument, r.seq, r.entry, r.exit, r.exit_time) for r in got} == want and len(got) == len(want)


def test_gaps_across_stretches_and_contiguous(spark, monkeypatch):
    monkeypatch.setattr(book, "STRETCH", 10)
    rng = random.Random(3)
    seqs = [i for i in range(1, 120) if rng.random() < 0.7] + [5, 5, 300]
    d = spark.createDataFrame([("v", i, T0) for i in seqs], "venue string, seq bigint, event_time timestamp")
    own = sorted(set(seqs))
    want = {b: b - a - 1 for a, b in zip(own, own[1:]) if b - a > 1}
    assert {r.seq: r.missing for r in book.sequence_gaps(d, ["venue"]).collect()} == want
    for snap in (own[0], own[-1], 1000):
        s = spark.createDataFrame([("v", snap)], "venue string, snapshot_seq bigint")
        good = []
        while (good[-1] if good else snap) + 1 in own:
            good.append((good[-1] if good else snap) + 1)
        assert sorted(r.seq for r in book.contiguous(d, s, ["venue"]).collect()) == good


def test_posted_events_are_answered_and_published(spark, tmp_path):
    ok = {"event_id": "a", "event_time": T0, "ingest_time": T0, "source": "s", "instrument": "I", "price": D(1), "size": D(2)}
    d = edge.posted(spark, [ok, ok | {"event_id": "b", "price": D(0), "source": " "}], "trade")
    told, seen = edge.publish(d, "trade", str(tmp_path), NOW)
    assert [(r.event_id, r.status, r.message) for r in told.orderBy("event_id").collect()] == [("a", 201, ""), ("b", 400, "source is required; price must be positive")]
    assert seen.get["rows"] == 1
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/topic=events.trade").collect()] == ["a"]
    assert [r.source for r in spark.read.parquet(f"{tmp_path}/topic=events.deadletter").collect()] == [" "]
    with pytest.raises(ValueError):
        edge.posted(spark, [], "other")


def test_replay_to_handler_includes_both_ends(spark):
    got = []
    r = edge.replay_to(some(spark, 50), T0, T0 + timedelta(seconds=20), lambda df: got.extend(df.collect()))
    assert r.rows == len(got) == 11 and r.elapsed_ms >= 0


def test_query_metrics_count_failures_too():
    m = edge.QueryMetrics()
    assert m.timed("spark", lambda: 3) == 3
    with pytest.raises(ZeroDivisionError):
        m.timed("spark", lambda: 1 / 0)
    assert m.requests == {"spark": 2} and m.seconds["spark"] >= 0


def finish(writer):
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_streams_are_archived_tailed_and_recorded_once(spark, tmp_path):
    f, at = plan(some(spark, 60)), str(tmp_path)
    f.coalesce(1).write.parquet(f"{at}/in")
    for _ in range(2):  # a second run finds nothing new
        finish(live.archive(spark.readStream.schema(f.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/c1"))
    assert spark.read.parquet(f"{at}/out").count() == f.count()
    finish(readers.feature_tail(spark, f"{at}/out", r"^features[.]vwap").writeStream.format("memory").queryName("tail").option("checkpointLocation", f"{at}/c2"))
    assert spark.table("tail").count() == f.where("feature_name = 'vwap.1m'").count() > 0
    raw = spark.createDataFrame([("t", 0, 1, 0, "k", b'{"source":"x","instrument":{"symbol":"I"}}'), ("t", 0, 2, 0, "k", b"nope")], schemas.RAW)
    raw.write.parquet(f"{at}/raw")
    finish(live.record(spark.readStream.schema(raw.schema).parquet(f"{at}/raw"), f"{at}/log", f"{at}/c3"))
    assert sorted(r.offset for r in readers.raw_log(spark, f"{at}/log").collect()) == [1, 2]


def test_paired_streams_tell_differences(spark, tmp_path):
    f, at = plan(some(spark, 100)).where("feature_name = 'vwap.1m'"), str(tmp_path)
    f.coalesce(1).write.parquet(f"{at}/a")
    f.withColumn("value", F.when(F.minute("window_start") == 1, F.col("value") + 1).otherwise(F.col("value")).cast("decimal(28,8)")).coalesce(1).write.parquet(f"{at}/b")
    both = live.paired(*(spark.readStream.schema(f.schema).parquet(f"{at}/{x}") for x in "ab"))
    finish(both.writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", f"{at}/c"))
    got = spark.table("pairs").collect()
    assert len(got) == f.count() and sum(r.value_differs for r in got) == 1 and sum(r.diverges for r in got) == 1


def test_topic_outside_prefix_is_refused(spark):
    d = spark.createDataFrame([("vwap.1m", "v1")], "n string, v string")
    assert d.select(sinks.checked_topic("features.", F.col("n"), F.col("v"))).first()[0] == "features.vwap.1m.v1"
    with pytest.raises(Exception, match="outside prefix"):
        d.select(sinks.checked_topic("other.", F.col("n"), F.col("v"))).collect()
