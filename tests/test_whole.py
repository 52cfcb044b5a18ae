"""Registered queries do the whole table, beyond the sizes at which a cut would bind."""

import os

import pytest

import __spark_entry__ as entry
from tests.test_plans import raw
from tickloom.sources import venues

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@tables
def test_sequence_numbers_of_all_events(spark):
    ids = sorted(r.event_id for r in spark.read.parquet(f"{SF}/events.parquet").select("event_id").collect())
    got = entry.queries()["sequence_numbers"](spark, SF).select("arrival", "sequence_number").collect()
    assert sorted(map(tuple, got)) == [(x, i + 1) for i, x in enumerate(ids)] and len(ids) > 3000


def test_numbers_run_on_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(venues, "STRETCH", 7)
    line = lambda i: ("junk", '{"stream":"btcusdt@trade","data":{}}', '{"stream":"ethusdt@depth5","data":{}}', '{"stream":"btcusdt@kline"}')[(i * 7 + i // 3) % 4]
    r = venues.combined_stream(raw(spark, *map(line, range(60))).repartition(5)).orderBy("arrival").collect()
    seen = {}
    for x in r:
        k = (x.instrument, x.kind)
        seen[k] = seen.get(k, 0) + 1
        assert x.sequence_number == seen[k]
    assert len(r) == 60 and (None, None) in seen and ("BTC-USDT", None) in seen
    item = '{"instId":"BTC-USDT","tradeId":"1","px":"5","sz":"2","side":"sell","ts":"1"}'
    two = '{"arg":{"channel":"trades","instId":"BTC-USDT"},"data":[' + item + "," + item + "]}"
    error = '{"event":"error","code":"1","msg":"x"}'
    r = venues.listed_stream(raw(spark, *[error if i % 5 == 0 else two for i in range(30)])).orderBy("arrival").collect()
    assert [x.sequence_number for x in r if x.kind] == list(range(1, 49)) and [x.sequence_number for x in r if not x.kind] == list(range(1, 7))


def test_one_hot_series_is_numbered_in_many_tasks(spark):
    """The window over messages is dealt by stretch, not by series alone."""
    value = '{"stream":"btcusdt@trade","data":{}}'
    d = spark.range(50_000).selectExpr("id as arrival", "timestamp'2026-01-01' as ingest_time", f"'{value}' as value")
    out = venues.combined_stream(d)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window [" in x and "_o_sequence_number" in x]
    assert windows and all("_stretch" in x for x in windows)
    assert out.agg({"sequence_number": "max"}).first()[0] == 50_000


@tables
def test_contiguous_applies_all_deltas_up_to_a_hole_near_the_end(spark):
    top = spark.read.parquet(f"{SF}/events.parquet").agg({"event_id": "max"}).first()[0]
    (r,) = entry.queries()["l3_contiguous"](spark, SF).collect()
    assert (r.applied, r.last_seq) == (top - 4 - 100, top - 4) and top > 996
