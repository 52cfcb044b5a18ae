"""Books replayed by their rule, raw bytes, large volumes, the stream engine's four features and restart, clients, names and counts."""

import os
import random
from datetime import timedelta
from decimal import Decimal as D
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.test_edge import finish
from tests.test_features import T0, books, ticks
from tickloom import schemas
from tickloom.functions import exact
from tickloom.operators import book, features
from tickloom.plans import query, replay, sinks
from tickloom.sources import venues
from tickloom.streaming import engine, live

DELTAS = "instrument string, order_id string, side string, price double, quantity double, action string, seq bigint"


def test_levels_equal_replayed_deltas(spark):
    r, rows = random.Random(4), []
    for seq in range(600):
        rows.append(("I", f"O{r.randint(0, 40)}", r.choice(("BUY", "SELL")), float(r.randint(1, 6)), float(r.randint(0, 5)), r.choice(("ADD", "MODIFY", "DELETE")), seq))
    live_, want = {}, {}
    for _, o, side, price, q, action, _ in rows:
        if action == "ADD" and o not in live_:
            live_[o] = [side, price, q]
        elif action == "MODIFY" and o in live_:
            live_[o][2] = q
        elif action == "DELETE":
            live_.pop(o, None)
    for side, price, q in live_.values():
        n = want.setdefault((side, price), [0.0, 0])
        n[0], n[1] = n[0] + q, n[1] + 1
    got = book.levels(spark.createDataFrame(rows, DELTAS).repartition(5))
    assert {(x.side, x.price): [x.quantity, x.orders] for x in got.collect()} == want
    b = book.best(got).first()
    assert b.best_bid == max(p for s, p in want if s == "BUY") and b.best_ask == min(p for s, p in want if s == "SELL")
    again = [("I", "O", "BUY", 1.0, 7.0, "ADD", 1), ("I", "O", "BUY", 2.0, 9.0, "ADD", 2), ("I", "O", "BUY", 0.0, 0.0, "DELETE", 3), ("I", "O", "SELL", 5.0, 1.0, "ADD", 4)]
    assert [tuple(x) for x in book.levels(spark.createDataFrame(again, DELTAS)).collect()] == [("I", "SELL", 5.0, 1.0, 1)]


def test_raw_lines_of_any_bytes(spark):
    rows = [("t", 0, 1, 0, None, b'{"source":"x"}'), ("t", 0, 2, 0, "k", b"{\xff}"), ("t", 0, 3, 0, "k", b"")]
    got = sinks.raw_lines(spark.createDataFrame(rows, schemas.RAW)).orderBy("offset").collect()
    assert got[0].line == '{"topic":"t","partition":0,"offset":1,"timestamp":0,"key":null,"value":{"source":"x"}}' and got[0].source == "x"
    assert got[1].source == got[1].instrument == "_unparsed" and got[1].line.endswith('"valueBase64":"e/99"}') and got[2].source == "_unparsed"


def test_ratios_are_half_even_at_any_size(spark):
    r = random.Random(6)
    rows = [(D(r.randint(-(10 ** r.randint(1, 36)), 10 ** r.randint(1, 36))).scaleb(-16), D(r.randint(1, 10 ** r.randint(1, 27))).scaleb(-8)) for _ in range(500)]
    rows += [(D("0.000000005"), D(1)), (D("0.000000015"), D(1)), (D("-0.000000025"), D(1)), (D("0.0000000050000001"), D(1)), (D(0), D(3))]
    rows = [(a, b) for a, b in rows if abs(a / b) < 10**10]
    d = spark.createDataFrame(rows, "a decimal(38,16), b decimal(28,8)").select("a", "b", exact.ratio8(F.col("a"), F.col("b")).alias("q"))
    for x in d.collect():
        assert Fraction(x.q) * 10**8 == round(Fraction(x.a) / Fraction(x.b) * 10**8), x
    big = ticks(spark, [(i, "9000000000.5", "9000000000", "BUY", 0) for i in range(30)])
    assert features.vwap(big, "1 hour").first().vwap == D("9000000000.50000000")


def test_engine_emits_all_features_and_restarts(spark, tmp_path):
    r = random.Random(2)
    t = ticks(spark, [(i * 2, 100 + i % 13, 1 + i % 5, ("BUY", "SELL", "UNKNOWN")[i % 3], i % 2) for i in range(120)])
    level = lambda k: [(k - j, r.randint(0, 4)) for j in range(r.randint(0, 7))]
    b = books(spark, [(i * 7, level(100), [(101 + j, q) for j, (_, q) in enumerate(level(100))]) for i in range(34)])
    b = b.withColumns({"partition": F.lit(0), "seq": F.col("event_id") * 3 + 1})
    want = {(x.feature_name, x.window_start): (x.value, x.input_count) for x in features.all_features(t, b, "1 minute", bucket=20, history=3).collect()}
    exact_, at = engine.ExactEngine(60, [0, 1], "20", 3), str(tmp_path)
    for k, part in enumerate(("event_time < '2026-05-11 14:01:30'", "event_time >= '2026-05-11 14:01:30'")):
        t.where(part).coalesce(1).write.mode("append").parquet(f"{at}/t")
        b.where(part).coalesce(1).write.mode("append").parquet(f"{at}/b")
        out = exact_.run(*(spark.readStream.schema(d.schema).parquet(f"{at}/{x}") for d, x in ((t, "t"), (b, "b"))))
        finish(out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/c").outputMode("append"))
    rows = spark.read.schema(engine.FEATURE).parquet(f"{at}/out").collect()
    got = {(x.feature_name, x.window_start): (x.value, x.input_count) for x in rows}
    closed = {k: v for k, v in want.items() if k[1] < T0 + timedelta(minutes=3)}
    assert len(got) == len(rows) and got == closed and {k[0] for k in got} == set(features.REGISTRY)


def test_the_stream_tells_each_closed_window_once(spark):
    """On these tables an instrument's first window is passed before its last partition begins."""
    if not os.path.isdir(sf := "/root/testdata/sf0.01"):
        pytest.skip("no tables here")
    rows = lambda name: sorted((r.instrument, r.feature_name, r.window_start, round(r.value, 6), r.input_count) for r in entry.queries()[name](spark, sf).collect())
    assert rows("exact_stream") == rows("accepted_features")


def test_clients_get_their_rows_and_a_failing_one_is_told(spark):
    f = features.all_features(ticks(spark, [(i, 5, 1, "BUY", 0) for i in range(200)]), None, "1 minute", bucket=2, history=1)
    seen, refused = {"vwap.1m": [], None: []}, []

    def broken(rows):
        raise OSError("gone")

    clients = {"vwap.1m": seen["vwap.1m"].extend, None: seen[None].extend, "vpin": broken}
    live.fan_out(f, clients, refused)(f, 0)
    assert len(seen["vwap.1m"]) == 4 and len(seen[None]) == f.count() and refused == [("vpin", "gone")] and "vpin" not in clients


def test_stream_names_and_jobs(spark, tmp_path):
    assert venues.stream_names([" BTCUSDT", "ethusdt", "btcusdt"], ["trade", "trade", "depth5"]) == ["btcusdt@trade", "btcusdt@depth5", "ethusdt@trade", "ethusdt@depth5"]
    for bad in (([], ["trade"]), (["x"], []), (["x"], ["depth5", "depth10"]), (["x"], ["depth"]), (["x"], ["depth7"]), ([f"s{i}" for i in range(513)], ["trade", "depth5"])):
        with pytest.raises(ValueError):
            venues.stream_names(*bad)
    jobs = replay.Jobs(lambda d: d, str(tmp_path))
    t = features.long_form(features.vwap(ticks(spark, [(0, 1, 1, "BUY", 0)]), "1 minute"), "vwap.1m", "vwap", "trade_count").withColumn("event_time", F.col("window_start"))
    ids = [jobs.get(jobs.submit(t, "2026-05-11 14:00:00", "2026-05-11 15:00:00").id, wait=True).id for _ in range(2)]
    assert [j.id for j in jobs.list()] == ids[::-1] and all(j.status == "COMPLETED" for j in jobs.list())
    assert len(venues.stream_names([f"s{i}" for i in range(512)], ["trade", "depth20@100ms"])) == 1024
    assert sinks.write_features(t.drop("event_time"), str(tmp_path / "f")) == sinks.Written(str(tmp_path / "f"), 1, "parquet")
    got = query.feature_series(spark, str(tmp_path / "f"), "vwap.1m", "I", "2026-04-30T00:00:00", "2026-05-12T00:00:00")
    assert got.count() == 1


def test_series_by_instants_of_any_offset(spark, tmp_path):
    """The same seven hours, told in three zones and without one, are the same rows."""
    rows = spark.range(48).selectExpr("'e' as event_id", "'BTC-USDT' as instrument", "'vwap.1m' as feature_name", "'v1' as feature_version", "cast(id as decimal(28,8)) as value", "timestamp'2026-05-10 12:00:00' + make_interval(0,0,0,0,cast(id as int)) as window_start", "timestamp'2026-05-10 13:00:00' + make_interval(0,0,0,0,cast(id as int)) as window_end", "1L as input_count", "'c' as code_version")
    sinks.write_features(rows, str(tmp_path / "f"))
    ask = lambda a, b: [float(r.value) for r in query.feature_series(spark, str(tmp_path / "f"), "vwap.1m", "BTC-USDT", a, b).collect()]
    want = [float(i) for i in range(8, 15)]
    for a, b in (("2026-05-10T20:00:00+00:00", "2026-05-11T03:00:00Z"), ("2026-05-11T01:00:00+05:00", "2026-05-11T08:00:00+05:00"), ("2026-05-10T17:00:00-03:00", "2026-05-11T00:00:00-03:00"), ("2026-05-10T20:00:00", "2026-05-11T06:00:00+03:00"), ("2026-05-10T20:00:00", "2026-05-11T03:00:00")):
        assert ask(a, b) == want, (a, b)
    for a, b in (("yesterday", "2026-05-11T03:00:00"), ("2026-05-11T03:00:00+05:00", "2026-05-10T20:00:00")):
        with pytest.raises(query.BadRequest):
            ask(a, b)


def test_raw_lines_read_as_a_json_parser_reads_them(spark):
    import json

    cases = [
        ('{"source":"a","source":"b","instrument":{"symbol":"X"}}', "b", "X"), ('\t {"source":"a","instrument":{"symbol":"X-1"}} \r\n', "a", "X-1"), ('{"source":7,"instrument":{"symbol":7}}', "_unknown", "_unknown"),
        ('{"source":["a"],"instrument":"X"}', "_unknown", "_unknown"), ('{"source":"a"} {}', "_unparsed", "_unparsed"), ('{"source":"a"},{"b":1}', "_unparsed", "_unparsed"), ("[1]", "_unparsed", "_unparsed"), ('"{"', "_unparsed", "_unparsed"),
        ("{'source':'a'}", "_unparsed", "_unparsed"), ('{"source":NaN}', "_unparsed", "_unparsed"), ('{"source":"a\nb"}', "_unparsed", "_unparsed"), ('{"source":\n"a"\r\n}', "a", "_unknown"), ("{}", "_unknown", "_unknown"), ("", "_unparsed", "_unparsed"), ('{"a":{"b":1,"b":2},"source":"s"}', "s", "_unknown"), ("x" * 300, "_unparsed", "_unparsed"),
        ('{"source":null,"instrument":{"symbol":"a/b"}}', "_unknown", "a_b"), ('{"source":"..","instrument":{"symbol":true}}', "_unknown", "_unknown"),
    ]
    d = spark.createDataFrame([("t", 0, i, 0, None, bytearray(v.encode())) for i, (v, _, _) in enumerate(cases)], schemas.RAW)
    got = {r.offset: r for r in sinks.raw_lines(d).collect()}
    for i, (v, source, instrument) in enumerate(cases):
        r = got[i]
        assert (r.source, r.instrument) == (source, instrument), v
        assert "\n" not in r.line and "\r" not in r.line
        assert json.loads(r.line)["offset"] == i
