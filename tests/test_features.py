from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest

from tickloom import schemas
from tickloom.operators import book, features, signals, validation, windows
from pyspark.sql import functions as F

T0 = datetime(2026, 5, 11, 14)
BOOK = f"instrument string, event_id bigint, event_time timestamp, bids array<{schemas.LEVEL}>, asks array<{schemas.LEVEL}>"


def ticks(spark, rows):
    """rows: (seconds after 14:00, price, size, side, partition)"""
    data = [("I", i, T0 + timedelta(seconds=t), D(str(p)), D(str(s)), side, part, i) for i, (t, p, s, side, part) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.TICK)


def books(spark, rows):
    conv = lambda x: [(D(str(p)), D(str(s))) for p, s in x]
    return spark.createDataFrame([("I", i, T0 + timedelta(seconds=t), conv(b), conv(a)) for i, (t, b, a) in enumerate(rows)], BOOK)


def values(df, col):
    return [r[col] for r in df.orderBy("window_start").collect()]


def test_vwap_golden(spark):
    rows = [(0, 67500, 0.5), (10, 67510, 1), (20, 67490, 0.25), (30, 67520, 2), (40, 67505, 0.75), (60, 67530, 1.5), (70, 67515, 0.3), (80, 67540, 0.8), (90, 67525, 1.2), (120, 67550, 0.6), (130, 67535, 1), (140, 67560, 0.4), (180, 67545, 0.9), (190, 67570, 0.5), (240, 67555, 1.1)]
    got = values(features.vwap(ticks(spark, [(*r, "BUY", 0) for r in rows]), "1 minute"), "vwap")
    assert got == [D("67511.38888889"), D("67529.34210526"), D("67544.50000000"), D("67553.92857143"), D("67555.00000000")]


def test_vwap_zero_sizes_is_mean(spark):
    assert values(features.vwap(ticks(spark, [(0, 10, 0, "BUY", 0), (1, 20, 0, "BUY", 0)]), "1 minute"), "vwap") == [D("15.00000000")]
    assert features.vwap(ticks(spark, []), "1 minute").count() == 0


def test_obi_and_micro_price_golden(spark):
    b = books(spark, [(10, [(67480, 0.1)], [(67530, 0.1)]), (40, [(67500, 3), (67490, 2)], [(67510, 1), (67520, 1)]), (80, [(67505, 1)], [(67515, 4)])])
    o = features.obi(b, "1 minute")
    assert values(o, "obi") == [D("0.42857143"), D("-0.60000000")] and values(o, "levels") == [2, 1]
    assert values(features.micro_price(b, "1 minute"), "micro_price") == [D("67507.50000000"), D("67507.00000000")]
    empty = books(spark, [(0, [], [(10, 1)]), (60, [(10, 0)], [(12, 0)])])
    assert values(features.micro_price(empty, "1 minute"), "micro_price") == [D("11.00000000")]
    assert values(features.obi(empty, "1 minute"), "obi") == [D("-1.00000000"), D("0.00000000")]
    with pytest.raises(ValueError):
        features.obi(b, "1 minute", 0)


@pytest.mark.parametrize(
    ("rows", "v", "n", "want"),
    [([(10, "BUY")], 10, 1, [D(1)]), ([(25, "BUY")], 10, 3, []), ([(5, "BUY"), (5, "SELL")], 10, 1, [D(0)]), ([(10, "UNKNOWN")], 10, 1, [D(0)]), ([(10, "BUY"), (10, "SELL"), (6, "BUY"), (4, "SELL")], 10, 2, [D("0.6")])],
)
def test_vpin(spark, rows, v, n, want):
    assert values(features.vpin(ticks(spark, [(i, 1, s, side, 0) for i, (s, side) in enumerate(rows)]), "1 minute", v, n), "vpin") == want


def test_vpin_carries_over_windows_and_refuses_bad_parameters(spark):
    t = ticks(spark, [(0, 1, 7, "BUY", 0), (60, 1, 5, "BUY", 0)])
    assert values(features.vpin(t, "1 minute", 10, 1), "vpin") == [D(1)]
    with pytest.raises(ValueError):
        features.vpin(t, "1 minute", 0, 1)


def test_parity_set(spark):
    t = ticks(spark, [(5, 60000, 0.1, "BUY", 0), (30, 60010, 0.05, "BUY", 0), (55, 60005, 0.2, "SELL", 0)])
    assert values(features.vwap(t, "1 minute"), "vwap") == [D("60004.28571429")]
    assert values(features.vpin(t, "1 minute", D("0.35"), 1), "vpin") == [D("0.14285714")]
    b = books(spark, [(40, [(59995, 9)], [(60005, 1)])])
    assert values(features.obi(b, "1 minute"), "obi") == [D("0.80000000")] and values(features.micro_price(b, "1 minute"), "micro_price") == [D("60004.00000000")]


def test_late_and_closed(spark):
    day = F.to_date("event_time")
    m = windows.watermarked(ticks(spark, [(10, 1, 1, "BUY", 0), (70, 1, 1, "BUY", 0), (5, 1, 1, "BUY", 0)]), "1 minute", [0], day)
    assert [r.late for r in m.orderBy("seq").collect()] == [False, False, True]
    assert windows.closed(m).count() == 1 and windows.closed(m, flush=True).count() == 2
    two = windows.watermarked(ticks(spark, [(120, 1, 1, "BUY", 0), (30, 1, 1, "BUY", 1)]), "1 minute", [0, 1], day)
    assert windows.closed(two).count() == 0
    more = windows.watermarked(ticks(spark, [(120, 1, 1, "BUY", 0), (30, 1, 1, "BUY", 1), (70, 1, 1, "BUY", 1)]), "1 minute", [0, 1], day)
    assert [r.window_start.minute for r in windows.closed(more).collect()] == [0]


def test_order_does_not_matter(spark):
    t = ticks(spark, [(i * 7 % 300, 100 + i % 13, i % 5, ("BUY", "SELL", "UNKNOWN")[i % 3], 0) for i in range(200)])
    a = features.all_features(t, None, "1 minute", bucket=20, history=3)
    b = features.all_features(t.orderBy(F.xxhash64("event_id")).repartition(7), None, "1 minute", bucket=20, history=3)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_validation_rules(spark):
    now = "2026-05-11 14:00:00"
    base = (1, "x", "I", T0, T0, D(1), D(1))
    ddl = "event_id bigint, source string, instrument string, event_time timestamp, ingest_time timestamp, price decimal(18,8), size decimal(18,8)"
    bad = [base, (1, "x", "I", datetime(2019, 12, 31), T0, D(1), D(1)), (1, "x", "I", T0 + timedelta(minutes=6), T0 + timedelta(minutes=6), D(1), D(1)), (1, "x", "I", T0 + timedelta(seconds=31), T0, D(1), D(1)), (1, "x", "I", T0 + timedelta(seconds=30), T0, D(1), D(1)), (1, " ", "I", T0, T0, D(0), D(-1))]
    got = [r.reasons for r in validation.validate(spark.createDataFrame(bad, ddl).coalesce(1), "trade", now).collect()]
    assert got == [[], ["event_time is before 2020-01-01"], ["event_time is in the future"], ["event_time is ahead of ingest_time"], [], ["source is required", "price must be positive", "size must not be negative"]]


def test_book_best_and_delete(spark):
    ddl = "instrument string, order_id string, side string, price double, quantity double, action string, seq bigint"
    adds = [("I", "O1", "BUY", 60000.0, 1.0, "ADD", 1), ("I", "O2", "BUY", 60010.0, 1.0, "ADD", 2), ("I", "O3", "SELL", 60020.0, 1.0, "ADD", 3), ("I", "O4", "SELL", 60015.0, 1.0, "ADD", 4)]
    r = book.best(book.levels(spark.createDataFrame(adds, ddl))).first()
    assert (r.best_bid, r.best_ask) == (60010.0, 60015.0)
    r = book.best(book.levels(spark.createDataFrame([*adds, ("I", "O2", "BUY", 60010.0, 0.0, "DELETE", 5)], ddl))).first()
    assert r.best_bid == 60000.0


def test_ic_degenerate(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 1.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", float("nan"), 1.0)], "k string, x double, y double")
    got = {r.k: r.ic for r in signals.information_coefficient(d, "x", "y", ["k"]).collect()}
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 1) < 1e-12
