"""The stream engine's rules on a state in memory, its volume buckets, and its state in checkpoints."""

import random

import pytest

from tests.memory import Handle
from tickloom.streaming import engine
from tickloom.streaming.engine import UNIT, Buckets, Engine

SECOND = 1_000_000


def row(t, part=0, price=1, q=1, sign=1):
    return (engine.TRADE, t * SECOND, t, t, part, price * UNIT, q * UNIT, sign, [], [], [], [])


END = (engine.END, 0, 0, 0, 0, 0, 0, 0, [], [], [], [])


class Run:
    """An engine whose batches are `take`n one by one, each by a processor made anew, as after a restart."""

    def __init__(self, partitions, **kwargs):
        self.handle, self.args = Handle(), (60 * SECOND, partitions, kwargs.get("bucket", "1"), kwargs.get("history", 1), 5)

    def take(self, *rows):
        e, out = Engine(*self.args), []
        e.init(self.handle)
        e.take(iter(rows), out)
        return out

    def told(self, *rows):
        return [(start // SECOND, v // UNIT, n) for what, name, start, v, n, *_ in self.take(*rows) if name == "vwap.1m"]


def test_late_rows_are_told():
    r = Run([0])
    out = r.take(row(5), row(60), row(30)) + r.take(row(50), row(90))
    assert [(x[0], x[2], x[5]) for x in out if x[0] == "late"] == [("late", 0, 30), ("late", 0, 50)]
    assert [(x[1], x[2], x[4]) for x in out if x[1] == "vwap.1m"] == [("vwap.1m", 0, 1)]


def test_a_window_waits_for_partitions_without_data_and_is_told_once():
    r = Run([0, 1])
    # The first arrival of partition 1 takes the watermark back into the window that partition 0 has passed.
    assert r.told(row(10, price=10), row(70, price=70)) == [] and r.told(row(20, 1, price=20), row(80, 1, price=80)) == [(0, 15, 2)]
    # What never has data does not hold windows for ever: an end tells so, and nothing is told again after it.
    r = Run([0, 1])
    assert r.told(row(10, price=10), row(70, price=70), END) == [(0, 10, 1)]
    out = r.take(row(20, 1), row(140), row(150, 1))
    assert [(x[2] // SECOND, x[4]) for x in out if x[1] == "vwap.1m"] == [(60, 1)] and sum(x[0] == "late" for x in out) == 1
    assert Run([0, 1]).take(END) == []


def test_what_a_batch_writes_does_not_grow_with_open_rows():
    r, wrote = Run([0, 1]), []
    for k in range(40):  # partition 1 is silent, so every window stays open
        before = r.handle.written
        r.take(*[row(k * 30 + j, price=5) for j in range(10)])
        wrote.append(r.handle.written - before)
    assert max(wrote[2:]) == min(wrote[2:])
    assert len(r.handle.states["windows"].held) == 20
    assert len(r.take(row(40 * 30), row(40 * 30, 1))) == 2 * 20 and [k[0] for k in r.handle.states["trades"].held] == [1200 * SECOND]


def test_state_of_another_version_is_refused(monkeypatch):
    r = Run([0])
    r.take(row(1))
    monkeypatch.setattr(engine, "VERSION", "engine-0")
    with pytest.raises(ValueError, match="engine-1"):
        r.take(row(2))


def test_buckets_by_runs_equal_buckets_one_by_one():
    r = random.Random(1)
    for _ in range(150):
        unit, history = r.randint(1, 20), r.randint(1, 6)
        b, filled, net, past = Buckets(unit, history), 0, 0, []
        for _ in range(80):
            size, sign = r.choice((0, 1, 2, unit, 2 * unit, 7 * unit, r.randint(0, 60))), r.choice((1, -1, 0))
            b.fill(size, sign)
            while size:
                part = min(size, unit - filled)
                filled, net, size = filled + part, net + sign * part, size - part
                if filled == unit:
                    past, filled, net = [*past, abs(net)][-history:], 0, 0
            assert [x for c, x in b.runs for _ in range(c)] == past and (b.filled, b.net) == (filled, net)
            assert (b.vpin() is None) == (len(past) < history)


def test_a_trade_of_billions_of_buckets_is_one_step():
    b = Buckets(UNIT, 3)
    b.fill(9_000_000_000 * UNIT + UNIT // 2, 1)
    assert b.runs == [(3, UNIT)] and b.filled == UNIT // 2 and b.vpin() == UNIT
    b.fill(UNIT // 2, -1)
    assert b.runs == [(2, UNIT), (1, 0)] and b.vpin() == 66_666_667


def test_late_arrivals_may_be_told_by_their_number_alone():
    rows = [(engine.TRADE, t * 60 * 10**6, k, k, 0, UNIT, UNIT, 1) for k, t in enumerate((0, 5, 0, 1, 6, 2))]
    told = {}
    for each in (True, False):
        handle, told[each] = Handle(), []
        e = Engine(60 * 10**6, [0], "1", 1, 5, each)
        e.init(handle)
        e.take(iter(rows), told[each])
    late = {each: [r for r in out if r[0] == "late"] for each, out in told.items()}
    assert [r[5] for r in late[True]] == [2, 3, 5] and [r[4] for r in late[False]] == [3]
    assert [r for r in told[True] if r[0] == "feature"] == [r for r in told[False] if r[0] == "feature"]
