"""Books in step by order of arrival: tables and streams against a plain replay."""

import random

import pandas as pd

from tickloom.operators import book
from tickloom.streaming import sync

DELTA = "instrument string, arrival bigint, seq bigint, order_id string, side string, price double, quantity double, action string, event_time timestamp"
SNAP = "instrument string, arrival bigint, snapshot_seq bigint"


def made(seed, books=7, numbers=120):
    """Deltas late, early, twice and missing, with up to three snapshots a book; some books have none."""
    r, deltas, snaps = random.Random(seed), [], []
    for b in range(books):
        at = {}
        for seq in range(numbers):
            if r.random() < 0.02:
                continue
            for _ in range(1 + (r.random() < 0.1)):
                at[seq * 10 + r.randint(0, (10, 60, 900)[b % 3])] = seq
        deltas += [(f"B{b}", a * 10 + 1, s) for a, s in at.items()]
        snaps += [(f"B{b}", r.randint(0, numbers * 80), r.randint(0, numbers)) for _ in range(b % 4)]
    return [(i, a, s, f"o{s % 5}", "BUY", 1.0, float(s), "ADD", None) for i, a, s in deltas], list(dict(((s[0], s[1]), s) for s in snaps).values())


def replayed(deltas, snaps, held):
    """instrument -> (state, waiting, applied numbers in order, last number)."""
    books = {}
    for i, _, kind, seq in sorted([(d[0], d[1], 1, d[2]) for d in deltas] + [(s[0], s[1], 0, s[2]) for s in snaps], key=lambda x: x[1:]):
        b = books.setdefault(i, {"state": "AWAITING_SNAPSHOT", "next": None, "wait": set(), "done": []})
        if kind == 0:
            b.update(state="SYNCHRONIZED", next=seq + 1, wait=set())
        elif b["next"] is None or seq < b["next"]:
            continue
        elif seq > b["next"]:
            b["wait"].add(seq)
            if len(b["wait"]) > held:
                b["state"] = "DESYNCED"
        else:
            b["wait"].add(seq)
            while b["next"] in b["wait"]:
                b["wait"].remove(b["next"])
                b["done"].append(b["next"])
                b["next"] += 1
    return {i: (b["state"], len(b["wait"]), b["done"], None if b["next"] is None else b["next"] - 1) for i, b in books.items()}


def test_the_state_is_that_of_the_arrivals(spark):
    """5, 3, 1, 2 with one that may wait: 5 and 3 overflow it, and it stays so although 1 to 3 are applied."""
    d = [("X", k, seq, "o", "BUY", 1.0, 1.0, "ADD", None) for k, seq in enumerate((5, 3, 1, 2), 1)]
    got = book.sync_state(spark.createDataFrame(d, DELTA), spark.createDataFrame([("X", 0, 0)], SNAP), ["instrument"], held=1).collect()
    assert list(map(tuple, got)) == [("X", "DESYNCED", 1, 3, 3)]


def test_tables_equal_a_replay(spark, monkeypatch):
    states = set()
    for seed, stretch in ((1, 1_000_000), (2, 50), (3, 7)):
        monkeypatch.setattr(book, "STRETCH", stretch)
        deltas, snaps = made(seed)
        d, s = spark.createDataFrame(deltas, DELTA).repartition(3), spark.createDataFrame(snaps, SNAP)
        want = replayed(deltas, snaps, 12)
        got = {r.instrument: (r.state, r.waiting, r.applied, r.last_seq) for r in book.sync_state(d, s, ["instrument"], 12).collect()}
        assert got == {i: (a, w, len(x), n) for i, (a, w, x, n) in want.items()}
        applied = {}
        for r in sorted(book.synced(d, s, ["instrument"]).collect(), key=lambda r: (r.applied_at, r.seq)):
            applied.setdefault(r.instrument, []).append(r.seq)
        assert applied == {i: x for i, (_, _, x, _) in want.items() if x}
        states |= {x[0] for x in want.values()}
    assert states == {"AWAITING_SNAPSHOT", "SYNCHRONIZED", "DESYNCED"}


def test_the_stream_equals_a_replay_over_restarts(spark, tmp_path):
    deltas, snaps = made(5)
    times = sorted(x[1] for x in deltas)
    cuts = [-1, *(times[len(times) * k // 4] for k in (1, 2, 3)), 10**9]
    for a, z in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([x for x in deltas if a < x[1] <= z], DELTA).write.mode("append").parquet(str(tmp_path / "d"))
        spark.createDataFrame([x for x in snaps if a < x[1] <= z], SNAP).write.mode("append").parquet(str(tmp_path / "s"))
        told = sync.synced(spark.readStream.schema(DELTA).parquet(str(tmp_path / "d")), spark.readStream.schema(SNAP).parquet(str(tmp_path / "s")), held=12)
        w = told.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        w.trigger(availableNow=True).start().awaitTermination()
    out = spark.read.schema(sync.OUT).parquet(str(tmp_path / "out"))
    want = replayed(deltas, snaps, 12)
    got = {r.instrument: (r.state, r.waiting, r.applied, r.last_seq) for r in sync.states(out).collect()}
    assert got == {i: (a, w, len(x), n) for i, (a, w, x, n) in want.items()}
    applied = {}
    for r in sorted(out.where("what = 'applied'").collect(), key=lambda r: r.position):
        assert r.quantity == r.seq and r.order_id == f"o{r.seq % 5}"
        applied.setdefault(r.instrument, []).append(r.seq)
    assert applied == {i: x for i, (_, _, x, _) in want.items() if x}


class Kept:
    """A value or map state that counts what it is asked."""

    def __init__(self):
        self.value, self.rows, self.asked = None, {}, 0

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):  # noqa: N802
        self.asked += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.asked += 1
        return self.rows.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.asked += 1
        self.rows[key] = value

    def removeKey(self, key):  # noqa: N802
        self.asked += 1
        del self.rows[key]

    def clear(self):
        self.asked += 1
        self.rows.clear()


class Handle:
    def __init__(self):
        self.states = {}

    def getValueState(self, name, schema):  # noqa: N802
        return self.states.setdefault(name, Kept())

    getMapState = lambda self, name, key, value: self.getValueState(name, value)  # noqa: E731, N815

    def asked(self):
        return sum(k.asked for k in self.states.values())


TIME = pd.Timestamp("2024-01-01 00:00:00.000001")


def batch(book_, deltas, snaps=()):
    """What a book tells of a batch of (arrival, number): rows of OUT as tuples."""
    rows = [(a, True, s, "o", "BUY", 1.0, float(s), "ADD", TIME if s % 2 else None) for a, s in deltas] + [(a, False, s, *[None] * 6) for a, s in snaps]
    frame = pd.DataFrame(rows, columns=["arrival", "is_delta", "seq", "order_id", "side", "price", "quantity", "action", "event_time"]).astype({"event_time": "datetime64[us]"})
    return [f for f in book_.handleInputRows(("X",), iter([frame]), None)]


def test_waiting_deltas_are_asked_for_by_blocks():
    """A number that comes last lets all after it wait: the state is asked once a block, and what is told goes in frames of bounded size."""
    handle = Handle()
    b = sync.Book(held=12)
    b.init(handle)
    batch(b, [(k, k) for k in range(11, 20_000)] + [(30_000 + k, k) for k in range(11, 20_000)], [(0, 9)])
    batch(b, [(60_000 + k, k) for k in range(15_000, 40_000)])
    frames = batch(b, [(200_000, 10)])
    assert handle.asked() < 200
    assert max(map(len, frames)) <= 10_001
    told = pd.concat(frames)
    assert told[told["what"] == "applied"]["seq"].tolist() == list(range(10, 40_000))
    assert all((t == TIME) if s % 2 else pd.isna(t) for s, t in told[told["what"] == "applied"][["seq", "event_time"]].itertuples(index=False))
    assert told.iloc[-1][["state", "waiting", "last_seq"]].tolist() == ["DESYNCED", 0, 39_999]
    assert not handle.states["early"].rows


def test_blocks_of_any_size_equal_a_replay(monkeypatch):
    for size in (8, 64, 4096):
        monkeypatch.setattr(sync, "BLOCK", size, raising=False)
        for seed in range(4):
            deltas, snaps = made(seed)
            for i, (state, waiting, done, last) in replayed(deltas, snaps, 12).items():
                b = sync.Book(held=12)
                b.init(Handle())
                told, cuts = [], [-1, 150, 300, 301, 900, 10**9]
                for a, z in zip(cuts, cuts[1:], strict=False):
                    d, s = ([x[1:3] for x in rows if x[0] == i and a * 10 < x[1] <= z * 10] for rows in (deltas, snaps))
                    told += batch(b, d, s) if d or s else []
                told = pd.concat(told)
                assert told[told["what"] == "applied"]["seq"].tolist() == done
                assert told.iloc[-1][["state", "waiting", "last_seq"]].tolist() == [state, waiting, last]
