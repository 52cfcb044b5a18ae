"""The exact stream engine: all four features, every arrival moving its partition's clock, on typed state.

An instrument's state lies in column families, so that a batch reads and writes what it touches, however many rows are open:

- clock: each partition's latest time, whether an end came, the last window told, the least open one;
- buckets: the volume bucket being filled, and the last full ones as runs of equal imbalances (at most `history` of them);
- windows: per open window its sums and its last book;
- trades: per open window and batch the trades that it brought, as arrays. Volume buckets need a window's trades in order of time, once it closes.

Prices and sizes are integers of 1e-8 throughout, so sums are exact and values are divided half-even once.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.exact import ratio8
from tickloom.streaming.state import ROWS, framed, ordered, stateful

UNIT = 10**8
FEATURE = "instrument string, feature_name string, window_start timestamp, window_end timestamp, value decimal(28,8), input_count bigint"
LATE = "instrument string, window_start timestamp, event_id bigint, event_time timestamp, seq bigint"
#: What the engine tells: features of closed windows, and arrivals that came too late for theirs.
#: A window's sums stand beside its price, and a late trade's beside it, so that both add up to a revised window.
SUMS = "pv decimal(38,0), v decimal(38,0), p decimal(38,0)"
TOLD = f"what string, {FEATURE}, event_id bigint, event_time timestamp, seq bigint, {SUMS}"
#: Of the clock: the version of the state's layout and of the features' rules. A checkpoint of another is refused.
VERSION = "engine-1"
_LEVELS = ("bid_p", "bid_q", "ask_p", "ask_q")
#: An arrival. Its kind: an end (which has no time), a trade, or a book. No number is null, so none passes through a float on its way. Only books have levels; without any, arrivals come without those columns.
_ROW = ("kind", "us", "event_id", "seq", "partition", "p", "q", "sign", *_LEVELS)
END, TRADE, BOOK = range(3)
NONE = (None, None, None)


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def half_even(num: int, den: int) -> int:
    q, rest = divmod(num, den)
    return q + (2 * rest > den or (2 * rest == den and q % 2 == 1))


class Buckets:
    """Volume buckets of an instrument: the one being filled, and the last `history` full ones as runs (how many, imbalance of each)."""

    def __init__(self, unit: int, history: int, filled: int = 0, net: int = 0, runs: list[tuple[int, int]] = ()):
        self.unit, self.history, self.filled, self.net, self.runs = unit, history, filled, net, list(runs)

    def _full(self, count: int, imbalance: int) -> None:
        if not count:
            return
        if self.runs and self.runs[-1][1] == imbalance:
            count += self.runs.pop()[0]
        self.runs.append((min(count, self.history), imbalance))
        over = sum(c for c, _ in self.runs) - self.history
        while over > 0:
            c, imbalance = self.runs[0]
            gone = min(c, over)
            self.runs[0:1] = [(c - gone, imbalance)] if c > gone else []
            over -= gone

    def fill(self, size: int, sign: int) -> None:
        """A trade: what completes the bucket at hand, a run of whole ones, and the rest."""
        part = min(size, self.unit - self.filled)
        self.filled, self.net = self.filled + part, self.net + sign * part
        if self.filled == self.unit:
            self._full(1, abs(self.net))
            whole, self.filled = divmod(size - part, self.unit)
            self._full(whole, self.unit * abs(sign))
            self.net = sign * self.filled

    def vpin(self) -> int | None:
        if sum(c for c, _ in self.runs) < self.history:
            return None
        return half_even(sum(c * x for c, x in self.runs) * UNIT, self.history * self.unit)


class Window:
    """Sums and last book of an open window, and the trades that this batch brought."""

    FIELDS = "n bigint, pv decimal(38,0), v decimal(38,0), p decimal(38,0), pieces int, book_us bigint, book_id bigint, bid_p array<bigint>, bid_q array<bigint>, ask_p array<bigint>, ask_q array<bigint>"

    def __init__(self, kept: tuple | None = None):
        self.n, pv, v, p, self.pieces, self.book_us, self.book_id, *self.book = kept or (0, 0, 0, 0, 0, None, None, [], [], [], [])
        self.pv, self.v, self.p = int(pv), int(v), int(p)
        self.new: list[tuple[int, int, int, int]] = []

    def kept(self) -> tuple:
        return (self.n, Decimal(self.pv), Decimal(self.v), Decimal(self.p), self.pieces, self.book_us, self.book_id, *self.book)

    def trade(self, us: int, event_id: int, p: int, q: int, sign: int) -> None:
        self.n, self.pv, self.v, self.p = self.n + 1, self.pv + p * q, self.v + q, self.p + p
        self.new.append((us, event_id, q, sign))

    def snapshot(self, us: int, event_id: int, levels: list[list[int]]) -> None:
        if self.book_us is None or (us, event_id) > (self.book_us, self.book_id):
            self.book_us, self.book_id, self.book = us, event_id, levels

    def values(self, levels: int) -> Iterator[tuple[str, int, int]]:
        """(feature, value, inputs), all but vpin."""
        if self.n:
            yield ("vwap.1m", half_even(self.pv, self.v) if self.v else half_even(self.p, self.n), self.n)
        if self.book_us is not None:
            bp, bs, ap, asks = self.book
            bid, ask = sum(bs[:levels]), sum(asks[:levels])
            yield ("obi", half_even((bid - ask) * UNIT, bid + ask) if bid + ask else 0, 1)
            if bp and ap:
                bv, av = bs[0], asks[0]
                yield ("micro_price", half_even(bp[0] * av + ap[0] * bv, bv + av) if bv + av else half_even(bp[0] + ap[0], 2), 1)


class Engine(StatefulProcessor):
    """The processor of one instrument's arrivals. What comes late is told row by row, or as one row a batch that says how many (`each_late` False)."""

    def __init__(self, size: int, partitions: list[int], bucket: str, history: int, levels: int, each_late: bool = True):
        self.each_late = each_late
        self.size, self.partitions, self.unit, self.history, self.levels = size, partitions, int(Decimal(bucket) * UNIT), history, levels
        if self.unit <= 0 or history <= 0 or levels <= 0:
            raise ValueError("bucket, history and levels must be positive")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.clock = handle.getValueState("clock", "version string, tops array<bigint>, ended boolean, done bigint, first bigint")
        self.buckets = handle.getValueState("buckets", "filled bigint, net bigint, counts array<bigint>, imbalances array<bigint>")
        self.windows = handle.getMapState("windows", "start bigint", Window.FIELDS)
        self.trades = handle.getMapState("trades", "start bigint, piece int", "us array<bigint>, event_id array<bigint>, q array<bigint>, sign array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        out = []
        self.take((r for d in ordered(rows, ["seq"]) for r in zip(*(d[c].tolist() for c in _ROW if c in d), strict=True)), out)
        end = lambda start: None if start is None else start + self.size
        for lo in range(0, len(out), ROWS):
            told = [(what, key[0], name, start, end(start), None if v is None else Decimal(v).scaleb(-8), n, event_id, us, seq, *(None if x is None else Decimal(x) for x in sums)) for what, name, start, v, n, event_id, us, seq, sums in out[lo : lo + ROWS]]
            yield framed(TOLD, told)

    def take(self, rows: Iterator[tuple], out: list[tuple]) -> None:
        """Arrivals (_ROW) in order; what is told is added to out as (what, feature, window, value, inputs, event_id, us, seq, sums)."""
        version, tops, ended, done, first = self.clock.get() if self.clock.exists() else (VERSION, [None] * len(self.partitions), False, None, None)
        if version != VERSION:
            raise ValueError(f"state of {version}, not {VERSION}")
        tops, place = list(tops), {p: k for k, p in enumerate(self.partitions)}
        held: dict[int, Window] = {}
        buckets, missed = None, 0
        for kind, us, event_id, seq, part, p, q, sign, *levels in rows:
            if kind == END:
                ended = True
            elif part in place:
                tops[place[part]] = us if tops[place[part]] is None else max(us, tops[place[part]])
            # The partition set is known up front; one without data yet is not counted.
            seen = [t for t in tops if t is not None]
            mark = min(seen, default=us)
            if kind != END:
                start = us // self.size * self.size
                # Only a partition that begins after an end can meet a window told already.
                if start + self.size <= mark or (done is not None and start <= done):
                    missed += 1
                    if self.each_late:
                        out.append(("late", None, start, None, 1, event_id, us, seq, (p * q, q, p) if kind == TRADE else NONE))
                    continue
                w = held[start] if start in held else held.setdefault(start, Window(self._kept(start, first)))
                first = start if first is None else min(first, start)
                if kind == TRADE:
                    w.trade(us, event_id, p, q, sign)
                else:
                    w.snapshot(us, event_id, [list(map(int, x)) for x in levels])
            if first is not None and seen and first + self.size <= mark and (ended or len(seen) == len(tops)):
                buckets = buckets or Buckets(self.unit, self.history, *self._filled())
                # Of the windows that are open, those not in this batch are looked up only here.
                open_ = sorted({k[0] for k in self.windows.keys()} | set(held))
                for start in [s for s in open_ if s + self.size <= mark]:
                    self._close(start, held.pop(start, None) or Window(self.windows.getValue((start,))), buckets, out)
                    done = start
                first = next((s for s in open_ if s + self.size > mark), None)
        if missed and not self.each_late:
            out.append(("late", None, None, None, missed, None, None, None, NONE))
        for start, w in held.items():
            if w.new:
                us, ids, q, sign = (list(x) for x in zip(*w.new, strict=True))
                self.trades.updateValue((start, w.pieces), (us, ids, q, sign))
                w.pieces += 1
            self.windows.updateValue((start,), w.kept())
        self.clock.update((VERSION, tops, ended, done, first))
        if buckets is not None:
            self.buckets.update((buckets.filled, buckets.net, [c for c, _ in buckets.runs], [x for _, x in buckets.runs]))

    def _kept(self, start: int, first: int | None) -> tuple | None:
        if first is None or start < first:
            return None
        kept = self.windows.getValue((start,))
        return None if kept is None else tuple(kept)

    def _filled(self) -> tuple:
        if not self.buckets.exists():
            return ()
        filled, net, counts, imbalances = self.buckets.get()
        return filled, net, list(zip(counts, imbalances, strict=True))

    def _close(self, start: int, w: Window, buckets: Buckets, out: list[tuple]) -> None:
        rows = w.new
        for k in range(w.pieces):
            rows = rows + list(zip(*self.trades.getValue((start, k)), strict=True))
            self.trades.removeKey((start, k))
        self.windows.removeKey((start,))
        for _, _, q, sign in sorted(rows):
            buckets.fill(q, sign)
        told = list(w.values(self.levels))
        if rows and (v := buckets.vpin()) is not None:
            told.insert(1, ("vpin", v, len(rows)))
        sums = (w.pv, w.v, w.p)
        out += [("feature", name, start, v, n, None, None, None, sums if name == "vwap.1m" else NONE) for name, v, n in told]

    def close(self) -> None:
        pass


def ended(trades: DataFrame) -> DataFrame:
    """A row for each instrument of trades that tells `ExactEngine`, last in arrival order, that partitions without data so far will have none."""
    of = {"instrument": F.col("instrument"), "partition": F.lit(-1), "event_id": F.lit(-1), "seq": F.lit(2**63 - 1)}
    return trades.select("instrument").distinct().select(*[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in trades.schema])


class ExactEngine:
    """All four features by the exact rules, from streams of trades (TICK columns; rows without event_time are ends) and books (instrument, event_id, event_time, partition, seq, bids, asks).

    A partition without data yet is not counted for what is late, so its first arrival may take the watermark back. No window closes before: each is told
    once, with all it accepted, when every partition has had data or an end (see `ended`) says that the others have none. Until then windows wait in the state.
    """

    def __init__(self, size_seconds: int, partitions: list[int], bucket: str = "1", history: int = 1, levels: int = 5):
        self.levels = levels
        self.rules = (size_seconds * 1_000_000, list(partitions), bucket, history, levels)
        Engine(*self.rules)

    def told(self, trades: DataFrame, books: DataFrame | None = None, each_late: bool = True) -> DataFrame:
        """Features and late arrivals, as TOLD (not `each_late`: one row a batch of an instrument, with their number as input_count). Counted in passing: `engine_in` (received) and `engine_out` (features, late)."""
        unit = lambda c: f"cast({c} * {UNIT} as bigint)"
        zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("bigint").alias(name)
        key = ["instrument", zero("event_id", "event_id"), zero(F.unix_micros("event_time"), "us"), zero("partition", "partition"), zero("seq", "seq")]
        kind = lambda k: F.when(F.col("event_time").isNull(), END).otherwise(k).alias("kind")
        none = F.array().cast("array<bigint>")
        sign = F.when(F.col("side") == "BUY", 1).when(F.col("side") == "SELL", -1).otherwise(0)
        both = trades.select(*key, kind(TRADE), zero(F.expr(unit("price")), "p"), zero(F.expr(unit("size")), "q"), sign.alias("sign"))
        if books is not None:
            side = lambda c, f: F.coalesce(F.expr(f"transform(slice({c}, 1, {self.levels}), x -> {unit('x.' + f)})"), none)
            levels = [side(c, f).alias(a) for a, (c, f) in zip(_LEVELS, (("bids", "price"), ("bids", "size"), ("asks", "price"), ("asks", "size")), strict=True)]
            both = both.select("*", *[F.lit(None).cast("array<bigint>").alias(c) for c in _LEVELS]).unionByName(books.select(*key, kind(BOOK), *[F.lit(0).cast("bigint").alias(c) for c in ("p", "q")], F.lit(0).alias("sign"), *levels))
        both = both.observe("engine_in", F.count_if(F.col("kind") != END).alias("received"), F.timestamp_micros(F.max("us")).alias("last_time"))
        out = stateful(both.groupBy("instrument"), Engine(*self.rules, each_late), TOLD)
        return out.observe("engine_out", F.count_if(F.col("what") == "feature").alias("features"), F.coalesce(F.sum(F.when(F.col("what") == "late", F.col("input_count"))), F.lit(0)).alias("late"))

    def run(self, trades: DataFrame, books: DataFrame | None = None) -> DataFrame:
        """Closed features alone."""
        return features(self.told(trades, books, each_late=False))


def features(told: DataFrame) -> DataFrame:
    return told.where("what = 'feature'").select(*names(FEATURE))


def late(told: DataFrame) -> DataFrame:
    return told.where("what = 'late'").select(*names(LATE))


def revised(told: DataFrame) -> DataFrame:
    """Prices of told windows with the late trades in them: window, value, input_count and revision (how many came late, 0: none).

    Each late trade is a version of its window; versions add up, so it does not matter in which batch they came, nor whether their window had any trade in time.
    """
    g = told.where("(feature_name = 'vwap.1m' or what = 'late') and v is not null").groupBy("instrument", "window_start", "window_end")
    total = lambda c, kind: F.sum(c).cast(kind)
    d = g.agg(total("pv", "decimal(38,0)").alias("pv"), total("v", "decimal(38,0)").alias("v"), total("p", "decimal(38,0)").alias("p"), F.sum("input_count").alias("n"), F.count_if(F.col("what") == "late").alias("revision"))
    scaled = lambda c, kind, by: (F.col(c).cast(kind) * F.lit(by).cast("decimal(8,8)"))
    v, p = scaled("v", "decimal(28,0)", "0.00000001").cast("decimal(28,8)"), scaled("p", "decimal(28,0)", "0.00000001").cast("decimal(38,16)")
    pv = (scaled("pv", "decimal(30,0)", "0.00000001").cast("decimal(38,8)") * F.lit("0.00000001").cast("decimal(8,8)")).cast("decimal(38,16)")
    value = F.when(v == 0, ratio8(p, F.col("n").cast("decimal(20,8)"))).otherwise(ratio8(pv, F.when(v != 0, v)))
    return d.select("instrument", "window_start", "window_end", value.alias("value"), F.col("n").alias("input_count"), "revision")
