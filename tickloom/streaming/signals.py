"""Signals judged as a stream: each waits in state until the first event past its horizon says what the price has become.

Events of an instrument come in order (within a batch they are put in it), so signals are due in the order in which they came: they wait in a queue whose head
alone is looked at. Beside it stand the last price and the moments of (signal, return), which are merged batch by batch into the correlation.
`operators.signals` says the same of whole tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.streaming.state import framed, stateful

RETURN = "instrument string, event_time timestamp, seq bigint, signal double, entry double, exit double, exit_time timestamp, forward_return double"
#: What is told: returns, and after each batch the correlation so far (ic, null without two of each or without variance) and over how many.
OUT = f"what string, {RETURN}, ic double, n bigint"
#: Signals that wait, in pieces of so many: one entry of the state each.
PIECE = 64


class Moments:
    """Count, means and centred second moments of pairs. Merging is associative, and exact but for rounding."""

    def __init__(self, n: int = 0, x: float = 0.0, y: float = 0.0, xx: float = 0.0, yy: float = 0.0, xy: float = 0.0):
        self.n, self.x, self.y, self.xx, self.yy, self.xy = n, x, y, xx, yy, xy

    def merge(self, o: Moments) -> Moments:
        n = self.n + o.n
        if not n:
            return self
        dx, dy, w = o.x - self.x, o.y - self.y, self.n * o.n / n
        return Moments(n, self.x + dx * o.n / n, self.y + dy * o.n / n, self.xx + o.xx + dx * dx * w, self.yy + o.yy + dy * dy * w, self.xy + o.xy + dx * dy * w)

    def told(self) -> float | None:
        return self.xy / math.sqrt(self.xx * self.yy) if self.n >= 2 and self.xx > 0 and self.yy > 0 else None

    def kept(self) -> tuple:
        return (self.n, self.x, self.y, self.xx, self.yy, self.xy)


class Signals(StatefulProcessor):
    def __init__(self, horizon: int):
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "price double, head bigint, tail bigint")
        self.moments = handle.getValueState("moments", "n bigint, x double, y double, xx double, yy double, xy double")
        self.waiting = handle.getMapState("waiting", "piece bigint", "us array<bigint>, seq array<bigint>, signal array<double>, entry array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        d = pd.concat(list(rows)).sort_values(["us", "seq"], kind="stable")
        given = (x.where(x.notna(), None).tolist() for x in (d["price"].astype(object), d["signal"].astype(object)))
        out, at = [], lambda us: pd.Timestamp(us, unit="us")
        for us, seq, signal, entry, exit_, when in self.take(zip(d["us"].tolist(), d["seq"].tolist(), *given, strict=True)):
            out.append(("return", key[0], at(us), seq, signal, entry, exit_, at(when), (exit_ - entry) / entry if entry else None, None, None))
        m = Moments(*self.moments.get()) if self.moments.exists() else Moments()
        for r in out:
            if r[8] is not None and not math.isnan(r[8]) and not math.isnan(r[4]):
                m = m.merge(Moments(1, r[4], r[8]))
        if out:
            self.moments.update(m.kept())
            out.append(("ic", key[0], at(int(d["us"].iloc[-1])), int(d["seq"].iloc[-1]), *[None] * 5, m.told(), m.n))
        yield framed(OUT, out)

    def take(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Events (us, seq, price or null, signal or null) in order -> (us, seq, signal, entry, exit, time of exit) as signals fall due."""
        price, head, tail = self.at.get() if self.at.exists() else (None, 0, 0)
        # The queue: entries head to tail - 1, in pieces; those of this batch are kept back until it ends.
        first, held, done, new = head // PIECE, None, set(), {}

        def entry(k: int) -> tuple:
            nonlocal first, held
            if k // PIECE in new:
                return new[k // PIECE][k % PIECE]
            if held is None or first != k // PIECE:
                first, held = k // PIECE, list(zip(*self.waiting.getValue((k // PIECE,)), strict=True))
            return held[k % PIECE]

        due = entry(head)[0] + self.horizon if head < tail else None
        for us, seq, p, signal in rows:
            price = price if p is None else float(p)
            while due is not None and due <= us:
                yield (*entry(head), price, us)
                head += 1
                if head % PIECE == 0:
                    done.add(head // PIECE - 1)
                due = entry(head)[0] + self.horizon if head < tail else None
            if signal is not None and price is not None:
                if tail // PIECE not in new:
                    kept = self.waiting.getValue((tail // PIECE,)) if tail % PIECE else None
                    new[tail // PIECE] = list(zip(*kept, strict=True)) if kept is not None else []
                new[tail // PIECE].append((us, seq, float(signal), price))
                tail += 1
                due = us + self.horizon if due is None else due
        for k in done:
            self.waiting.removeKey((k,))
        for k, entries in new.items():
            if k not in done:
                self.waiting.updateValue((k,), tuple(list(x) for x in zip(*entries, strict=True)))
        self.at.update((price, head, tail))

    def close(self) -> None:
        pass


def judged(events: DataFrame, signal: Column, horizon_seconds: int) -> DataFrame:
    """A stream of events (instrument, event_time, seq, price or null) in order of time over batches -> OUT, append mode."""
    d = events.select("instrument", F.unix_micros("event_time").alias("us"), "seq", F.col("price").cast("double").alias("price"), signal.cast("double").alias("signal"))
    return stateful(d.groupBy("instrument"), Signals(horizon_seconds * 1_000_000), OUT)


def returns(told: DataFrame) -> DataFrame:
    return told.where("what = 'return'").select(*[x.split()[0] for x in RETURN.split(", ")])


def correlation(told: DataFrame) -> DataFrame:
    """The last correlation of each instrument."""
    last = F.max_by(F.struct("ic", "n"), F.struct("event_time", "seq", "n"))
    return told.where("what = 'ic'").groupBy("instrument").agg(last.alias("r")).select("instrument", "r.*")
