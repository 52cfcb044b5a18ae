"""Order books kept in step with their venue, as a stream: snapshots and deltas in order of arrival, one typed state an instrument.

A book has a value state (its state, the number expected next, how many deltas wait, what was applied) and two map states of the deltas that wait, by
blocks of BLOCK numbers: which wait, as bits, and the deltas themselves, as arrays, a piece for each batch that brought any. So a batch reads and writes
what it touches, however many wait, and asks the store once a block and not once a delta. `operators.book.sync_state` says the same of whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.operators.book import HELD, STATES
from tickloom.streaming.state import ROWS, framed, ordered, stateful

FIELDS = "order_id string, side string, price double, quantity double, action string, event_time timestamp"
#: What is told: applied deltas (in order of position) and, at the end of each batch that moved a book, its state.
OUT = f"instrument string, what string, position bigint, arrival bigint, seq bigint, {FIELDS}, state string, waiting bigint, last_seq bigint"
_COLS = [x.split()[0] for x in FIELDS.split(", ")]
AWAITING, SYNCHRONIZED, DESYNCED = STATES
#: Numbers (a multiple of 8) whose deltas wait in one place of the state: what is read at once when they are applied.
BLOCK = 4096
#: Of a piece: the numbers, and the deltas' fields; times are microseconds.
PIECE = "seq array<bigint>, order_id array<string>, side array<string>, price array<double>, quantity array<double>, action array<string>, us array<bigint>"


def _arrivals(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for d in ordered(frames, ["arrival", "is_delta"]):
        us = d["event_time"].astype("datetime64[us]").astype("int64").astype(object).where(d["event_time"].notna(), None)
        yield from zip(*(d[c].tolist() for c in ("arrival", "is_delta", "seq", *_COLS[:-1])), us.tolist(), strict=True)


class Waiting:
    """A book's deltas that wait, by number: those of earlier batches in the state, those of this batch here until it ends."""

    def __init__(self, book: Book, count: int):
        self.marks, self.early, self.old = book.marks, book.early, count
        self.new: dict[int, tuple] = {}
        self.known: dict[int, tuple[bytes, int]] = {}  # bits and pieces of blocks looked up in this batch

    def __len__(self) -> int:
        return len(self.new) + self.old

    def _of(self, block: int) -> tuple[bytes, int]:
        if block not in self.known:
            kept = self.marks.getValue((block,)) if self.old else None
            self.known[block] = (b"", 0) if kept is None else (bytes(kept[0]), kept[1])
        return self.known[block]

    def add(self, seq: int, fields: tuple) -> None:
        """Each number once: the first to come is kept."""
        if seq not in self.new:
            block, at = divmod(seq, BLOCK)
            bits = self._of(block)[0]
            if not (bits and bits[at >> 3] >> (at & 7) & 1):
                self.new[seq] = fields

    def pop(self, seq: int) -> tuple | None:
        """The delta of a number, if it waits. With it those of its block come out of the state; what is left of them goes back once the batch ends."""
        if self.old and seq not in self.new:
            block = seq // BLOCK
            pieces = self._of(block)[1]
            for k in range(pieces):
                seqs, *columns = self.early.getValue((block, k))
                self.early.removeKey((block, k))
                self.new.update(zip(seqs, zip(*columns, strict=True), strict=True))
                self.old -= len(seqs)
            if pieces:
                self.marks.removeKey((block,))
                self.known[block] = (b"", 0)
        return self.new.pop(seq, None)

    def clear(self) -> None:
        self.new.clear()
        self.known.clear()
        if self.old:
            self.marks.clear()
            self.early.clear()
            self.old = 0

    def write(self) -> None:
        blocks: dict[int, list[int]] = {}
        for seq in self.new:
            blocks.setdefault(seq // BLOCK, []).append(seq)
        for block, seqs in blocks.items():
            bits, pieces = self._of(block)
            bits = bytearray(bits or BLOCK // 8)
            for at in (seq % BLOCK for seq in seqs):
                bits[at >> 3] |= 1 << (at & 7)
            self.early.updateValue((block, pieces), (seqs, *(list(c) for c in zip(*(self.new[seq] for seq in seqs), strict=True))))
            self.marks.updateValue((block,), (bits, pieces + 1))


class Book(StatefulProcessor):
    """What arrives early waits; what arrives late, again, or before a snapshot is dropped; more than `held` waiting desynchronise the book until its next snapshot."""

    def __init__(self, held: int = HELD):
        self.held = held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "state string, expected bigint, waiting bigint, position bigint")
        self.marks = handle.getMapState("marks", "block bigint", "bits binary, pieces int")
        self.early = handle.getMapState("early", "block bigint, piece int", PIECE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802  Spark's name
        state, expected, waiting, position = self.at.get() if self.at.exists() else (AWAITING, 0, 0, 0)
        early = Waiting(self, waiting)
        out, last = [], 0
        for arrival, is_delta, seq, *fields in _arrivals(rows):
            last = arrival
            if not is_delta:
                state, expected = SYNCHRONIZED, seq + 1
                early.clear()
            elif state == AWAITING or seq < expected:
                continue
            elif seq > expected:
                early.add(seq, tuple(fields))
                if len(early) > self.held:
                    state = DESYNCED
            else:
                while fields is not None:
                    out.append((key[0], "applied", position, arrival, expected, *fields, None, None, None))
                    position, expected = position + 1, expected + 1
                    if len(out) >= ROWS:
                        yield framed(OUT, out)
                        out.clear()
                    fields = early.pop(expected) if len(early) else None
        early.write()
        self.at.update((state, expected, len(early), position))
        known = None if state == AWAITING else expected - 1
        out.append((key[0], "state", position, last, None, *[None] * len(_COLS), state, len(early), known))
        yield framed(OUT, out)

    def close(self) -> None:
        pass


def synced(deltas: DataFrame, snapshots: DataFrame, held: int = HELD) -> DataFrame:
    """Streams of deltas (instrument, arrival, seq, ...) and snapshots (instrument, arrival, snapshot_seq) -> applied deltas and states; append mode."""
    none = [F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in FIELDS.split(", ")]
    snap = snapshots.select("instrument", "arrival", F.col("snapshot_seq").alias("seq"), *none, F.lit(False).alias("is_delta"))
    both = deltas.select("instrument", "arrival", "seq", *_COLS, F.lit(True).alias("is_delta")).unionByName(snap)
    return stateful(both.groupBy("instrument"), Book(held), OUT)


def states(told: DataFrame) -> DataFrame:
    """Each book's last state from what `synced` told: instrument, state, waiting, applied, last_seq."""
    last = F.max_by(F.struct("state", "waiting", F.col("position").alias("applied"), "last_seq"), F.struct("arrival", "position"))
    return told.where("what = 'state'").groupBy("instrument").agg(last.alias("r")).select("instrument", "r.*")
