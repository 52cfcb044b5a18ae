"""What a batch of the registered streams takes does not grow with the input."""

import os
import time

import pytest
from pyspark.sql.streaming import StreamingQueryListener

import __spark_entry__ as entry
from tickloom import queries

SF = "/root/testdata/sf0.001"


class Sizes(StreamingQueryListener):
    def __init__(self):
        self.rows, self.ended, self.mine = [], 0, set()

    def onQueryStarted(self, event):  # noqa: N802
        self.mine.add(str(event.runId))  # of earlier queries something may still be told

    def onQueryProgress(self, event):  # noqa: N802
        if str(event.progress.runId) in self.mine:
            self.rows.append(event.progress.numInputRows)

    def onQueryIdle(self, event):  # noqa: N802
        pass

    def onQueryTerminated(self, event):  # noqa: N802
        self.ended += str(event.runId) in self.mine


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name, runs", [("exact_stream", 4), ("engine_state", 4), ("sync_stream", 5), ("live_features", 10)])
def test_streams_take_bounded_batches(spark, monkeypatch, name, runs):
    rows = lambda: sorted(map(str, entry.queries()[name](spark, SF).collect()))
    whole, sizes = rows(), Sizes()
    monkeypatch.setattr(queries, "BATCH", 250)
    spark.streams.addListener(sizes)
    try:
        assert rows() == whole
        until = time.time() + 30
        while sizes.ended < runs and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(sizes)
    assert sizes.ended == runs and 1000 <= sum(sizes.rows) and max(sizes.rows) <= 250 * 1.2 + 8


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_live_engine_runs_on_from_part_to_part(spark, monkeypatch):
    rows = lambda: sorted(map(str, entry.queries()["live_features"](spark, SF).collect()))
    whole, sizes = rows(), Sizes()
    monkeypatch.setattr(queries, "BATCH", 250)
    monkeypatch.setattr(queries, "STARTS", 2, raising=False)
    spark.streams.addListener(sizes)
    try:
        assert rows() == whole
        until = time.time() + 30
        while sizes.ended < 7 and time.time() < until:
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(sizes)
    # Five parts: the recorder is started for each, the engine twice; no batch takes two parts.
    assert sizes.ended == 7 and len(sizes.rows) >= 10 and max(sizes.rows) <= 250 * 1.2 + 8
