"""Counters of running streams: what their observed columns told, batch by batch, and how far behind they are."""

from __future__ import annotations

import threading
from collections import defaultdict
from datetime import UTC, datetime

from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Counters(StreamingQueryListener):
    """Totals by query and observed name, each batch once although its progress may be told twice.

    Names that begin with last_ keep the greatest value, others are summed. `lag` is the time between a batch's last event and its trigger, in seconds.
    """

    def __init__(self) -> None:
        self.totals: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        self.last: dict[str, dict[str, object]] = defaultdict(dict)
        self.lag: dict[str, float] = {}
        self.ended: dict[str, str | None] = {}
        self.batches: dict[str, set[int]] = defaultdict(set)
        self._told = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        name, query = p.name or str(p.id), str(p.id)
        with self._told:
            if p.batchId in self.batches[query]:
                return
            self.batches[query].add(p.batchId)
            for row in (p.observedMetrics or {}).values():
                for k, v in row.asDict().items():
                    if k.startswith("last_"):
                        self.last[name][k] = max(v, self.last[name].get(k, v)) if v is not None else self.last[name].get(k)
                    else:
                        self.totals[name][k] += v or 0
            if isinstance(at := self.last[name].get("last_time"), datetime):
                began = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
                self.lag[name] = (began - at.replace(tzinfo=at.tzinfo or UTC)).total_seconds()
            self._told.notify_all()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._told:
            self.ended[str(event.runId)] = event.exception
            self._told.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 30) -> None:
        """Until the end of the query's run has been told; events come after it, on a thread of their own."""
        with self._told:
            self._told.wait_for(lambda: str(query.runId) in self.ended, seconds)
