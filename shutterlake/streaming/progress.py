"""Progress of streaming queries, told at a bounded rate."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls tell(event, query id, batch, rows): `progress` at most once per interval (seconds) and query; `started` and `ended` always."""

    def __init__(self, tell: Callable[[str, str, int, int], None], interval: float = 0.25, clock: Callable[[], float] = time.monotonic) -> None:
        self.tell, self.interval, self.clock = tell, interval, clock
        self.told: dict[str, float] = {}

    def step(self, query: str, batch: int, rows: int) -> None:
        now = self.clock()
        if now - self.told.get(query, float("-inf")) >= self.interval:
            self.told[query] = now
            self.tell("progress", query, batch, rows)

    def onQueryStarted(self, event) -> None:
        self.tell("started", str(event.id), -1, 0)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.step(str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.told.pop(str(event.id), None)
        self.tell("ended", str(event.id), -1, 0)
