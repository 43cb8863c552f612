"""What a stream reports: progress and errors through narrow logging and counting contracts."""

from __future__ import annotations

import logging
from typing import Protocol

from pyspark.sql.streaming import StreamingQueryListener


class Metrics(Protocol):
    def count(self, name: str, value: int = 1) -> None: ...

    def gauge(self, name: str, value: float) -> None: ...


class Counters:
    """Metrics kept in memory."""

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.gauges: dict[str, float] = {}

    def count(self, name: str, value: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + value

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value


class Reporter(StreamingQueryListener):
    """Counts rows and batches, keeps the last rate, logs starts and ends. Add it with spark.streams.addListener."""

    def __init__(self, metrics: Metrics, log: logging.Logger | None = None):
        self.metrics, self.log = metrics, log or logging.getLogger("tideline.streaming")

    def onQueryStarted(self, event) -> None:
        self.metrics.count("stream.started")
        self.log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.metrics.count("stream.batches")
        self.metrics.count("stream.rows", int(p.numInputRows))
        self.metrics.gauge("stream.rows_per_second", float(p.processedRowsPerSecond or 0.0))

    def onQueryIdle(self, event) -> None:
        self.metrics.count("stream.idle")

    def onQueryTerminated(self, event) -> None:
        self.metrics.count("stream.failed" if event.exception else "stream.ended")
        self.log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")
