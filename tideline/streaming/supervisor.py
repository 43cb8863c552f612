"""Running a stream for long: error classes, retry with backoff, graceful stop."""

from __future__ import annotations

import random
import re
import threading
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SQL states and words by which errors are told apart.
TRANSIENT_STATES = ["08"]
FATAL_STATES = ["42", "53", "58"]
TRANSIENT_WORDS = ["connection refused", "connection reset", "broken pipe", "timeout", "timed out", "temporarily unavailable", "network is unreachable", "unexpected eof", "server closed"]


class FatalError(RuntimeError):
    """An error that a retry can't mend."""


def sql_state(error: BaseException) -> str:
    state = getattr(error, "sqlstate", None) or getattr(error, "getSqlState", lambda: None)()
    if state:
        return state
    found = re.search(r"SQLSTATE:?\s*([0-9A-Z]{5})", str(error))
    return found[1] if found else ""


def classify(error: BaseException) -> str:
    """slot_missing, publication_missing, fatal, transient or unknown."""
    text, state = str(error).lower(), sql_state(error)
    if "does not exist" in text and "replication slot" in text:
        return "slot_missing"
    if "does not exist" in text and "publication" in text:
        return "publication_missing"
    if isinstance(error, FatalError) or state[:2] in FATAL_STATES:
        return "fatal"
    if state[:2] in TRANSIENT_STATES or any(w in text for w in TRANSIENT_WORDS) or isinstance(error, (ConnectionError, TimeoutError)):
        return "transient"
    return "unknown"


def should_retry(error: BaseException, reconcile: bool = False) -> bool:
    kind = classify(error)
    return kind == "transient" or kind == "unknown" or reconcile and kind in ("slot_missing", "publication_missing")


def retry_delay(attempt: int, first_s: float = 1.0, most_s: float = 30.0, jitter: Callable[[], float] = random.random) -> float:
    """first doubled each attempt from 0, at most most, plus up to half as much by chance."""
    base = min(most_s, first_s * 2 ** min(attempt, 30))
    return base + base * 0.5 * jitter()


def error_class(text: Column, state: Column) -> Column:
    """classify() over a table of errors: text and SQL state columns."""
    low = F.lower(text)
    words = F.lit(False)
    for word in TRANSIENT_WORDS:
        words = words | low.contains(word)
    missing = low.contains("does not exist")
    return (
        F.when(missing & low.contains("replication slot"), "slot_missing").when(missing & low.contains("publication"), "publication_missing")
        .when(F.substring(state, 1, 2).isin(FATAL_STATES), "fatal").when(F.substring(state, 1, 2).isin(TRANSIENT_STATES) | words, "transient").otherwise("unknown")
    )


class Heartbeat:
    """Tells the log's owner every `every_s` seconds, and whenever it asks, how far the stream has got.

    send(position) does the telling; a failure of it is counted and tried again at the next tick."""

    def __init__(self, send: Callable[[str], None], every_s: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.send, self.every_s, self.clock = send, every_s, clock
        self.last, self.sent, self.failed = None, 0, 0

    def tick(self, position: str, requested: bool = False) -> bool:
        """Whether the position was sent now."""
        now = self.clock()
        if not requested and self.last is not None and now - self.last < self.every_s:
            return False
        try:
            self.send(position)
        except OSError:
            self.failed += 1
            return False
        self.last = now
        self.sent += 1
        return True


class Supervisor:
    """Starts a stream again after transient errors; stop() ends it within a time."""

    def __init__(self, start: Callable[[], object], reconcile: bool = False, attempts: int = 10, sleep: Callable[[float], None] | None = None, on_event: Callable[[str, dict], None] | None = None):
        self.begin, self.reconcile, self.attempts = start, reconcile, attempts
        self.stopped = threading.Event()
        self.sleep = sleep or self.stopped.wait
        self.on_event = on_event or (lambda name, data: None)
        self.query = None

    def run(self) -> None:
        """Until the stream ends by itself, is stopped, or fails for good."""
        attempt = 0
        while not self.stopped.is_set():
            try:
                self.query = self.begin()
                self.on_event("started", {"attempt": attempt})
                self.query.awaitTermination()
                return
            except Exception as error:  # every kind is classified
                if self.stopped.is_set():
                    return
                if not should_retry(error, self.reconcile) or attempt + 1 >= self.attempts:
                    self.on_event("failed", {"kind": classify(error)})
                    raise
                delay = retry_delay(attempt)
                self.on_event("retry", {"kind": classify(error), "delay_s": delay})
                attempt += 1
                self.sleep(delay)

    def stop(self, timeout_s: float = 5.0) -> bool:
        """Whether the stream ended within the time."""
        self.stopped.set()
        query = self.query
        if query is None:
            return True
        query.stop()
        end = time.monotonic() + timeout_s
        while getattr(query, "isActive", False) and time.monotonic() < end:
            time.sleep(0.05)
        return not getattr(query, "isActive", False)
