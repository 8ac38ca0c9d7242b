"""Stateful operators on streams (transformWithState): the circuit breaker of each key, and the workers' beats.

State is held in variables of their own, on the executors' state stores, by key; what is told is a row for each change.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OPENED = "key string, opened_at long, reason string"
BEATS = "worker_id long, beat_at timestamp, live boolean, beats long"


class Breaker(StatefulProcessor):
    """Opens a key's circuit at a quota error, or at the n-th failure in a row, once. Two variables: the row of failures so far (number and
    last id), forgotten after a time without a call, and where the circuit opened."""

    def __init__(self, failures: int, forget_ms: int | None):
        self.failures, self.forget_ms = failures, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.row = handle.getValueState("row", "n int", ttlDurationMs=self.forget_ms)
        self.opened = handle.getValueState("opened", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = sorted((c for part in rows for c in zip(part["id"], part["outcome"])), key=lambda c: c[0])
        if self.opened.exists():
            return
        n = self.row.get()[0] if self.row.exists() else 0
        for at, outcome in calls:
            n = n + 1 if outcome == "failed" else 0
            if outcome == "quota" or n == self.failures:
                self.opened.update((int(at),))
                self.row.clear()
                yield pd.DataFrame({"key": [key[0]], "opened_at": [int(at)], "reason": ["quota" if outcome == "quota" else "failures"]})
                return
        self.row.update((n,))

    def close(self) -> None:
        pass


def breaker(calls: DataFrame, failures: int = 3, forget_ms: int | None = None) -> DataFrame:
    """key, opened_at, reason of calls (key, id, outcome): where the circuit of a key first opens. A stream brings a key's calls in the
    order of their ids, from batch to batch; within a batch they are put in order. A batch's calls of one key are sorted in its task: with
    a hot key, small triggers bound them."""
    return calls.groupBy("key").transformWithStateInPandas(Breaker(failures, forget_ms), OPENED, "update", "none" if forget_ms is None else "processingTime")


class Beats(StatefulProcessor):
    """The newest beat of a worker and how many came; a timer tells of silence. Two variables, and one timer a worker."""

    def __init__(self, live_ms: int):
        self.live_ms = live_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at timestamp")
        self.beats = handle.getValueState("beats", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest, n = (self.newest.get()[0], self.beats.get()[0]) if self.newest.exists() else (None, 0)
        newest = None if newest is None else pd.Timestamp(newest)
        for part in rows:
            at = part["beat_at"].max()
            newest, n = at if newest is None or at > newest else newest, n + len(part)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.newest.update((newest.to_pydatetime(),))
        self.beats.update((n,))
        self.handle.registerTimer(int(newest.timestamp() * 1000) + self.live_ms)
        yield pd.DataFrame({"worker_id": [key[0]], "beat_at": [newest], "live": [True], "beats": [n]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        newest, n = pd.Timestamp(self.newest.get()[0]), self.beats.get()[0]
        self.newest.clear()
        self.beats.clear()
        yield pd.DataFrame({"worker_id": [key[0]], "beat_at": [newest], "live": [False], "beats": [n]})

    def close(self) -> None:
        pass


def beats(rows: DataFrame, live_ms: int, late: str = "0 seconds") -> DataFrame:
    """worker_id, beat_at, live, beats of beats (worker_id, beat_at): the newest of each worker after each batch; once the watermark has
    passed its newest beat by live_ms, the worker is told not to be live, once, and forgotten."""
    timed = rows.select("worker_id", "beat_at").withWatermark("beat_at", late)
    return timed.groupBy("worker_id").transformWithStateInPandas(Beats(live_ms), BEATS, "update", "eventTime")
