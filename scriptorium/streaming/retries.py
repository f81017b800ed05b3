"""Retries as a stateful stream: attempts per key, growing pauses, giving up, and forgetting."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store must be for timers; a session sets ``spark.sql.streaming.stateStore.providerClass`` to it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "key string, event string, attempt int, at timestamp"


class _Retries(StatefulProcessor):
    """State of a key: the attempts that failed (a bit each), the least that succeeded, whether it is settled, its last time, its timer."""

    def __init__(self, most: int, pause_ms: int, forget_ms: int) -> None:
        self.most, self.pause_ms, self.forget_ms = most, pause_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "failed long, won int, settled boolean, last long, due long")

    def _wait(self, due: int | None, until: int) -> int:
        if due is not None:
            self.handle.deleteTimer(due)
        self.handle.registerTimer(until)
        return until

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        failed, won, settled, last, due = self.state.get() if self.state.exists() else (0, None, False, 0, None)
        for row in rows:
            last = max(last, row.at_ms)
            if row.attempt is None or not 1 <= row.attempt <= self.most:
                continue
            if row.ok:
                won = min(won or row.attempt, row.attempt)
            else:
                failed |= 1 << row.attempt
        event, attempt = self._event(failed, won)
        if event and not settled:
            settled = True
            yield Row(key=key[0], event=event, attempt=attempt, at_ms=last)
        tries = bin(failed).count("1")
        pause = self.forget_ms if settled or not tries else self.pause_ms * 2 ** (tries - 1)
        due = self._wait(due, max(last, timerValues.getCurrentWatermarkInMs()) + pause)
        self.state.update((failed, won, settled, last, due))

    def _event(self, failed: int, won: int | None) -> tuple[str | None, int]:
        """What the attempts seen so far settle: nothing while one before the success is missing."""
        before = sum(1 << i for i in range(1, won or self.most + 1))
        if failed & before != before:
            return None, 0
        return ("done", won) if won else ("failed", self.most)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        failed, won, settled, last, due = self.state.get()
        at = expiredTimerInfo.getExpiryTimeInMs()
        if settled:
            self.state.clear()
        elif at - last >= self.forget_ms:
            self.state.clear()
            yield Row(key=key[0], event="expired", attempt=bin(failed).count("1"), at_ms=at)
        else:
            tries = bin(failed).count("1")
            self.handle.registerTimer(last + self.forget_ms)
            self.state.update((failed, won, settled, last, last + self.forget_ms))
            yield Row(key=key[0], event="retry", attempt=tries + 1, at_ms=at)

    def close(self) -> None:
        pass


def retry_events(attempts: DataFrame, most: int = 3, pause: int = 60, forget: int = 86_400) -> DataFrame:
    """(key, event, attempt, at) of a stream of attempts (key string, attempt int, ok boolean, at timestamp with a watermark).

    ``done``: the first success among the first ``most`` attempts, once all before it are known to have failed; ``failed``: all of
    them failed; ``retry``: an attempt failed and for ``pause`` seconds, doubled with each failure, no other was seen;
    ``expired``: nothing came for ``forget`` seconds.  Each key is settled once, in whatever order its attempts
    come and however they are cut into batches; repeated attempts change nothing.  A key is forgotten ``forget`` seconds after it is settled or
    expires, and is new if it comes again; ``forget`` is longer than the longest pause.  A null ``ok`` is a failure; rows without a key or time, and rows behind the watermark, go.
    State is a few numbers per key, so a hot key is no large state.
    """
    if forget <= pause * 2 ** (most - 1):
        raise ValueError("forget must be longer than the longest pause")
    numbered = attempts.where("key is not null and at is not null").selectExpr("key", "attempt", "coalesce(ok, false) as ok", "unix_millis(at) as at_ms", "at")
    found = numbered.groupBy("key").transformWithState(
        statefulProcessor=_Retries(most, pause * 1000, forget * 1000), outputStructType="key string, event string, attempt int, at_ms long", outputMode="append", timeMode="eventTime"
    )
    return found.selectExpr("key", "event", "attempt", "timestamp_millis(at_ms) as at")
