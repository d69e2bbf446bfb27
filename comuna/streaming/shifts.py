"""Shifts as a state machine over a stream: a start closes the shift before it, an end closes it, silence lets it expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an event does, in the order in which events of one instant count.
KINDS = ("start", "position", "end")


class ShiftMachine(StatefulProcessor):
    """One user's events wait in a list until the watermark has passed them, then move the open shift in order of time.

    The state is the open shift and the events that are not settled; both are bounded by how late events may come.
    """

    def __init__(self, expiry_us: int | None):
        self.expiry_us = expiry_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "shift_id string, started_us bigint, seen_us bigint")
        self.waiting = handle.getListState("waiting", "at_us bigint, kind int, shift_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, kind, shift in zip(frame["at_us"].tolist(), frame["kind"].tolist(), frame["shift_id"].tolist()):
                self.waiting.appendValue((int(at), int(kind), shift))
                self.handle.registerTimer(int(at) // 1000 + 1)
        yield self.rows([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        settled = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.waiting.get())
        due = [e for e in events if e[0] < settled]
        rest = events[len(due) :]
        shift = tuple(self.open.get()) if self.open.exists() else None
        closed: list[tuple] = []

        def close(at: int, reason: str) -> None:
            nonlocal shift
            closed.append((key[0], shift[0], shift[1], at, reason))
            shift = None

        for at, kind, shift_id in due:
            if shift and self.expiry_us is not None and at - shift[2] > self.expiry_us:
                close(shift[2] + self.expiry_us, "expired")
            if shift and kind != 1:
                close(at, "end" if kind == 2 else "next start")
            if kind == 0:
                shift = (shift_id, at, at)
            elif shift:
                shift = (shift[0], shift[1], at)
        if shift and self.expiry_us is not None:
            if shift[2] + self.expiry_us < settled:
                close(shift[2] + self.expiry_us, "expired")
            else:
                self.handle.registerTimer((shift[2] + self.expiry_us) // 1000 + 1)
        if due:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        if shift:
            self.open.update(shift)
        else:
            self.open.clear()
        yield self.rows(closed)

    @staticmethod
    def rows(closed: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(closed, columns=["user", "shift_id", "started_us", "ended_us", "reason"])

    def close(self) -> None:
        pass


def shifts(stream: DataFrame, user: str, shift: str, when: str, kind: str, expiry_s: float | None = 1200, late: str = "10 minutes") -> DataFrame:
    """``user``, ``shift_id``, ``started_at``, ``ended_at``, ``reason`` of every shift that has ended, by ``activity.shift_runs``.

    ``kind`` is one of ``KINDS``; rows of another kind or without user or time are left out. Events may come in any order within
    ``late``; what comes later is dropped. Needs the RocksDB state store.
    """
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col(kind)).cast("int") - 1
    timed = stream.select(F.col(user).alias("user"), F.col(shift).cast("string").alias("shift_id"), F.col(when).cast("timestamp").alias("_at"), number.alias("kind")).where("user IS NOT NULL AND _at IS NOT NULL AND kind >= 0")
    timed = timed.withWatermark("_at", late).withColumn("at_us", F.unix_micros("_at"))
    machine = ShiftMachine(None if expiry_s is None else round(expiry_s * 1e6))
    found = timed.groupBy("user").transformWithStateInPandas(machine, f"user {dict(timed.dtypes)['user']}, shift_id string, started_us bigint, ended_us bigint, reason string", "Append", "EventTime")
    return found.select("user", "shift_id", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"), "reason")
