"""Streaming twins of the activity operators; each takes a streaming DataFrame and leaves the sink to the caller."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.activity import fan_out, throttle_step
from ..operators.collection import ZONE


def latest_positions(stream: DataFrame, vehicle: str, when: str, *columns: str) -> DataFrame:
    """The last position of each vehicle so far (complete or update mode); the state is one row per vehicle."""
    return stream.groupBy(vehicle).agg(F.max(F.struct(when, *columns)).alias("last")).select(vehicle, "last.*")


def usage_per_day(stream: DataFrame, user: str, action: str, when: str, late: str = "1 day", zone: str = ZONE) -> DataFrame:
    """Uses per user, action and local day; a day's state goes once the watermark has passed it."""
    local = stream.withColumn("_local", F.from_utc_timestamp(F.col(when).cast("timestamp"), zone))
    return local.withWatermark("_local", late).groupBy(F.window("_local", "1 day"), user, action).agg(F.count(F.lit(1)).alias("used")).select(F.col("window.start").alias("day"), user, action, "used")


def sessions(stream: DataFrame, user: str, when: str, idle: str = "12 hours", late: str = "1 hour") -> DataFrame:
    found = stream.withWatermark(when, late).groupBy(F.session_window(when, idle), user).agg(F.count(F.lit(1)).alias("events"))
    return found.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def notifications(stream: DataFrame, subscribers: DataFrame, on: str) -> DataFrame:
    """Stream-static join of events and subscribers."""
    return fan_out(stream, subscribers, on)


def throttle(stream: DataFrame, user: str, when: str, most: int = 5, window_s: float = 900, block_s: float = 900, late: str = "10 minutes") -> DataFrame:
    """``user``, ``at_s``, ``attempts``, ``turned_away`` of every failure, by the rule of the batch twin.

    A user's state is three numbers and goes once the watermark has passed both the window and the block.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = tuple(state.get) if state.exists else None
        rows = []
        for at in sorted(t for f in frames for t in f["at_s"]):
            held, attempts, away = throttle_step(held, at, most, window_s, block_s)
            rows.append((key[0], at, attempts, away))
        if held:
            state.update(held)
            ends = int(max(held[0] + window_s, held[2]) * 1000) + 1
            if ends > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(ends)
        yield pd.DataFrame(rows, columns=["user", "at_s", "attempts", "turned_away"])

    timed = stream.withColumn("_at", F.col(when).cast("timestamp")).withWatermark("_at", late).select(F.col(user).alias("user"), "_at", (F.unix_micros("_at") / 1000000.0).alias("at_s"))
    kind = dict(stream.dtypes)[user]
    return timed.groupBy("user").applyInPandasWithState(run, f"user {kind}, at_s double, attempts int, turned_away boolean", "start double, attempts int, until double", "append", GroupStateTimeout.EventTimeTimeout)
