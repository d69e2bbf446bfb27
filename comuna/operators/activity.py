"""User activity: quotas, throttles, notifications, shifts."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .collection import ZONE
from .graph import cut

#: Pairs of an event and a subscriber's channel that are a slice of a place, and tasks of a fan-out at most.
PAIRS, MOST_TASKS = 20_000_000, 10_000


def local_day(when: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(when.cast("timestamp"), zone))


def daily_quota(usage: DataFrame, user: str, action: str, when: str, limit: int, zone: str = ZONE) -> DataFrame:
    """Used, remaining and whether the limit is reached, per user, action and local day."""
    used = usage.groupBy(user, action, local_day(F.col(when), zone).alias("day")).agg(F.count(F.lit(1)).alias("used"))
    return used.withColumn("remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0))).withColumn("blocked", F.col("used") >= limit)


def throttle_step(state: tuple[float, int, float] | None, at: float, most: int, window_s: float, block_s: float) -> tuple[tuple[float, int, float], int, bool]:
    """One failure at ``at``: the new state (window's start, attempts, blocked until), the attempts and whether it was turned away.

    A window begins with the first failure after the last window. The ``most``-th failure in it blocks for ``block_s``; what comes
    while blocked is turned away and not counted.
    """
    if state and state[2] > at:
        return state, state[1], True
    start, attempts = (state[0], state[1] + 1) if state and at - state[0] <= window_s else (at, 1)
    return (start, attempts, at + block_s if attempts >= most else 0.0), attempts, False


def throttled(failures: DataFrame, user: str, when: str, key: str, most: int = 5, window_s: float = 900, block_s: float = 900) -> DataFrame:
    """``key``, ``attempts``, ``turned_away`` of every failure, by ``throttle_step``.

    The rule is sequential within a user. Rows stream through each task in order of user and time with one state at a time, so a
    user of any number of failures takes no memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), None
        for batch in batches:
            attempts, away = [], []
            for who, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if who != last:
                    last, state = who, None
                state, n, gone = throttle_step(state, at, most, window_s, block_s)
                attempts.append(n)
                away.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(attempts, pa.int32()), pa.array(away, pa.bool_())], names=[key, "attempts", "turned_away"])

    rows = failures.select(user, (F.unix_micros(F.col(when).cast("timestamp")) / 1000000.0).alias("at_s"), key)
    placed = rows.repartition(user).sortWithinPartitions(user, "at_s", key)
    return placed.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, attempts int, turned_away boolean")


def fan_out(events: DataFrame, subscribers: DataFrame, on: str) -> DataFrame:
    """One notification per event, subscriber and channel; channel ``all`` means both email and push.

    The result has as many rows as events and subscribers of a place make pairs, so a place is dealt out in slices of ``PAIRS`` and
    as many tasks as that makes. A task's rows stand by place and event, so the same subscribers follow one another again and
    again and files hold little more than each list once. A stream is joined as it comes.
    """
    channels = F.when(F.col("channel") == "all", F.array(F.lit("email"), F.lit("push"))).otherwise(F.array("channel"))
    told = subscribers.withColumn("delivery", F.explode(channels)).drop("channel")
    counts = lambda rows, name: rows.groupBy(on).agg(F.count(F.lit(1)).alias(name))
    if events.isStreaming:
        return events.join(told, on)
    pairs = F.col("_e") * F.col("_s")
    slices = cut(counts(events, "_e").join(counts(told, "_s"), on).select(on, pairs.alias("_pairs"), F.ceil(pairs / PAIRS).cast("int").alias("_slices")))
    all_pairs = slices.agg(F.sum(F.col("_pairs").cast("double"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(events.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * all_pairs / PAIRS)))
    slices = slices.drop("_pairs")
    dealt = events.join(slices, on).withColumn("_slice", F.pmod(F.xxhash64(*events.columns), F.col("_slices")).cast("int")).drop("_slices")
    copied = told.join(slices, on).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
    keys = [on, "_slice"]
    return dealt.repartition(tasks, *keys).join(copied.repartition(tasks, *keys).hint("merge"), keys).drop("_slice")


def latest_positions(positions: DataFrame, vehicle: str, when: str, *columns: str) -> DataFrame:
    """The last position of each vehicle; one pass with partial aggregation, no sort."""
    return positions.groupBy(vehicle).agg(F.max(F.struct(when, *columns)).alias("last")).select(vehicle, "last.*")


def fresh(positions: DataFrame, when: str, now: dt.datetime, minutes: int = 20) -> DataFrame:
    return positions.where(F.col(when).cast("timestamp") >= F.lit(now - dt.timedelta(minutes=minutes)))


def shifts(starts: DataFrame, user: str, when: str, ends: DataFrame | None = None) -> DataFrame:
    """A shift lasts until the user's next start or, if that comes first, the next end (``ends``: user, when); the last one is online."""
    order = Window.partitionBy(user).orderBy(when, "_end")
    every = starts.withColumn("_end", F.lit(0))
    if ends is not None:
        every = every.unionByName(ends.select(user, when).withColumn("_end", F.lit(1)), allowMissingColumns=True)
    found = every.withColumn("ended_at", F.lead(when).over(order)).where("_end = 0").drop("_end")
    return found.withColumn("status", F.when(F.col("ended_at").isNull(), "online").otherwise("ended"))


def shift_runs(events: DataFrame, user: str, shift: str, when: str, kind: str, expiry_s: float | None = 1200, until: dt.datetime | None = None) -> DataFrame:
    """``user``, ``shift_id``, ``started_at``, ``ended_at``, ``reason`` of every start; both null while the shift lasts.

    Events are of the kinds start, position and end; others, and those without user or time, are left out. A shift ends by the next
    start, an end, or ``expiry_s`` seconds after the last event if nothing comes before; after the last event of all only if ``until``
    is later. At one instant starts count before positions and ends.
    """
    number = F.array_position(F.array(F.lit("start"), F.lit("position"), F.lit("end")), F.col(kind)).cast("int") - 1
    rows = events.select(F.col(user).alias("user"), F.col(shift).cast("string").alias("shift_id"), F.unix_micros(F.col(when).cast("timestamp")).alias("at"), number.alias("kind"))
    rows = rows.where("user IS NOT NULL AND at IS NOT NULL AND kind >= 0")
    order = Window.partitionBy("user").orderBy("at", "kind", "shift_id")
    rows = rows.withColumns({"run": F.sum((F.col("kind") == 0).cast("int")).over(order), "next_at": F.lead("at").over(order), "next_kind": F.lead("kind").over(order)})
    expiry = None if expiry_s is None else round(expiry_s * 1e6)
    end = F.lit(None if until is None else until).cast("timestamp")
    silent = F.lit(False) if expiry is None else F.coalesce(F.coalesce("next_at", F.unix_micros(end)) - F.col("at") > expiry, F.lit(False))
    reason = F.when(silent, "expired").when(F.col("next_kind") == 2, "end").when(F.col("next_kind") == 0, "next start")
    closing = F.when(silent, F.col("at") + (expiry or 0)).otherwise(F.col("next_at"))
    first = F.min(F.when(reason.isNotNull(), F.struct("at", "kind", closing.alias("ended"), reason.alias("reason"))))
    found = rows.where("run > 0").groupBy("user", "run").agg(F.min_by("shift_id", F.struct("kind", "at")).alias("shift_id"), F.min("at").alias("started"), first.alias("last"))
    return found.select("user", "shift_id", F.timestamp_micros("started").alias("started_at"), F.timestamp_micros("last.ended").alias("ended_at"), F.col("last.reason").alias("reason"))


def reported_vehicles(shifts: DataFrame, when: str, now: dt.datetime, minutes: int = 20) -> DataFrame:
    """Shifts that are online, have a position (``lat``, ``lon``) and were seen within ``minutes``."""
    return fresh(shifts, when, now, minutes).where("status = 'online' AND lat IS NOT NULL AND lon IS NOT NULL")
