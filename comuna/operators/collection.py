"""Collection routes: cadence statistics, schedules, shapes, vehicles."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..functions.numbers import clamp, js_round, to_time

ZONE = "America/Asuncion"


def interval_stats(events: DataFrame, key: str, when: str) -> DataFrame:
    """Events, mean hours between them (1 decimal), days of cadence (3.5 at least) and monthly passes (1 to 8) per key."""
    micros = F.unix_micros(F.col(when).cast("timestamp"))
    found = events.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(micros).alias("first"), F.max(micros).alias("last"))
    hours = F.when(F.col("n") > 1, js_round((F.col("last") - F.col("first")) / (F.col("n") - 1) / 3600000000.0 * 10) / 10.0)
    found = found.withColumn("mean_hours", hours)
    cadence = F.greatest(F.lit(3.5), js_round(F.coalesce("mean_hours", F.lit(0.0)) / 24.0 * 10) / 10.0)
    found = found.withColumn("cadence_days", cadence)
    return found.select(key, "n", "mean_hours", "cadence_days", clamp(js_round(30 / F.col("cadence_days")), 1, 8).cast("bigint").alias("monthly_passes"))


def cadence(keys: DataFrame, events: DataFrame, key: str, when: str, latest: int) -> DataFrame:
    """``interval_stats`` over the latest events of every key of ``keys``; a key without events has no passes."""
    order = Window.partitionBy(key).orderBy(F.desc(when))
    recent = events.select(key, when).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= latest)
    found = keys.join(interval_stats(recent, key, when), key, "left").withColumns({"n": F.coalesce("n", F.lit(0)), "cadence_days": F.coalesce("cadence_days", F.lit(3.5))})
    return found.withColumn("monthly_passes", F.coalesce("monthly_passes", F.lit(0)))


def recent_value(keys: DataFrame, events: DataFrame, key: str, value: str, when: str, now: dt.datetime, days: int, other: str) -> DataFrame:
    """``frequent_value`` over the last ``days`` days for every key of ``keys``; where there is none its column ``other``."""
    at = F.col(when).cast("timestamp")
    recent = events.where((at >= F.lit(now - dt.timedelta(days=days))) & (at <= F.lit(now)))
    return keys.join(frequent_value(recent, key, value, when), key, "left").select(key, F.coalesce(value, other).alias(value))


def habitual_hour(events: DataFrame, key: str, when: str, latest: int = 20, zone: str = ZONE) -> DataFrame:
    """The most frequent local hour among each key's latest events; ties go to the more recent one."""
    order = Window.partitionBy(key).orderBy(F.desc(when))
    recent = events.select(key, when).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= latest)
    hour = F.hour(F.from_utc_timestamp(F.col(when).cast("timestamp"), zone))
    counted = recent.groupBy(key, hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("seen"))
    return counted.groupBy(key).agg(F.max_by("hour", F.struct("n", "seen")).alias("hour"))


def frequent_value(events: DataFrame, key: str, value: str, when: str) -> DataFrame:
    """The most frequent value per key; ties go to the one seen last."""
    counted = events.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.max(when).alias("seen"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct("n", "seen")).alias(value))


def rolling_counts(events: DataFrame, key: str, when: str, now: dt.datetime, days: tuple[int, ...] = (7, 30, 365)) -> DataFrame:
    at = F.col(when).cast("timestamp")
    return events.groupBy(key).agg(*[F.count_if((at >= F.lit(now - dt.timedelta(days=d))) & (at <= F.lit(now))).alias(f"last_{d}_days") for d in days])


def capped_history(events: DataFrame, key: str, when: str, now: dt.datetime, past: int, future: int) -> DataFrame:
    """The latest ``past`` events before ``now`` and the next ``future`` from then on, per key."""
    is_past = F.col(when).cast("timestamp") < F.lit(now)
    micros = F.unix_micros(F.col(when).cast("timestamp"))
    near = Window.partitionBy(key, "is_past").orderBy(F.when(F.col("is_past"), -F.col("micros")).otherwise(F.col("micros")))
    ranked = events.withColumn("is_past", is_past).withColumn("micros", micros).withColumn("place", F.row_number().over(near))
    return ranked.where(F.col("place") <= F.when(F.col("is_past"), past).otherwise(future)).drop("micros")


def gaps(events: DataFrame, key: str, when: str) -> DataFrame:
    """Seconds since the event before, null for the first."""
    before = F.lag(when).over(Window.partitionBy(key).orderBy(when))
    seconds = (F.unix_micros(F.col(when).cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / 1000000.0
    return events.withColumn("gap_s", seconds)


def sessions(events: DataFrame, key: str, when: str, idle_s: float) -> DataFrame:
    """Numbers each key's sessions from 1: a new one begins after more than ``idle_s`` seconds without an event."""
    found = gaps(events, key, when)
    new = F.when(F.col("gap_s").isNull() | (F.col("gap_s") > idle_s), 1).otherwise(0)
    return found.withColumn("session", F.sum(new).over(Window.partitionBy(key).orderBy(when)))


def shape_metrics(points: DataFrame, route: str = "route_id", seq: str = "seq") -> DataFrame:
    """Adds ``cum_m``: metres along the route at each point, 3 decimals."""
    order = Window.partitionBy(route).orderBy(seq)
    step = F.coalesce(haversine_m(F.lag("lat").over(order), F.lag("lon").over(order), F.col("lat"), F.col("lon")), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("cum_m", F.round(F.sum("step_m").over(order), 3)).drop("step_m")


def positions_along(shapes: DataFrame, wanted: DataFrame, route: str = "route_id", seq: str = "seq", longest_m: float = 300.0) -> DataFrame:
    """Where ``wanted`` (route, ``distance_m``) lies on ``shapes`` with ``cum_m``; segments over ``longest_m`` snap to the nearer end."""
    order = Window.partitionBy(route).orderBy(seq)
    ends = shapes.select(route, F.col("cum_m").alias("from_m"), "lat", "lon", F.lead("cum_m").over(order).alias("to_m"), F.lead("lat").over(order).alias("lat2"), F.lead("lon").over(order).alias("lon2"))
    met = wanted.join(ends, route).where((F.col("distance_m") >= F.col("from_m")) & (F.col("distance_m") < F.col("to_m")))
    length = F.col("to_m") - F.col("from_m")
    share = (F.col("distance_m") - F.col("from_m")) / length
    share = F.when(length > longest_m, F.when(share < 0.5, 0.0).otherwise(1.0)).otherwise(share)
    return met.select(*wanted.columns, F.round(F.col("lat") + (F.col("lat2") - F.col("lat")) * share, 6).alias("lat"), F.round(F.col("lon") + (F.col("lon2") - F.col("lon")) * share, 6).alias("lon"))


def expand_schedule(patterns: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """A run for every day on which a pattern serves: ``patterns`` has ``pattern_id``, ``service_days`` (lower-case English names)."""
    days = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("service_date")
    runs = patterns.select("*", days).withColumn("day", F.lower(F.date_format("service_date", "EEEE")))
    return runs.where(F.array_contains("service_days", F.col("day"))).withColumn("run_key", F.concat_ws(":", F.col("pattern_id").cast("string"), F.col("service_date").cast("string")))


def route_timings(stops: DataFrame, route: str = "route_id", seq: str = "seq", km_h: float = 22.0) -> DataFrame:
    """Minutes of arrival and exit at every stop, and of the whole run, from metres along the route (``cum_m``)."""
    whole, order = Window.partitionBy(route), Window.partitionBy(route).orderBy(seq)
    total = F.max("cum_m").over(whole)
    travel = F.greatest(F.lit(36), js_round(total / 1000.0 / km_h * 60))
    place = F.row_number().over(order) - 1
    arrival = js_round(F.when(total > 0, F.col("cum_m") / total).otherwise(0.0) * travel) + 4 * place
    timed = stops.withColumn("arrival_min", arrival.cast("bigint")).withColumn("exit_min", F.col("arrival_min") + 3)
    n = F.count(F.lit(1)).over(whole)
    return timed.withColumn("duration_min", F.greatest(travel + 4 * n, F.max("exit_min").over(whole) + 8).cast("bigint"))


def run_events(runs: DataFrame, coverage: DataFrame, start_minute: str = "start_min") -> DataFrame:
    """Every run at every stop of its route, with the transit time (past 24:00 where need be)."""
    met = runs.join(coverage, "route_id")
    return met.withColumn("arrival_time", to_time(F.col(start_minute) + F.col("arrival_min")))


def round_robin(vehicles: DataFrame, depot: str, key: str, n: int = 10) -> DataFrame:
    """The first ``n`` vehicles, one of each depot in turn."""
    turn = F.row_number().over(Window.partitionBy(depot).orderBy(key))
    return vehicles.withColumn("turn", turn).orderBy("turn", depot).limit(n)


def merged_vehicles(reported: DataFrame, simulated: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Reported vehicles before simulated ones of the same key; ``n`` at most."""
    both = reported.withColumn("tier", F.lit(0)).unionByName(simulated.withColumn("tier", F.lit(1)))
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("tier"))).where("rn = 1").drop("rn")
    return first.orderBy("tier", key).limit(n)


def name_hash(name: Column) -> Column:
    """31-multiplier hash over the characters of an ASCII name, modulo 2**32."""
    return F.aggregate(F.split(name, ""), F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(4294967296)))
