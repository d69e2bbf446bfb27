"""Street incidents: scores, summaries, rankings, clustering."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, cell
from ..functions.numbers import clamp, js_round
from .graph import components

#: Fixed values of the domain.
STATUSES = ("nuevo", "verificado", "priorizado", "en_reparacion", "resuelto", "descartado")
BANDS = ("alta", "media", "baja")
TYPES = ("bache_aislado", "conjunto_de_baches", "hundimiento_o_rotura_grande")
SEVERITY_BASE = {"alta": 34, "media": 22, "baja": 12}
TYPE_RISK = {"bache_aislado": 6, "conjunto_de_baches": 12, "hundimiento_o_rotura_grande": 18}
RISK_SEVERITY = {"alta": 58, "media": 36, "baja": 18}
RISK_TYPE = {"bache_aislado": 10, "conjunto_de_baches": 18, "hundimiento_o_rotura_grande": 28}
CLOSED = ("resuelto", "descartado")
RADIUS_M = 32.0


def lookup(column: Column, values: dict[str, int], default: int) -> Column:
    return reduce(lambda out, kv: F.when(column == kv[0], kv[1]).otherwise(out), values.items(), F.lit(default))


def rank_in(column: Column, order: tuple[str, ...]) -> Column:
    return lookup(column, {v: i for i, v in enumerate(order)}, len(order))


def priority_score(severity: Column, kind: Column, reports: Column, confirmations: Column, created_at: Column, now: dt.datetime) -> Column:
    """0 to 100: severity, type, confirmations, further reports and age, each with its own ceiling."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(created_at.cast("timestamp"))) / 86400000000.0)
    total = lookup(severity, SEVERITY_BASE, 12) + lookup(kind, TYPE_RISK, 6) + clamp(confirmations * 8, 0, 24) + clamp((reports - 1) * 7, 0, 18) + clamp(js_round(days * 2), 0, 18)
    return clamp(total, 0, 100).cast("bigint")


def priority_band(score: Column) -> Column:
    return F.when(score >= 75, "alta").when(score >= 45, "media").otherwise("baja")


def impact_score(reports: Column, confirmations: Column) -> Column:
    return clamp(reports * 14 + confirmations * 18, 0, 100).cast("bigint")


def risk_score(severity: Column, kind: Column) -> Column:
    return clamp(lookup(severity, RISK_SEVERITY, 18) + lookup(kind, RISK_TYPE, 10), 0, 100).cast("bigint")


def level(score: Column) -> Column:
    return F.when(score >= 70, "alta").when(score >= 40, "media").otherwise("baja")


def with_counts(reports: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Adds ``confirmations``, zero where a report has none; the counts are aggregated before the join."""
    counts = confirmations.groupBy("report_id").agg(F.count(F.lit(1)).alias("confirmations"))
    return reports.join(counts, reports["id"] == counts["report_id"], "left").drop("report_id").withColumn("confirmations", F.coalesce("confirmations", F.lit(0)))


def filtered(reports: DataFrame, **wanted) -> DataFrame:
    """Keeps rows that meet every condition that was given; a list means any of its values."""
    found = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return reports.where(reduce(lambda a, b: a & b, found)) if found else reports


def summary(reports: DataFrame, open_priorities_only: bool = False) -> DataFrame:
    """One row: total, open, and a zero-filled count per priority band and status."""
    is_open = ~F.col("status").isin(*CLOSED)
    band = lambda b: (F.col("priority_band") == b) & (is_open if open_priorities_only else F.lit(True))
    return reports.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(is_open).alias("open"),
        *[F.count_if(band(b)).alias(f"priority_{b}") for b in BANDS], *[F.count_if(F.col("status") == s).alias(f"status_{s}") for s in STATUSES],
    )


def top(reports: DataFrame, *order: Column, n: int = 8) -> DataFrame:
    return reports.orderBy(*order).limit(n)


def modal_value(rows: DataFrame, by: str, value: str, order: tuple[str, ...]) -> DataFrame:
    """The most frequent value of each group; ties go by ``order``."""
    counted = rows.groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min_by(value, F.struct((-F.col("n")).alias("n"), rank_in(F.col(value), order).alias("r"), F.col(value).alias("v")))
    return counted.groupBy(by).agg(best.alias(value), F.max("n").alias("n"))


def ranking(rows: DataFrame, label: str, n: int = 5) -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(n)


def distribution(rows: DataFrame, column: str, order: tuple[str, ...]) -> DataFrame:
    """Share in per cent and where it begins, over a fixed order of values; absent values have zero.

    The window runs over one row per value of the fixed list.
    """
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = rows.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, order))).alias("place", "value"))
    joined = values.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    everything = Window.partitionBy(F.lit(0)).orderBy("place")
    total = F.greatest(F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(1))
    share = F.col("n") * 100.0 / total
    return joined.withColumn("share", share).select("value", "n", F.round("share", 6).alias("share"), F.round(F.coalesce(F.sum("share").over(everything.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), 6).alias("offset"))


def monthly_trend(rows: DataFrame, when: str, now: dt.datetime, months: int = 6) -> DataFrame:
    """Rows per calendar month over the last ``months``, zero where there are none."""
    first = F.trunc(F.lit(now).cast("date"), "month")
    wanted = rows.sparkSession.range(months).select(F.add_months(first, F.col("id").cast("int") - (months - 1)).alias("month"))
    counts = rows.groupBy(F.trunc(F.col(when).cast("date"), "month").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def cluster(reports: DataFrame, radius_m: float = RADIUS_M) -> DataFrame:
    """Greedy incidents: ``municipality``, ``status_group``, ``incident_id``, ``id`` of every report that is not discarded.

    Reports go by priority band, then newest first, then id. Each joins the nearest incident of its municipality and status
    group whose running mean lies within the radius, or begins one; an incident is named by its earliest report. Rows without a
    position or status are left out.

    The rule is sequential, but only among reports that could meet: the mean distance of an incident's reports to their mean is at
    most the radius, so a report that joins lies within two radii of one of them, and incidents lie within connected groups of
    occupied neighbouring grid cells of that size. Each such group is a task's work of its own and streams through it: a report looks
    only at the incidents in the cells around it, and only the incidents are held.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, known, near = None, 0, {}
        sin, reach = math.sin, radius_m / EARTH_M * 1.001

        def around(y: int, x: int) -> list[list]:
            return [near.setdefault((cy, cx), []) for cy in (y - 1, y, y + 1) for cx in (x - 1, x, x + 1)]

        for frame in frames:
            heads = []
            for piece, town, state, i, lat, lon in zip(*(frame[c].tolist() for c in ("piece", "municipality", "status_group", "id", "lat", "lon")), strict=True):
                if at != (piece, town, state):
                    at, known, near = (piece, town, state), 0, {}
                f, g = math.radians(lat), math.radians(lon)
                best, hit, cos = math.inf, None, math.cos(f)
                for c in near.get((math.floor(lat / side), math.floor(lon / across)), ()):
                    if -reach <= f - c[0] <= reach:
                        h = sin((f - c[0]) / 2) ** 2 + c[2] * cos * sin((g - c[1]) / 2) ** 2
                        if h < best or (h == best and c[7] < hit[7]):
                            best, hit = h, c
                if hit is None or 2 * EARTH_M * math.atan2(math.sqrt(best), math.sqrt(1 - best)) > radius_m:
                    spot = math.floor(lat / side), math.floor(lon / across)
                    hit = [f, g, cos, lat, lon, 1, spot, known, i]
                    known += 1
                    for spots in around(*spot):
                        spots.append(hit)
                else:
                    n = hit[5]
                    lat, lon = (hit[3] * n + lat) / (n + 1), (hit[4] * n + lon) / (n + 1)
                    f = math.radians(lat)
                    hit[:6] = f, math.radians(lon), math.cos(f), lat, lon, n + 1
                    spot = math.floor(lat / side), math.floor(lon / across)
                    if spot != hit[6]:
                        for spots in around(*hit[6]):
                            spots[:] = [c for c in spots if c is not hit]
                        for spots in around(*spot):
                            spots.append(hit)
                        hit[6] = spot
                heads.append(hit[8])
            yield pd.DataFrame({"municipality": frame["municipality"], "status_group": frame["status_group"], "head": heads, "micros": frame["micros"], "id": frame["id"]})

    group = F.when(F.col("status") == "resuelto", "resolved").otherwise("open")
    rows = reports.where((F.col("status") != "descartado") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    far = rows.agg(F.max(F.abs("lat")).alias("m")).first()["m"] or 0.0
    high, wide = 2 * radius_m / 110_000.0, 2 * radius_m / (110_000.0 * max(0.01, math.cos(math.radians(min(89.0, far + 0.1)))))
    side, across = high / 2, wide / 2
    rows = rows.select("municipality", group.alias("status_group"), "id", "lat", "lon", rank_in(F.col("priority_band"), BANDS).alias("band"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("micros"), cell(F.col("lat"), high).alias("y"), cell(F.col("lon"), wide).alias("x"))
    own = F.xxhash64("municipality", "status_group", "y", "x")
    cells = rows.select("municipality", "status_group", "y", "x", own.alias("a")).distinct()
    ahead = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]))
    beside = cells.select("municipality", "status_group", "a", ahead.alias("c")).select("municipality", "status_group", F.col("a").alias("b"), "c.y", "c.x")
    joined = components(beside.join(cells, ["municipality", "status_group", "y", "x"]).select("a", "b"))
    placed = rows.withColumn("node", own).join(joined, "node", "left").withColumn("piece", F.coalesce("component", "node"))
    ordered = placed.repartition("piece").sortWithinPartitions("piece", "municipality", "status_group", "band", F.desc("micros"), "id")
    columns = ordered.select(F.col("municipality").cast("long").alias("municipality"), "status_group", "piece", "id", "micros", "lat", "lon")
    headed = columns.mapInPandas(run, "municipality long, status_group string, head long, micros long, id long")
    earliest = F.min(F.struct("micros", "id")).over(Window.partitionBy("municipality", "status_group", "head"))
    return headed.select("municipality", "status_group", earliest["id"].alias("incident_id"), "id")
