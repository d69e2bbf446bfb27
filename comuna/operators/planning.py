"""Service planning: zones, tours, route shapes, shifts, and plans made up for towns without one."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m
from ..functions.numbers import js_round, to_time
from .graph import cut
from .scoring import spread

#: A table is broadcast only if it is checked to have so many rows at most.
SHORT = 10_000


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it is checked to be short."""
    return F.broadcast(df) if df.limit(SHORT + 1).count() <= SHORT else df


def _items(array: str, n: int) -> list[Column]:
    """The first ``n`` elements one by one: what is said of each is compiled, unlike a lambda's body."""
    return [F.col(array)[i] for i in range(n)]


def _least(values: list[Column]) -> Column:
    return F.least(*values) if len(values) > 1 else values[0]


def _first_centres(points: DataFrame, by: str, k: int) -> DataFrame:
    """Each group's first point by ``place``, then ``k`` - 1 times the point farthest from all centres so far."""
    as_point = F.struct("lat", "lon")
    newest = points.groupBy(by).agg(F.min_by(as_point, "place").alias("c"))
    centres = newest.select(by, F.array(F.struct(F.lit(0).alias("i"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon"))).alias("centres"))
    for i in range(1, k):
        met = points.join(_small(centres), by)
        far = _least([haversine_m(F.col("lat"), F.col("lon"), c["lat"], c["lon"]) for c in _items("centres", i)])
        newest = met.groupBy(by).agg(F.max_by(as_point, F.struct(far, -F.col("place"))).alias("c"))
        added = F.array_append("centres", F.struct(F.lit(i).alias("i"), F.col("c.lat").alias("lat"), F.col("c.lon").alias("lon")))
        centres = cut(centres.join(newest, by).select(by, added.alias("centres")))
    return centres


def zones(points: DataFrame, by: str, k: int = 5, rounds: int = 20, still_m: float = 1.0) -> DataFrame:
    """``id`` and ``zone`` (from 0, north to south, then west to east) of points (``by``, ``id``, ``place``, ``lat``, ``lon``): k-means per group.

    Distances are great-circle; a group rests when no centre moves ``still_m``. Points stay where they are: only the ``k`` centres
    of each group move, as one array per group, so a group of any size is aggregated in parts.
    """
    # Every round reads the points, so they are dealt over the cores once, in however few files they come.
    points = cut(spread(points.select(by, "id", "place", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))))
    centres = _first_centres(points, by, k).withColumn("still", F.lit(False))

    def labelled(of: DataFrame) -> DataFrame:
        near = _least([F.struct(haversine_m(F.col("lat"), F.col("lon"), c["lat"], c["lon"]).alias("m"), c["i"].alias("i")) for c in _items("centres", k)])
        return points.join(_small(of), by).withColumn("label", near["i"])

    for _ in range(rounds - 1):
        means = labelled(centres.where("NOT still")).groupBy(by, "label").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
        means = means.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("lat", "lon")))).alias("means"))
        moved = F.transform("centres", lambda c: F.struct(c["i"].alias("i"), F.coalesce(F.col("means")[c["i"]]["lat"], c["lat"]).alias("lat"), F.coalesce(F.col("means")[c["i"]]["lon"], c["lon"]).alias("lon")))
        step = centres.join(means, by, "left").withColumn("moved", moved)
        rests = F.col("still") | F.forall(F.arrays_zip("centres", "moved"), lambda z: haversine_m(z["centres"]["lat"], z["centres"]["lon"], z["moved"]["lat"], z["moved"]["lon"]) < still_m)
        centres = cut(step.withColumn("rests", rests).select(by, F.when(F.col("rests"), F.col("centres")).otherwise(F.col("moved")).alias("centres"), F.col("rests").alias("still")))
        if not centres.where("NOT still").limit(1).count():
            break
    done = labelled(centres)
    middle = done.groupBy(by, "label").agg(F.avg("lat").alias("mlat"), F.avg("lon").alias("mlon"))
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("mlat"), "mlon", "label")) - 1
    return done.join(_small(middle.withColumn("zone", order).select(by, "label", "zone")), [by, "label"]).select(by, "id", "zone")


def tours(stops: DataFrame, route: str = "route_id") -> DataFrame:
    """``id`` and ``sequence`` (from 1) of a route's stops, each the nearest to the one before, the first to the depot.

    ``stops`` has the route, ``id``, ``place`` (decides ties), ``lat``, ``lon``, ``depot_lat``, ``depot_lon``. A tour is sequential by
    definition, so one route, which is what one truck serves, is one task's work.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["place", "id"], ignore_index=True)
        lat, lon = np.radians(rows["lat"].to_numpy(float)), np.radians(rows["lon"].to_numpy(float))
        at, left, order = (np.radians(rows["depot_lat"][0]), np.radians(rows["depot_lon"][0])), np.ones(len(rows), bool), []
        for _ in range(len(rows)):
            a = np.sin((lat - at[0]) / 2) ** 2 + np.cos(at[0]) * np.cos(lat) * np.sin((lon - at[1]) / 2) ** 2
            metres = np.where(left, 2 * EARTH_M * np.arctan2(np.sqrt(a), np.sqrt(1 - a)), np.inf)
            best = int(metres.argmin())
            left[best], at = False, (lat[best], lon[best])
            order.append(best)
        out = rows.loc[order, [route, "id"]].reset_index(drop=True)
        return out.assign(sequence=range(1, len(out) + 1))

    kept = stops.select(route, "id", "place", "lat", "lon", "depot_lat", "depot_lon")
    types = dict(kept.dtypes)
    return kept.groupBy(route).applyInPandas(walk, f"{route} {types[route]}, id {types['id']}, sequence int")


def route_shapes(legs: DataFrame, nodes: DataFrame, route: str = "route_id") -> DataFrame:
    """``seq``, ``node``, ``lat``, ``lon``, ``is_anchor`` of the points of each route, its legs (``leg``, ``path``) put end to end.

    The node where two legs meet comes once; a leg's last point is an anchor.
    """
    before = Window.partitionBy(route).orderBy("leg")
    start = F.coalesce(F.sum(F.size("path") - 1).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = legs.select(route, "path", F.row_number().over(before).alias("n"), start.alias("start"))  # before the points are dealt out
    parts = numbered.select("*", F.size("path").alias("size"), F.posexplode("path").alias("at", "node"))
    kept = parts.where((F.col("n") == 1) | (F.col("at") > 0))
    placed = kept.select(route, (F.col("start") + F.col("at")).cast("int").alias("seq"), "node", (F.col("at") == F.col("size") - 1).alias("is_anchor"))
    return placed.join(nodes.select(F.col("id").alias("node"), "lat", "lon"), "node").select(route, "seq", "node", "lat", "lon", "is_anchor")


def service_patterns(routes: DataFrame, trucks: DataFrame, slots: int = 22) -> DataFrame:
    """One shift an hour for every route (``route_id``, ``depot``, ``zone`` from 0): its trucks (``depot``, ``truck_id``) take turns.

    Routes of a depot without trucks have none.
    """
    fleet = trucks.groupBy("depot").agg(F.array_sort(F.collect_set("truck_id")).alias("fleet"))
    shifts = routes.join(fleet, "depot", "left").select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    truck = F.try_element_at("fleet", (F.pmod(F.col("zone") + F.col("slot"), F.greatest(F.size("fleet"), F.lit(1))) + 1).cast("int"))
    minute = F.pmod(F.col("slot") * 60 + 10 + F.col("zone") * 10, F.lit(1440))
    pattern = F.concat(F.col("route_id").cast("string"), F.lit("-S"), F.lpad((F.col("slot") + 1).cast("string"), 2, "0"))
    return shifts.select("route_id", pattern.alias("pattern_id"), F.left(to_time(minute), F.lit(5)).alias("start_time"), truck.alias("truck_id"))


def made_up_routes(towns: DataFrame, key: str = "municipality", size: int = 3) -> DataFrame:
    """A plan for towns without one: ``size`` quarters in the order of their labels make a route.

    ``towns`` has the key, ``id``, ``label``, ``lat``, ``lon`` (rows without a place are left out). Gives one row per quarter:
    ``route_index`` (from 0), ``sequence`` (from 1), ``duration_min``.
    """
    there = towns.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    place = F.row_number().over(Window.partitionBy(key).orderBy("label", "id")) - 1
    placed = there.withColumn("route_index", F.floor(place / size).cast("int")).withColumn("sequence", (place % size + 1).cast("int"))
    stops = F.count(F.lit(1)).over(Window.partitionBy(key, "route_index"))
    return placed.withColumn("duration_min", F.greatest(F.lit(28), 18 + stops * 12).cast("int"))


def made_up_shapes(routes: DataFrame, key: str = "municipality") -> DataFrame:
    """``shape`` (array of ``lat``, ``lon``) of each made-up route: out from the depot by each quarter and a point beside it, and back.

    ``routes`` is as ``made_up_routes`` gives it, with ``depot_lat``, ``depot_lon``.
    """
    near = lambda s, name, by: F.round(s[name] + by, 6).alias(name)
    of = routes.groupBy(key, "route_index").agg(F.array_sort(F.collect_list(F.struct("sequence", "lat", "lon"))).alias("stops"), F.first("depot_lat").alias("y"), F.first("depot_lon").alias("x"))
    depot = F.array(F.struct(F.col("y").alias("lat"), F.col("x").alias("lon")))
    way = F.flatten(F.transform("stops", lambda s: F.array(F.struct(s["lat"].alias("lat"), s["lon"].alias("lon")), F.struct(near(s, "lat", 0.0012), near(s, "lon", 0.0009)))))
    return of.select(key, "route_index", F.concat(depot, way, depot).alias("shape"))


def made_up_passes(routes: DataFrame, now: dt.datetime, past: int = 8, future: int = 3) -> DataFrame:
    """``at`` and ``is_past`` of the passes at each quarter of made-up routes: up to ``past`` before ``now`` and ``future`` to come.

    A route comes every 3.5 to 5.5 days by its index, at an hour of its own, nine minutes later at each further stop.
    """
    cadence = F.lit(3.5) + F.col("route_index") % 3
    minutes = (6 + (F.col("route_index") * 2) % 10) * 60 + (F.col("route_index") * 11) % 60 + (F.col("sequence") - 1) * 9
    turns = F.concat(F.sequence(F.lit(-past + 1), F.lit(0)), F.sequence(F.lit(1), F.lit(future)))
    spread = routes.select("*", F.explode(turns).alias("turn"))
    days = F.when(F.col("turn") <= 0, -js_round(-F.col("turn") * cadence)).otherwise(js_round(F.col("turn") * cadence)).cast("int")
    day = F.date_add(F.lit(now.date()), days).cast("timestamp")
    at = F.timestamp_micros(F.unix_micros(day) + minutes.cast("long") * 60_000_000)
    return spread.withColumn("at", at).withColumn("is_past", F.col("turn") <= 0).where(~F.col("is_past") | (F.col("at") <= F.lit(now))).drop("turn")
