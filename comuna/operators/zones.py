"""Polygons: where points lie, bounds and centres, nearest places, clipped routes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell, haversine_m, in_ring
from ..functions.text import normalize
from .graph import cut

#: The JSON shape of a polygon; rings are lists of (lon, lat).
_POLYGON = "struct<type:string,coordinates:array<array<array<double>>>>"
_MULTI = "struct<type:string,coordinates:array<array<array<array<double>>>>>"


def parse_geometry(text: Column) -> Column:
    """Polygons (array of arrays of rings of (lon, lat) structs) of GeoJSON text: a geometry, a feature, or a collection's first
    feature; null for anything else."""
    inner = F.coalesce(F.get_json_object(text, "$.geometry"), F.get_json_object(text, "$.features[0].geometry"), text)
    kind = F.get_json_object(inner, "$.type")
    single, many = F.from_json(inner, _POLYGON)["coordinates"], F.from_json(inner, _MULTI)["coordinates"]
    rings = F.when(kind == "Polygon", F.array(single)).when(kind == "MultiPolygon", many)
    point = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    return F.transform(rings, lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))


def contains(lat: Column, lon: Column, polygons: Column, holes: bool) -> Column:
    """In any of the polygons. With ``holes`` the rings after a polygon's first cut it out; without, any ring counts as inside."""

    def one(polygon: Column) -> Column:
        if not holes:
            return F.exists(polygon, lambda ring: in_ring(lat, lon, ring))
        inner = F.slice(polygon, F.lit(2), F.greatest(F.size(polygon) - 1, F.lit(0)))
        return (F.size(polygon) > 0) & in_ring(lat, lon, polygon[0]) & ~F.exists(inner, lambda ring: in_ring(lat, lon, ring))

    return F.exists(polygons, one)


def with_bounds(zones: DataFrame, polygons: str = "polygons") -> DataFrame:
    """Adds ``min_lat``, ``max_lat``, ``min_lon``, ``max_lon`` and the mean of all vertices, ``center_lat`` and ``center_lon`` (6 decimals)."""
    points = F.flatten(F.flatten(F.col(polygons)))
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    mean = lambda xs: F.round(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs), 6)
    return zones.withColumns({"min_lat": F.array_min(lats), "max_lat": F.array_max(lats), "min_lon": F.array_min(lons), "max_lon": F.array_max(lons), "center_lat": mean(lats), "center_lon": mean(lons)})


def union_bounds(zones: DataFrame, by: str) -> DataFrame:
    """The box around all zones of a group and its middle."""
    box = zones.groupBy(by).agg(F.min("min_lat").alias("min_lat"), F.max("max_lat").alias("max_lat"), F.min("min_lon").alias("min_lon"), F.max("max_lon").alias("max_lon"))
    return box.withColumn("mid_lat", F.round((F.col("min_lat") + F.col("max_lat")) / 2, 6)).withColumn("mid_lon", F.round((F.col("min_lon") + F.col("max_lon")) / 2, 6))


#: Quadtree cells that cover a zone at most (a box that fits badly may take a few more), and levels below the one of its box's size.
COVER, DEEPER, DEEPEST = 160, 6, 26


def crossed(boxes: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which of the edges (x1, y1, x2, y2) touch which of the closed boxes (x1, y1, x2, y2), by separating axes."""
    middle, half = (boxes[:, None, :2] + boxes[:, None, 2:]) / 2, (boxes[:, None, 2:] - boxes[:, None, :2]) / 2
    own, reach = (edges[None, :, :2] + edges[None, :, 2:]) / 2 - middle, np.abs(edges[None, :, 2:] - edges[None, :, :2]) / 2
    along = edges[None, :, 2:] - edges[None, :, :2]
    apart = (np.abs(own) > half + reach).any(axis=2)
    turned = np.abs(own[:, :, 0] * along[:, :, 1] - own[:, :, 1] * along[:, :, 0]) > half[:, :, 0] * np.abs(along[:, :, 1]) + half[:, :, 1] * np.abs(along[:, :, 0])
    return ~(apart | turned)


def _inside(x: float, y: float, polygons: list[list[np.ndarray]], holes: bool) -> bool:
    def ring(points: np.ndarray) -> bool:
        a, b = points, np.roll(points, 1, axis=0)
        over = (a[:, 1] > y) != (b[:, 1] > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            return bool((over & (x < (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0])).sum() % 2)

    return any((ring(p[0]) and not any(map(ring, p[1:]))) if holes else any(map(ring, p)) for p in polygons if p)


def covering(polygons: list[list[list[dict]]], holes: bool, most: int = COVER) -> list[tuple[int, int, int, bool]]:
    """(level, row, column, whole) of quadtree cells that cover a zone; a cell of level l is 360 / 2**l degrees wide.

    Cells that an edge touches are cut in four as long as there are few enough; cells without an edge are wholly in (``whole``) or dropped.
    """
    rings = [[np.array([(p["lon"], p["lat"]) for p in ring], np.float64).reshape(-1, 2) for ring in polygon or [] if ring] for polygon in polygons or []]
    every = [r for polygon in rings for r in polygon]
    if not every:
        return []
    edges = np.concatenate([np.concatenate((r, np.roll(r, 1, axis=0)), axis=1) for r in every])
    low, high = np.concatenate(every).min(axis=0), np.concatenate(every).max(axis=0)
    wide = max(float((high - low).max()), 1e-7)
    level = int(np.clip(np.floor(np.log2(360.0 / wide)), 0, DEEPEST))
    size = 360.0 / 2**level
    (c1, r1), (c2, r2) = np.floor(low / size).astype(int), np.floor(high / size).astype(int)
    open_, out = [(r, c, np.arange(len(edges))) for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)], []
    for deeper in range(DEEPER + 1):
        size, cut, grain = 360.0 / 2**level, [], 360.0 / 2**level * 1e-9
        for r, c, near in open_:
            box = np.array([[c * size - grain, r * size - grain, (c + 1) * size + grain, (r + 1) * size + grain]])
            mine = near[crossed(box, edges[near])[0]]
            if len(mine):
                cut.append((r, c, mine))
            elif _inside((c + 0.5) * size, (r + 0.5) * size, rings, holes):
                out.append((level, r, c, True))
        if deeper == DEEPER or level == DEEPEST or len(out) + 4 * len(cut) > most:
            return out + [(level, r, c, False) for r, c, _ in cut]
        open_ = [(2 * r + i, 2 * c + j, mine) for r, c, mine in cut for i in (0, 1) for j in (0, 1)]
        level += 1
    return out


def covers(zones: DataFrame, holes: bool = False) -> DataFrame:
    """``zone_id``, ``level``, ``cy``, ``cx``, ``whole``: the cells of every zone's ``covering``."""
    kind = dict(zones.dtypes)["zone_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                cells = covering(row["polygons"], holes)
                if cells:
                    columns = list(zip(*cells))
                    yield pa.RecordBatch.from_arrays([pa.array([row["zone_id"]] * len(cells), batch.schema.field("zone_id").type), *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.bool_()))]], names=["zone_id", "level", "cy", "cx", "whole"])

    return zones.select("zone_id", "polygons").mapInArrow(run, f"zone_id {kind}, level int, cy long, cx long, whole boolean")


def in_zone(points: DataFrame, zones: DataFrame, holes: bool = False) -> DataFrame:
    """``id``, ``zone_id`` of the first zone, by label and id, that contains a point.

    ``zones`` has ``zone_id``, ``label``, ``polygons``. Points and zones meet by quadtree cells of the levels that zones use, so a zone of any
    size is a bounded number of rows. A point in a cell that lies wholly in a zone is settled; only those in cells on an edge meet
    the polygon, joined by its id.
    """
    cells = cut(covers(zones, holes))
    levels = sorted(r["level"] for r in cells.select("level").distinct().collect())  # at most DEEPEST
    at = lambda level: F.struct(F.lit(level).alias("level"), F.floor(F.col("lat") / (360.0 / 2**level)).alias("cy"), F.floor(F.col("lon") / (360.0 / 2**level)).alias("cx"))
    placed = points.select("id", "lat", "lon", F.explode(F.array(*map(at, levels)) if levels else F.array().cast("array<struct<level:int,cy:bigint,cx:bigint>>")).alias("c")).select("id", "lat", "lon", "c.*")
    met = placed.join(cells, ["level", "cy", "cx"]).select("id", "lat", "lon", "zone_id", "whole")
    shapes = zones.select("zone_id", "label", "polygons")
    edge = met.where("NOT whole").join(shapes, "zone_id").where(contains(F.col("lat"), F.col("lon"), F.col("polygons"), holes))
    inside = met.where("whole").join(shapes.drop("polygons"), "zone_id").select("id", "label", "zone_id").unionByName(edge.select("id", "label", "zone_id"))
    return inside.groupBy("id").agg(F.min_by("zone_id", F.struct("label", "zone_id")).alias("zone_id"))


def nearest_within(points: DataFrame, places: DataFrame, within_m: float) -> DataFrame:
    """``id``, ``place_id``, ``distance_m`` of the nearest place (``place_id``, ``place_lat``, ``place_lon``) within a radius.

    Both meet by grid cells of the radius, a place in its own cell and the eight around it, whatever the number of places.
    """
    far = places.agg(F.max(F.abs("place_lat")).alias("m")).first()["m"] or 0.0
    high, wide = within_m / 110_000.0, within_m / (110_000.0 * max(0.01, math.cos(math.radians(min(89.0, far + 2 * within_m / 110_000.0)))))
    around = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    spread = places.select("place_id", "place_lat", "place_lon", around.alias("d")).select("place_id", "place_lat", "place_lon", (F.floor(F.col("place_lat") / high) + F.col("d.dy")).alias("cy"), (F.floor(F.col("place_lon") / wide) + F.col("d.dx")).alias("cx"))
    placed = points.select("id", "lat", "lon", F.floor(F.col("lat") / high).alias("cy"), F.floor(F.col("lon") / wide).alias("cx"))
    met = placed.join(spread, ["cy", "cx"]).withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))).where(F.col("distance_m") <= within_m)
    return met.groupBy("id").agg(F.min(F.struct("distance_m", "place_id")).alias("best")).select("id", "best.place_id", "best.distance_m")


def locate(points: DataFrame, zones: DataFrame, within_m: float = 1200.0, holes: bool = False, around: float | None = 0.015) -> DataFrame:
    """``id``, ``zone_id``, ``how`` (inside or near; both null where neither) of every point.

    A point in no zone goes to the nearest centre within the radius, if it lies in the box around all zones, widened by
    ``around`` degrees (None: anywhere).
    """
    zones = cut(with_bounds(zones))  # parsed and measured once
    inside = in_zone(points, zones, holes).withColumn("how", F.lit("inside"))
    rest = points.join(inside, "id", "left_anti")
    if around is not None:
        box = zones.agg(F.min("min_lat").alias("a"), F.max("max_lat").alias("b"), F.min("min_lon").alias("c"), F.max("max_lon").alias("d"))  # one row
        rest = rest.join(F.broadcast(box)).where(F.col("lat").between(F.col("a") - around, F.col("b") + around) & F.col("lon").between(F.col("c") - around, F.col("d") + around)).select("id", "lat", "lon")
    near = nearest_within(rest, zones.select(F.col("zone_id").alias("place_id"), F.col("center_lat").alias("place_lat"), F.col("center_lon").alias("place_lon")), within_m)
    found = inside.unionByName(near.select("id", F.col("place_id").alias("zone_id"), F.lit("near").alias("how")))
    return points.select("id").join(found, "id", "left")


def clip(points: DataFrame, inside, route: str = "route_id", seq: str = "seq") -> DataFrame:
    """``route``, ``piece``, ``seq``, ``lat``, ``lon`` of the stretches of routes of which a segment's start, middle or end lies inside.

    ``inside(lat, lon)`` is a column expression. A stretch is a run of such segments; it holds both ends of each.
    """
    order = Window.partitionBy(route).orderBy(seq)
    ends = points.withColumns({"lat2": F.lead("lat").over(order), "lon2": F.lead("lon").over(order), "seq2": F.lead(seq).over(order)}).where("lat2 IS NOT NULL")
    hit = inside(F.col("lat"), F.col("lon")) | inside(F.col("lat2"), F.col("lon2")) | inside((F.col("lat") + F.col("lat2")) / 2, (F.col("lon") + F.col("lon2")) / 2)
    flagged = ends.withColumn("hit", hit)
    starts = F.col("hit") & ~F.coalesce(F.lag("hit").over(order), F.lit(False))
    runs = flagged.withColumn("piece", F.sum(starts.cast("int")).over(order)).where("hit")
    first = runs.select(route, "piece", F.col(seq).alias(seq), "lat", "lon")
    last = runs.select(route, "piece", F.col("seq2").alias(seq), F.col("lat2").alias("lat"), F.col("lon2").alias("lon"))
    return first.unionByName(last).distinct()


def unique_slugs(rows: DataFrame, base: Column, code: Column, order: str, by: str) -> DataFrame:
    """Adds ``slug``, unique within ``by``: the base where it is free, else base-code, else base-code-2 and on, as the first that is free.

    Whether a slug is free depends on all before it, made ones included, so the rows of one ``by`` stream through a task in order;
    the task holds the slugs of one ``by``. An empty base is barrio-code, an empty code dup.
    """
    named = rows.withColumn("_base", F.when(base == "", F.concat(F.lit("barrio-"), F.when(code == "", "sin-codigo").otherwise(code))).otherwise(base))
    named = named.withColumn("_code", F.when(code == "", "dup").otherwise(code)).repartition(by).sortWithinPartitions(by, order)
    place, kept = [named.columns.index(c) for c in (by, "_base", "_code")], [c for c in named.columns if c not in ("_base", "_code")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, used, count = object(), set(), {}
        for batch in batches:
            slugs = []
            for group, own, extra in zip(*[batch.column(i).to_pylist() for i in place], strict=True):
                if group != last:
                    last, used, count = group, set(), {}
                slug = own if own not in used else f"{own}-{extra}"
                if slug in used:
                    i = count.get(slug, 2)
                    while f"{slug}-{i}" in used:
                        i += 1
                    count[slug] = i
                    slug = f"{slug}-{i}"
                used.add(slug)
                slugs.append(slug)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(slugs, pa.string())], names=[*kept, "slug"])

    kinds = dict(named.dtypes)
    return named.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", slug string")


def main_component(components: DataFrame) -> DataFrame:
    """``main``: the largest component, of equal sizes the smaller name; one row."""
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"))


def apart_pairs(points: DataFrame, components: DataFrame, radius_m: float) -> DataFrame:
    """The ``near_pairs`` of ``points`` (``id``, ``lat``, ``lon``) whose ends lie in different ``components`` (``node``, ``component``).

    One end is always outside the largest component, so only those points look around; points in no component are left out.
    """
    held = cut(points.join(components, points["id"] == components["node"]).select("id", "lat", "lon", "component"))
    minor = held.join(F.broadcast(main_component(components))).where("component <> main").drop("main")
    low = held.agg(F.max(F.abs("lat")).alias("m")).first()["m"] or 0.0
    high, wide = radius_m / 110_000.0, radius_m / (110_000.0 * max(0.01, math.cos(math.radians(min(89.0, low + 0.1)))))
    around = F.explode(F.array(*[F.struct((cell(F.col("lat"), high) + dy).alias("y"), (cell(F.col("lon"), wide) + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    spread = minor.select(F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("component").alias("c1"), around.alias("c")).select("id1", "lat1", "lon1", "c1", "c.y", "c.x")
    met = spread.join(held.select("id", "lat", "lon", "component", cell(F.col("lat"), high).alias("y"), cell(F.col("lon"), wide).alias("x")), ["y", "x"]).where("c1 <> component")
    first = F.col("id1") < F.col("id")
    at = lambda name: (F.when(first, F.col(name + "1")).otherwise(F.col(name)), F.when(first, F.col(name)).otherwise(F.col(name + "1")))
    (a, b), (lat1, lat2), (lon1, lon2) = at("id"), at("lat"), at("lon")
    return met.select(a.alias("a"), b.alias("b"), haversine_m(lat1, lon1, lat2, lon2).alias("distance_m")).where(F.col("distance_m") <= radius_m)


def bridges(components: DataFrame, pairs: DataFrame, most_nodes: int = 250, global_m: float = 8.0) -> DataFrame:
    """``a``, ``b``, ``distance_m`` of new edges between components (``node``, ``component``): from each small one the shortest of the
    near pairs that lead to the largest, and between any two the shortest of at most ``global_m``.

    ``pairs`` (``a``, ``b``, ``distance_m``) are the points within the longest bridge. Of equal sizes the smaller name is the largest.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    main = main_component(components)
    of = lambda key, name: components.select(F.col("node").alias(key), F.col("component").alias(name))
    met = pairs.join(of("a", "ca"), "a").join(of("b", "cb"), "b").where("ca <> cb").join(F.broadcast(main))
    best = F.min(F.struct("distance_m", "a", "b")).alias("w")
    minor = met.where((F.col("ca") == F.col("main")) | (F.col("cb") == F.col("main"))).withColumn("component", F.when(F.col("ca") == F.col("main"), F.col("cb")).otherwise(F.col("ca")))
    to_main = minor.join(sizes.where(F.col("n") <= most_nodes), "component").groupBy("component").agg(best).select("w.*")
    close = met.where(F.col("distance_m") <= global_m).groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(best).select("w.*")
    return to_main.unionByName(close).distinct().select("a", "b", "distance_m")


def road_graph(points: DataFrame, line: str = "route_id", seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Nodes (``node``, ``lat``, ``lon``) and edges (``a``, ``b``, ``distance_m``) of polylines.

    A node is a position to 6 decimals; steps of no length are left out, steps in both directions are one edge of its least length.
    """
    spot = points.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})
    spot = spot.withColumn("node", F.concat_ws(",", F.format_string("%.6f", "lat"), F.format_string("%.6f", "lon")))
    order = Window.partitionBy(line).orderBy(seq)
    steps = spot.select("node", "lat", "lon", F.lead("node").over(order).alias("to"), F.lead("lat").over(order).alias("lat2"), F.lead("lon").over(order).alias("lon2")).where(F.col("to").isNotNull() & (F.col("to") != F.col("node")))
    length = haversine_m(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2"))
    edges = steps.groupBy(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).agg(F.min(length).alias("distance_m"))
    return spot.select("node", "lat", "lon").distinct(), edges


def _nearest_of_all(points: DataFrame, places: DataFrame) -> DataFrame:
    """For the few points with no place within thousands of kilometres: every place, dealt over the tasks."""
    met = points.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31)))).join(places.withColumn("k", F.pmod(F.xxhash64("place_id"), F.lit(32)).cast("int")), "k")
    near = F.struct(haversine_m(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon")).alias("distance_m"), "place_id")
    return met.groupBy("id").agg(F.min(near).alias("best")).select("id", "best.place_id", "best.distance_m")


#: Places of one cell that all points of that cell may be compared with at first.
CROWDED = 32


def _crowd(places: DataFrame, within_m: float) -> int:
    """How many places the fullest cell of a radius has."""
    size = within_m / 110_000.0
    return places.groupBy(F.floor(F.col("place_lat") / size), F.floor(F.col("place_lon") / size)).count().agg(F.max("count")).first()[0] or 0


def nearest(points: DataFrame, places: DataFrame, first_m: float = 2_000.0) -> DataFrame:
    """``id``, ``place_id``, ``distance_m`` of the nearest place for every point with a position, however far; ties go to the smaller id.

    The radius begins at ``first_m``, or where places lie so densely that a cell of that size has more than ``CROWDED``, at a fourth of it
    and so on; it grows fourfold for the points that have found nothing, so most points meet only near places. Of places in one
    position only the smaller id counts. No places give no rows.
    """
    places, left = cut(places.groupBy("place_lat", "place_lon").agg(F.min("place_id").alias("place_id"))), points.select("id", "lat", "lon").where("lat IS NOT NULL AND lon IS NOT NULL")
    if places.isEmpty():
        return nearest_within(left, places, first_m)
    out, within = [], first_m
    while within > 4 and _crowd(places, within) > CROWDED:
        within /= 4
    while True:
        found = cut(nearest_within(left, places, within) if within < 5_000_000.0 else _nearest_of_all(left, places))
        out.append(found)
        left = cut(left.join(found, "id", "left_anti"))
        if left.isEmpty():
            break
        within *= 4
    return reduce(DataFrame.unionByName, out)


def matched_districts(features: DataFrame, towns: DataFrame) -> DataFrame:
    """``feature_id``, ``town_id`` of features that belong to a town by district code, by the beginning of their key, or by name.

    ``features`` has ``feature_id``, ``district``, ``key``, ``name``; ``towns`` ``town_id``, ``district``, ``code``, ``name``. Districts are padded to two digits, keys and codes
    keep their digits only, names are normalised. One equi-join a rule: keys meet codes by the lengths that codes have.
    """
    digits = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\D", "")
    padded = lambda c: F.when(F.length(F.coalesce(c, F.lit(""))) >= 2, c).otherwise(F.lpad(F.coalesce(c, F.lit("")), 2, "0"))
    own = towns.select("town_id", padded(F.col("district").cast("string")).alias("district"), digits(F.col("code").cast("string")).alias("code"), normalize(F.col("name")).alias("name"))
    given = features.select("feature_id", padded(F.col("district").cast("string")).alias("district"), digits(F.col("key").cast("string")).alias("key"), normalize(F.col("name")).alias("name"))
    begin = given.select("feature_id", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("key"), F.lit(1))), lambda i: F.substring(F.col("key"), F.lit(1), i))).alias("code")).where("code <> ''")
    pairs = [given.join(own, "district"), begin.join(own.where("code <> ''"), "code"), given.join(own, "name")]
    return reduce(DataFrame.unionByName, [p.select("feature_id", "town_id") for p in pairs]).distinct()
