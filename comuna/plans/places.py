"""Queries of zones, routes, transit files and naming rules."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, numbers, rules, text, urls
from ..functions.text import ACCENTED, BASE
from ..operators import collection, graph, zones
from ..sources.files import transit_lines
from .queries import _PEOPLE_SQL, _POINTS_SQL, _SHAPES_SQL, _haversine_sql, _people, _points
from .registry import ORACLE_SQL, query
from .tables import EVENTS_NOW, latitude, longitude, table

_LAT = "-25.38 + CAST((({k}) * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19"
_LON = "-57.68 + CAST((({k}) * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19"
_SLUG = "lower(regexp_replace(regexp_replace(regexp_replace(translate({x}, '" + ACCENTED + "', '" + BASE + "'), '[̀-ͯ]', '', 'g'), '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))"
_CENTERS_SQL = f"SELECT n_nationkey AS zone_id, n_name AS label, n_regionkey, round({_LAT.format(k='n_nationkey * 37 + 5')}, 6) AS clat, round({_LON.format(k='n_nationkey * 37 + 5')}, 6) AS clon FROM nation"


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    """A square with a square hole around every town, as GeoJSON text, and what it parses to."""
    key = F.col("n_nationkey").cast("long") * 37 + 5
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("label"), "n_regionkey", F.round(latitude(key), 6).alias("clat"), F.round(longitude(key), 6).alias("clon"))
    ring = lambda d: F.array(*[F.array(F.round(F.col("clon") + x * d, 6), F.round(F.col("clat") + y * d, 6)) for x, y in ((-1, -1), (1, -1), (1, 1), (-1, 1))])
    shape = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring(0.02), ring(0.005)).alias("coordinates")).alias("geometry"))
    return rows.withColumn("geojson", F.to_json(shape)).withColumn("polygons", zones.parse_geometry(F.col("geojson")))


@query(f"""SELECT zone_id, round(clat - 0.02, 6) AS min_lat, round(clat + 0.02, 6) AS max_lat, round(clon - 0.02, 6) AS min_lon, round(clon + 0.02, 6) AS max_lon, round(clat, 5) AS center_lat, round(clon, 5) AS center_lon FROM ({_CENTERS_SQL})""")
def geometry_bounds(spark, sf):
    found = zones.with_bounds(_zones(spark, sf))
    return found.select("zone_id", "min_lat", "max_lat", "min_lon", "max_lon", F.round("center_lat", 5).alias("center_lat"), F.round("center_lon", 5).alias("center_lon"))


@query(f"""SELECT n_regionkey, min(round(clat - 0.02, 6)) AS min_lat, max(round(clat + 0.02, 6)) AS max_lat, min(round(clon - 0.02, 6)) AS min_lon, max(round(clon + 0.02, 6)) AS max_lon FROM ({_CENTERS_SQL}) GROUP BY 1""")
def bounds_union(spark, sf):
    return zones.union_bounds(zones.with_bounds(_zones(spark, sf)), "n_regionkey").drop("mid_lat", "mid_lon")


def _locate_sql(within: int, holes: bool, around: float | None) -> str:
    inside = "abs(lat - clat) < 0.02 AND abs(lon - clon) < 0.02" + (" AND NOT (abs(lat - clat) < 0.005 AND abs(lon - clon) < 0.005)" if holes else "")
    box = f"lat BETWEEN (SELECT min(clat) - 0.02 - {around} FROM z) AND (SELECT max(clat) + 0.02 + {around} FROM z) AND lon BETWEEN (SELECT min(clon) - 0.02 - {around} FROM z) AND (SELECT max(clon) + 0.02 + {around} FROM z)" if around is not None else "true"
    return f"""WITH z AS ({_CENTERS_SQL}), p AS ({_PEOPLE_SQL}), i AS (SELECT id, arg_min(zone_id, (label, zone_id)) AS zone_id, 'inside' AS how FROM p, z WHERE {inside} GROUP BY 1),
d AS (SELECT id, zone_id, {_haversine_sql('lat', 'lon', 'clat', 'clon')} AS m FROM p, z WHERE id NOT IN (SELECT id FROM i) AND {box}), n AS (SELECT id, arg_min(zone_id, (m, zone_id)) AS zone_id, 'near' AS how FROM d WHERE m <= {within} GROUP BY 1)
SELECT p.id, u.zone_id, u.how FROM p LEFT JOIN (SELECT * FROM i UNION ALL SELECT * FROM n) u ON u.id = p.id"""


@query(_locate_sql(1200, False, 0.015))
def zone_of_report(spark, sf):
    return zones.locate(_people(spark, sf), _zones(spark, sf).select("zone_id", "label", "polygons"), 1200.0)


@query(_locate_sql(4500, True, None))
def zone_of_vehicle(spark, sf):
    """The collector's rule: holes are outside, and the nearest zone may be 4500 m away."""
    return zones.locate(_people(spark, sf), _zones(spark, sf).select("zone_id", "label", "polygons"), 4500.0, holes=True, around=None)


_BOX = (-25.33, -25.24, -57.65, -57.54)


@query(f"""WITH s AS (SELECT *, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(seq) OVER w AS seq2 FROM ({_POINTS_SQL}) WINDOW w AS (PARTITION BY route_id ORDER BY seq)),
h AS (SELECT *, (lat BETWEEN {_BOX[0]} AND {_BOX[1]} AND lon BETWEEN {_BOX[2]} AND {_BOX[3]}) OR (lat2 BETWEEN {_BOX[0]} AND {_BOX[1]} AND lon2 BETWEEN {_BOX[2]} AND {_BOX[3]}) OR ((lat + lat2) / 2 BETWEEN {_BOX[0]} AND {_BOX[1]} AND (lon + lon2) / 2 BETWEEN {_BOX[2]} AND {_BOX[3]}) AS hit FROM s WHERE lat2 IS NOT NULL),
l AS (SELECT *, CASE WHEN hit AND NOT coalesce(lag(hit) OVER w, false) THEN 1 ELSE 0 END AS starts FROM h WINDOW w AS (PARTITION BY route_id ORDER BY seq)), r AS (SELECT *, sum(starts) OVER (PARTITION BY route_id ORDER BY seq) AS piece FROM l)
SELECT route_id, CAST(piece AS BIGINT) AS piece, seq FROM r WHERE hit UNION SELECT route_id, CAST(piece AS BIGINT), seq2 FROM r WHERE hit""")
def route_clip(spark, sf):
    found = zones.clip(_points(spark, sf), lambda lat, lon: geo.in_box(lat, lon, _BOX))
    return found.select("route_id", "piece", "seq")


@query(f"""SELECT route_id, count(*) AS points, round(max(cum_m), 1) AS longest_m, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS seqs FROM ({_SHAPES_SQL}) GROUP BY 1""")
def route_max_distance(spark, sf):
    lists = collection.shape_metrics(_points(spark, sf)).groupBy("route_id").agg(F.max("cum_m").alias("m"), F.sort_array(F.collect_list(F.struct("seq", "lat", "lon"))).alias("points"))
    return lists.select("route_id", F.size("points").cast("bigint").alias("points"), F.round("m", 1).alias("longest_m"), F.array_join(F.transform("points", lambda p: p["seq"].cast("string")), ",").alias("seqs"))


_GRAPH_SQL = f"""WITH p AS (SELECT *, printf('%.6f', round(lat, 6)) || ',' || printf('%.6f', round(lon, 6)) AS node FROM ({_POINTS_SQL})), s AS (SELECT node, lat, lon, lead(node) OVER w AS n2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM p WINDOW w AS (PARTITION BY route_id ORDER BY seq))
SELECT least(node, n2) AS a, greatest(node, n2) AS b, round(min({_haversine_sql('round(lat, 6)', 'round(lon, 6)', 'round(lat2, 6)', 'round(lon2, 6)')}), 2) AS distance_m FROM s WHERE n2 IS NOT NULL AND n2 <> node GROUP BY 1, 2"""


@query(_GRAPH_SQL)
def road_edges(spark, sf):
    return zones.road_graph(_points(spark, sf))[1].select("a", "b", F.round("distance_m", 2).alias("distance_m"))


_STOPS_SQL = f"SELECT s_suppkey AS id, {_LAT.format(k='s_suppkey')} AS lat, {_LON.format(k='s_suppkey')} AS lon FROM supplier"


def _stops(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(key.alias("id"), latitude(key).alias("lat"), longitude(key).alias("lon"))


@query(f"""WITH RECURSIVE p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM ({_STOPS_SQL}) a JOIN ({_STOPS_SQL}) b ON a.id < b.id AND abs(a.lat - b.lat) < 0.035 AND abs(a.lon - b.lon) < 0.035),
e AS (SELECT a, b FROM p WHERE m <= 1700), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS node, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node),
c AS MATERIALIZED (SELECT node, min(label) AS component FROM r GROUP BY 1), s AS MATERIALIZED (SELECT component, count(*) AS n FROM c GROUP BY 1), main AS (SELECT arg_max(component, (n, -component)) AS main FROM s),
t AS (SELECT a, b, m, x.component AS ca, y.component AS cb FROM p JOIN c x ON x.node = a JOIN c y ON y.node = b WHERE x.component <> y.component AND m <= 3000),
k AS (SELECT CASE WHEN ca = main THEN cb ELSE ca END AS component, a, b, m FROM t, main WHERE ca = main OR cb = main),
f AS (SELECT arg_min((a, b, m), (m, a, b)) AS w FROM k JOIN s USING (component) WHERE n <= 250 GROUP BY component UNION ALL SELECT arg_min((a, b, m), (m, a, b)) FROM t WHERE m <= 1900 GROUP BY least(ca, cb), greatest(ca, cb))
SELECT DISTINCT w[1] AS a, w[2] AS b, round(w[3], 2) AS distance_m FROM f""")
def component_bridges(spark, sf):
    points = _stops(spark, sf)
    parts = graph.cut(graph.near_components(points, 1700.0))
    return zones.bridges(parts, zones.apart_pairs(points, parts, 3000.0), 250, 1900.0).select("a", "b", F.round("distance_m", 2).alias("distance_m"))


# --- collection --------------------------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT l_orderkey AS run_id, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS first_stop, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) AS last_stop FROM lineitem GROUP BY 1)
SELECT run_id, a.p_name AS first_name, b.p_name AS last_name FROM o JOIN part a ON a.p_partkey = first_stop JOIN part b ON b.p_partkey = last_stop""")
def first_last_stop(spark, sf):
    at = F.struct("l_shipdate", "l_linenumber", "l_partkey")
    ends = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.min_by("l_partkey", at).alias("a"), F.max_by("l_partkey", at).alias("b"))
    name = lambda key, alias: table(spark, sf, "part").select(F.col("p_partkey").alias(key), F.col("p_name").alias(alias))
    return ends.join(name("a", "first_name"), "a").join(name("b", "last_name"), "b").select("run_id", "first_name", "last_name")


_LATEST_SQL = """WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events), s AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN floor(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / (count(*) - 1) / 3600000000.0 * 10 + 0.5) / 10 END AS mean_hours FROM r WHERE rn <= 20 GROUP BY 1),
c AS (SELECT c_custkey AS user_id, coalesce(n, 0) AS n, mean_hours, greatest(3.5, floor(coalesce(mean_hours, 0) / 24 * 10 + 0.5) / 10) AS cadence_days FROM customer LEFT JOIN s ON user_id = c_custkey)
SELECT *, CASE WHEN n = 0 THEN 0 ELSE CAST(least(greatest(floor(30 / cadence_days + 0.5), 1), 8) AS BIGINT) END AS monthly_passes FROM c"""


@query(_LATEST_SQL)
def cadence_of_latest(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return collection.cadence(keys, table(spark, sf, "events"), "user_id", "ts", 20)


_RECENT_SQL = """WITH e AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 5 DAY AND ts <= TIMESTAMP '2024-01-25'), k AS (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM e GROUP BY 1, 2), b AS (SELECT user_id, arg_max(event_type, (n, seen)) AS t FROM k GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(t, c_mktsegment) AS route FROM customer LEFT JOIN b ON user_id = c_custkey"""


@query(_RECENT_SQL)
def recent_route(spark, sf):
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("first_route"))
    return collection.recent_value(keys, table(spark, sf, "events"), "user_id", "event_type", "ts", EVENTS_NOW, 5, "first_route").withColumnRenamed("event_type", "route")


_CAPPED_SQL = """WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events WHERE ts < TIMESTAMP '2024-01-25')
SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-01-18') AS last_7_days, count(*) FILTER (ts >= TIMESTAMP '2023-12-26') AS last_30_days, count(*) FILTER (ts >= TIMESTAMP '2023-01-25') AS last_365_days FROM r WHERE rn <= 40 GROUP BY 1"""


@query(_CAPPED_SQL)
def capped_rolling_counts(spark, sf):
    past = collection.capped_history(table(spark, sf, "events"), "user_id", "ts", EVENTS_NOW, 40, 0).where("is_past")
    return collection.rolling_counts(past, "user_id", "ts", EVENTS_NOW)


@query(f"""SELECT l.user_id, l.n, l.cadence_days, l.monthly_passes, h.hour, r.route, coalesce(c.last_7_days, 0) AS last_7_days, coalesce(c.last_30_days, 0) AS last_30_days, n.next_at
FROM ({_LATEST_SQL}) l LEFT JOIN ({ORACLE_SQL['habitual_hour']}) h USING (user_id) LEFT JOIN ({_RECENT_SQL}) r USING (user_id) LEFT JOIN ({_CAPPED_SQL}) c USING (user_id)
LEFT JOIN (SELECT user_id, CAST(min(ts) AS VARCHAR) AS next_at FROM events WHERE ts >= TIMESTAMP '2024-01-25' GROUP BY 1) n USING (user_id)""")
def collection_overview(spark, sf):
    """All figures of a place at once: cadence, usual hour, usual route, passes, next pass."""
    events, keys = table(spark, sf, "events"), table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("first_route"))
    cadence = collection.cadence(keys.select("user_id"), events, "user_id", "ts", 20).drop("mean_hours")
    following = events.where(F.col("ts").cast("timestamp") >= F.lit(EVENTS_NOW)).groupBy("user_id").agg(F.min("ts").cast("string").alias("next_at"))
    parts = [collection.habitual_hour(events, "user_id", "ts"), recent_route(spark, sf), capped_rolling_counts(spark, sf).drop("last_365_days"), following]
    for part in parts:
        cadence = cadence.join(part, "user_id", "left")
    return cadence.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("last_7_days", "last_30_days")})


@query("""SELECT o_orderkey AS run_id, l_linenumber AS place, lpad(CAST((o_orderkey % 24 * 60 + l_linenumber * 37) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((o_orderkey % 24 * 60 + l_linenumber * 37) % 60 AS VARCHAR), 2, '0') || ':00' AS arrival_time FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey""")
def run_stop_times(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 24 * 60).alias("start_min"))
    stops = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route_id"), F.col("l_linenumber").alias("place")).distinct().withColumn("arrival_min", F.col("place") * 37)
    return collection.run_events(runs, stops).select("run_id", "place", "arrival_time")


@query("""SELECT o_orderkey AS run_id, c_name AS truck, n_name AS route FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE TIMESTAMP '1996-01-01' BETWEEN o_orderdate AND o_orderdate + to_days(CAST(o_orderkey % 30 AS INT))""")
def runs_active_at(spark, sf):
    now, days = F.lit(dt.datetime(1996, 1, 1)).cast("timestamp_ntz"), (F.col("o_orderkey") % 30).cast("int")
    runs = table(spark, sf, "orders").where(now.between(F.col("o_orderdate").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(days)))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("truck"), F.col("c_nationkey").alias("n_nationkey"))
    return runs.join(people, "o_custkey").join(table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("route")), "n_nationkey").select(F.col("o_orderkey").alias("run_id"), "truck", "route")


@query("""SELECT event_id, CAST(ts + INTERVAL 3 HOUR AS VARCHAR) AS utc_at, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_day, strftime(CAST(ts - INTERVAL 3 HOUR AS DATE) + 5, '%Y-%m-%d') AS later_day, lower(dayname(ts - INTERVAL 3 HOUR)) AS day_name FROM events""")
def local_times(spark, sf):
    """Local clock read as UTC and UTC read as local clock; the town's offset in January 2024 is three hours."""
    at = F.col("ts").cast("timestamp")
    day = F.to_date(F.from_utc_timestamp(at, collection.ZONE))
    return table(spark, sf, "events").select("event_id", F.to_utc_timestamp(at, collection.ZONE).cast("string").alias("utc_at"), day.cast("string").alias("local_day"), F.date_add(day, 5).cast("string").alias("later_day"), F.lower(F.date_format(day, "EEEE")).alias("day_name"))


@query(f"""SELECT route_id, seq, round(least(greatest(cum_m - 500, 0), (SELECT max(cum_m) FROM ({_SHAPES_SQL}) t WHERE t.route_id = s.route_id)), 1) AS behind_m FROM ({_SHAPES_SQL}) s""")
def distance_behind(spark, sf):
    """500 m behind every point of a route, held inside the route."""
    shapes = collection.shape_metrics(_points(spark, sf))
    ends = shapes.groupBy("route_id").agg(F.max("cum_m").alias("end_m"))
    return shapes.join(ends, "route_id").select("route_id", "seq", F.round(F.least(F.greatest(F.col("cum_m") - 500, F.lit(0.0)), F.col("end_m")), 1).alias("behind_m"))


# --- transit files -----------------------------------------------------------------------------------------------------

#: The files of a transit feed and their columns.
TRANSIT_FILES = {
    "agency": "agency_id agency_name agency_url agency_timezone agency_lang",
    "stops": "stop_id stop_name stop_lat stop_lon stop_desc zone_id location_type",
    "routes": "route_id agency_id route_short_name route_long_name route_desc route_type route_color route_text_color",
    "trips": "route_id service_id trip_id trip_headsign direction_id shape_id",
    "stop_times": "trip_id arrival_time departure_time stop_id stop_sequence",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
    "feed_info": "feed_publisher_name feed_publisher_url feed_lang feed_start_date feed_end_date feed_version feed_contact_email",
}
_MINUTES = "lpad(CAST(({m}) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(({m}) % 60 AS VARCHAR), 2, '0') || ':00'"
_FILES_SQL = {
    "agency": "SELECT 'r' || r_regionkey, r_name, 'https://r' || r_regionkey || '.py', 'America/Asuncion', 'es' FROM region",
    "stops": "SELECT s_suppkey, s_name, CAST(s_suppkey % 90 AS VARCHAR), CAST(s_suppkey % 180 AS VARCHAR), '', s_nationkey, 0 FROM supplier",
    "routes": "SELECT n_nationkey, 'r' || n_regionkey, upper(left(n_name, 3)), n_name, '', 3, '2E7D32', 'FFFFFF' FROM nation",
    "trips": "SELECT s_nationkey, 's' || s_nationkey % 3, s_suppkey, s_name, 0, s_nationkey FROM supplier",
    "stop_times": f"SELECT o_orderkey, {_MINUTES.format(m='o_orderkey % 24 * 60 + l_linenumber * 37')}, {_MINUTES.format(m='o_orderkey % 24 * 60 + l_linenumber * 37 + 3')}, o_custkey, l_linenumber FROM orders JOIN (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) ON l_orderkey = o_orderkey",
    "calendar": "SELECT 's' || k, " + ", ".join(f"CASE WHEN k = {i % 3} AND {i} < 6 THEN 1 ELSE 0 END" for i in range(7)) + ", '20240101', '20241231' FROM (SELECT DISTINCT s_nationkey % 3 AS k FROM supplier)",
    "shapes": "SELECT user_id, CAST(event_id % 90 AS VARCHAR), CAST(event_id % 180 AS VARCHAR), row_number() OVER (PARTITION BY user_id ORDER BY ts) FROM events",
    "feed_info": "SELECT 'Municipio', 'https://municipio.py', 'es', strftime(min(ts), '%Y%m%d'), strftime(max(ts), '%Y%m%d'), '1', 'datos@municipio.py' FROM events",
}


def transit_feed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The eight files of a transit feed from the service plan's tables, with their fixed columns."""
    t = lambda name: table(spark, sf, name)
    named = lambda df, name, *columns: df.select(*[c.alias(n) for c, n in zip(columns, TRANSIT_FILES[name].split(), strict=True)])
    c, lit, words = F.col, F.lit, lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    stop_times = run_stop_times(spark, sf).join(t("orders").select(c("o_orderkey").alias("run_id"), "o_custkey"), "run_id")
    minute = numbers.to_minutes(c("arrival_time"))
    days = [F.when((c("k") == i % 3) & lit(i < 6), 1).otherwise(0) for i in range(7)]
    key = lambda column, format_: F.date_format(column, format_)
    return {
        "agency": named(t("region"), "agency", words("r", c("r_regionkey")), c("r_name"), words("https://r", c("r_regionkey"), ".py"), lit("America/Asuncion"), lit("es")),
        "stops": named(t("supplier"), "stops", c("s_suppkey"), c("s_name"), (c("s_suppkey") % 90).cast("string"), (c("s_suppkey") % 180).cast("string"), lit(""), c("s_nationkey"), lit(0)),
        "routes": named(t("nation"), "routes", c("n_nationkey"), words("r", c("n_regionkey")), F.upper(F.left("n_name", lit(3))), c("n_name"), lit(""), lit(3), lit("2E7D32"), lit("FFFFFF")),
        "trips": named(t("supplier"), "trips", c("s_nationkey"), words("s", c("s_nationkey") % 3), c("s_suppkey"), c("s_name"), lit(0), c("s_nationkey")),
        "stop_times": named(stop_times, "stop_times", c("run_id"), c("arrival_time"), numbers.to_time(minute + 3), c("o_custkey"), c("place")),
        "calendar": named(t("supplier").select((c("s_nationkey") % 3).alias("k")).distinct(), "calendar", words("s", c("k")), *days, lit("20240101"), lit("20241231")),
        "shapes": named(_points_of_events(t("events")), "shapes", c("user_id"), (c("event_id") % 90).cast("string"), (c("event_id") % 180).cast("string"), c("seq")),
        "feed_info": named(t("events").agg(F.min("ts").alias("a"), F.max("ts").alias("b")), "feed_info", lit("Municipio"), lit("https://municipio.py"), lit("es"), key("a", "yyyyMMdd"), key("b", "yyyyMMdd"), lit("1"), lit("datos@municipio.py")),
    }


def _points_of_events(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    return events.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")))


@query(" UNION ALL ".join(f"SELECT '{n}' AS file, concat_ws(',', {', '.join(f'CAST(q.c{i} AS VARCHAR)' for i in range(len(TRANSIT_FILES[n].split())))}) AS line FROM ({s}) q({', '.join(f'c{i}' for i in range(len(TRANSIT_FILES[n].split())))})" for n, s in _FILES_SQL.items()))
def transit_files(spark, sf):
    out = None
    for name, rows in transit_feed(spark, sf).items():
        lines = transit_lines(rows).select(F.lit(name).alias("file"), "line")
        out = lines if out is None else out.unionByName(lines)
    return out


@query("""SELECT user_id, '{"id":"v' || user_id || '","vehicle":{"trip":"' || event_type || '","at":"' || strftime(ts, '%Y%m%d') || '","n":' || event_id || '}}' AS json FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1""")
def realtime_feed(spark, sf):
    """The latest position of every vehicle as an entity of a realtime feed."""
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_type", "event_id")).alias("e"))
    entity = F.struct(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("id"), F.struct(F.col("e.event_type").alias("trip"), F.date_format("e.ts", "yyyyMMdd").alias("at"), F.col("e.event_id").alias("n")).alias("vehicle"))
    return last.select("user_id", F.to_json(entity).alias("json"))


# --- naming and formatting rules ---------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT p_partkey, p_size, {_SLUG.format(x='p_type')} AS base, CAST(p_size % 4 AS VARCHAR) AS code, p_size % 3 AS town FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY town, base ORDER BY p_partkey) AS n FROM b),
k AS (SELECT *, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY town, base, code ORDER BY p_partkey) AS k FROM n)
SELECT p_partkey, CASE WHEN n = 1 THEN base WHEN k = 1 THEN base || '-' || code ELSE base || '-' || code || '-' || CAST(k AS BIGINT) END AS slug FROM k""")
def unique_slugs(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_type", (F.col("p_size") % 4).cast("string").alias("code"), (F.col("p_size") % 3).alias("town"))
    return zones.unique_slugs(rows, text.slug(F.col("p_type")), F.col("code"), "p_partkey", "town").select("p_partkey", "slug")


@query("""SELECT c_custkey, CASE WHEN length(c_name) > 10 THEN rtrim(left(c_name, 9)) || '...' ELSE c_name END AS longer, CASE WHEN length(c_name) > 10 THEN rtrim(left(c_name, 7)) || '...' ELSE c_name END AS shorter,
upper(trim(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g'))) AS words, regexp_replace(regexp_replace(c_name, '[^a-zA-Z0-9._-]+', '-', 'g'), '-+', '-', 'g') AS file_name,
lower(replace(c_name, '#', '@')) || '.py' AS email, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS filled, lower(regexp_replace(c_name, '[^a-zA-Z0-9]+', '', 'g')) AS label_key,
CASE WHEN c_custkey * 700 < 1024 THEN c_custkey * 700 || ' B' WHEN c_custkey * 700 < 1048576 THEN regexp_replace(printf('%.1f', floor(c_custkey * 700 / 102.4 + 0.5) / 10), '\\.0$', '') || ' KB' ELSE regexp_replace(printf('%.1f', floor(c_custkey * 700 / 1024 / 102.4 + 0.5) / 10), '\\.0$', '') || ' MB' END AS size,
CASE WHEN c_custkey * 37 >= 3600 THEN c_custkey * 37 // 3600 || 'h ' || c_custkey * 37 % 3600 // 60 || 'm' WHEN c_custkey * 37 >= 60 THEN c_custkey * 37 // 60 || 'm ' || c_custkey * 37 % 60 || 's' ELSE c_custkey * 37 || 's' END AS took,
upper(left(regexp_replace(lower(c_mktsegment), '[^a-z0-9]', '', 'g'), 3)) || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS code, round(c_acctbal, 2) AS number FROM customer""")
def naming_rules(spark, sf):
    c = F.col
    return table(spark, sf, "customer").select(
        "c_custkey", rules.shortened(c("c_name"), 10).alias("longer"), text.truncate(c("c_name"), 10).alias("shorter"), rules.upper_words(c("c_name")).alias("words"), rules.file_name(c("c_name")).alias("file_name"),
        rules.email(F.concat(F.lit(" "), F.replace(c("c_name"), F.lit("#"), F.lit("@")), F.lit(".PY "))).alias("email"), rules.first_filled(F.when(c("c_custkey") % 2 == 0, c("c_name")).otherwise(" "), c("c_mktsegment")).alias("filled"),
        rules.label_key(c("c_name")).alias("label_key"), rules.byte_size(c("c_custkey") * 700).alias("size"), rules.duration(c("c_custkey") * 37).alias("took"), rules.route_code(c("c_custkey") % 100, c("c_mktsegment")).alias("code"),
        F.round(rules.number(F.lit("x"), c("c_acctbal").cast("string")), 2).alias("number"),
    )


@query("""SELECT n_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM nation""")
def name_hash(spark, sf):
    return table(spark, sf, "nation").select("n_name", collection.name_hash(F.col("n_name")).alias("hash"))


@query("""WITH f AS (SELECT n_nationkey AS zone_id, lower(regexp_replace(n_name, '[^a-zA-Z0-9]+', '', 'g')) AS k FROM nation), z AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN ' ' || lower(n_name) || '.' ELSE CAST(s_suppkey AS VARCHAR) END AS label FROM supplier JOIN nation ON n_nationkey = s_nationkey)
SELECT s_suppkey, zone_id FROM z LEFT JOIN f ON k = lower(regexp_replace(label, '[^a-zA-Z0-9]+', '', 'g'))""")
def label_match(spark, sf):
    towns = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    label = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit(" "), F.lower("n_name"), F.lit("."))).otherwise(F.col("s_suppkey").cast("string"))
    rows = table(spark, sf, "supplier").join(towns, "s_nationkey").select("s_suppkey", rules.label_key(label).alias("k"))
    return rows.join(towns.select(F.col("s_nationkey").alias("zone_id"), rules.label_key(F.col("n_name")).alias("k")), "k", "left").select("s_suppkey", "zone_id")


@query("""SELECT n_nationkey, r_regionkey FROM nation, region WHERE n_regionkey = r_regionkey OR starts_with(CAST(n_nationkey AS VARCHAR), CAST(r_regionkey AS VARCHAR)) OR left(lower(n_name), 1) = left(lower(r_name), 1)""")
def municipality_features(spark, sf):
    """Features meet towns by code, by the code's beginning or by name: one equi-join for each, and the union without repeats."""
    towns, places = table(spark, sf, "nation").select("n_nationkey", "n_regionkey", "n_name"), table(spark, sf, "region").select("r_regionkey", "r_name")
    code = towns.withColumn("r_regionkey", F.col("n_regionkey"))
    digits = F.col("n_nationkey").cast("string")
    begin = towns.withColumn("r_regionkey", F.explode(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, F.lit(1), i).cast("int"))))
    name = towns.withColumn("k", F.left(text.normalize(F.col("n_name")), F.lit(1))).join(places.withColumn("k", F.left(text.normalize(F.col("r_name")), F.lit(1))), "k").select("n_nationkey", "r_regionkey")
    met = code.select("n_nationkey", "r_regionkey").unionByName(begin.select("n_nationkey", "r_regionkey")).join(places.select("r_regionkey"), "r_regionkey", "left_semi")
    return met.unionByName(name).select("n_nationkey", "r_regionkey").distinct()
