"""The registered queries, each with its SQL twin where SQL can say it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, numbers, spanish, text, urls
from ..operators import activity, collection, graph, incidents, retrieval, vectors, zones
from ..sources.files import transit_lines
from . import city, dashboards  # noqa: F401  register their queries
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from .tables import COUNTED_SQL, EVENTS_NOW, NOW, REPORTS_SQL, SCORED_SQL, confirmations, latitude, longitude, reports, table

def scored(spark: SparkSession, sf: str) -> DataFrame:
    rows = incidents.with_counts(reports(spark, sf), confirmations(spark, sf))
    rows = rows.withColumn("priority_score", incidents.priority_score(F.col("severity"), F.col("kind"), F.lit(1), F.col("confirmations"), F.col("created_at"), NOW))
    return rows.withColumn("priority_band", incidents.priority_band(F.col("priority_score")))


# --- incidents ---------------------------------------------------------------------------------------------------------


@query(f"SELECT id, status, kind, severity, confirmations, priority_score, priority_band FROM ({SCORED_SQL}) ORDER BY priority_score DESC, confirmations DESC, created_at DESC, id LIMIT 8")
def priority_top(spark, sf):
    best = incidents.top(scored(spark, sf), F.desc("priority_score"), F.desc("confirmations"), F.desc("created_at"), F.col("id"))
    return best.select("id", "status", "kind", "severity", "confirmations", "priority_score", "priority_band")


@query(f"SELECT id, priority_score, priority_band FROM ({SCORED_SQL})")
def priority_score(spark, sf):
    return scored(spark, sf).select("id", "priority_score", "priority_band")


_BAND_COUNTS = ", ".join(f"count(*) FILTER (priority_band = '{b}'{{0}}) AS priority_{b}" for b in incidents.BANDS)
_STATUS_COUNTS = ", ".join(f"count(*) FILTER (status = '{s}') AS status_{s}" for s in incidents.STATUSES)
_OPEN = "status NOT IN ('resuelto', 'descartado')"


@query(f"SELECT count(*) AS total, count(*) FILTER ({_OPEN}) AS open, {_BAND_COUNTS.format('')}, {_STATUS_COUNTS} FROM ({SCORED_SQL})")
def priority_summary(spark, sf):
    return incidents.summary(scored(spark, sf))


@query(f"SELECT count(*) AS total, count(*) FILTER ({_OPEN}) AS open, {_BAND_COUNTS.format(' AND ' + _OPEN)}, {_STATUS_COUNTS} FROM ({SCORED_SQL})")
def incident_summary(spark, sf):
    return incidents.summary(scored(spark, sf), open_priorities_only=True)


@query(f"""SELECT id, n_name AS municipality, confirmations FROM ({COUNTED_SQL}) r JOIN customer ON c_custkey = reporter JOIN nation ON n_nationkey = c_nationkey
WHERE status = 'nuevo' AND severity IN ('alta', 'media') AND n_regionkey = 1""")
def report_list_filtered(spark, sf):
    rows = incidents.with_counts(incidents.filtered(reports(spark, sf), status="nuevo", severity=["alta", "media"], kind=None), confirmations(spark, sf))
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("reporter"), "c_nationkey")
    towns = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("municipality"))
    return rows.join(people, "reporter").join(towns, "c_nationkey").select("id", "municipality", "confirmations")


@query(f"""SELECT id, impact_score, risk_score, CASE WHEN impact_score >= 70 THEN 'alta' WHEN impact_score >= 40 THEN 'media' ELSE 'baja' END AS impact_level,
CASE WHEN risk_score >= 70 THEN 'alta' WHEN risk_score >= 40 THEN 'media' ELSE 'baja' END AS risk_level FROM (
SELECT id, CAST(least(14 + confirmations * 18, 100) AS BIGINT) AS impact_score, CAST(least(CASE severity WHEN 'alta' THEN 58 WHEN 'media' THEN 36 ELSE 18 END + CASE kind WHEN 'bache_aislado' THEN 10 WHEN 'conjunto_de_baches' THEN 18 ELSE 28 END, 100) AS BIGINT) AS risk_score FROM ({COUNTED_SQL}))""")
def risk_impact_levels(spark, sf):
    rows = scored(spark, sf).withColumn("impact_score", incidents.impact_score(F.lit(1), F.col("confirmations"))).withColumn("risk_score", incidents.risk_score(F.col("severity"), F.col("kind")))
    return rows.select("id", "impact_score", "risk_score", incidents.level(F.col("impact_score")).alias("impact_level"), incidents.level(F.col("risk_score")).alias("risk_level"))


@query(f"""SELECT n_name AS barrio, count(*) AS n FROM ({REPORTS_SQL}) r JOIN customer ON c_custkey = reporter JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 ORDER BY n DESC, barrio LIMIT 5""")
def barrio_ranking(spark, sf):
    rows = reports(spark, sf).join(table(spark, sf, "customer"), F.col("reporter") == F.col("c_custkey"))
    counts = rows.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))  # counted before the names are joined
    named = counts.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return named.select(F.col("n_name").alias("barrio"), "n").orderBy(F.desc("n"), "barrio").limit(5)


@query(f"""WITH v AS (SELECT unnest(['nuevo','verificado','priorizado','en_reparacion','resuelto','descartado']) AS value, unnest([0,1,2,3,4,5]) AS place),
c AS (SELECT status, count(*) AS n FROM ({REPORTS_SQL}) GROUP BY 1), j AS (SELECT value, place, coalesce(n, 0) AS n FROM v LEFT JOIN c ON status = value),
s AS (SELECT *, n * 100.0::DOUBLE / greatest(sum(n) OVER (), 1)::DOUBLE AS share FROM j)
SELECT value, n, round(share, 6) AS share, round(coalesce(sum(share) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 6) AS "offset" FROM s""")
def distribution(spark, sf):
    return incidents.distribution(reports(spark, sf), "status", incidents.STATUSES)


@query("""WITH m AS (SELECT CAST(DATE '1998-03-01' + to_months(CAST(i AS INT)) AS DATE) AS month FROM range(6) t(i)), c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(m.month AS VARCHAR) AS month, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (month)""")
def monthly_trend(spark, sf):
    return incidents.monthly_trend(reports(spark, sf), "created_at", dt.datetime(1998, 8, 2)).select(F.col("month").cast("string").alias("month"), "n")


@query("""SELECT count(*) AS n, sum(CASE WHEN h > 0 THEN h ELSE 0 END) / count(*) AS hours FROM (SELECT CAST(epoch_us(max(l_shipdate)) - epoch_us(min(o_orderdate)) AS DOUBLE) / 3600000000.0 AS h FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 6 = 4 GROUP BY o_orderkey)""")
def avg_resolution_hours(spark, sf):
    done = confirmations(spark, sf).groupBy("report_id").agg(F.max("at").alias("at"))
    met = reports(spark, sf).where("status = 'resuelto'").join(done, F.col("id") == F.col("report_id"))
    hours = (F.unix_micros(F.col("at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3600000000.0
    return met.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(hours > 0, hours).otherwise(0.0)) / F.count(F.lit(1))).alias("hours"))


@query(f"""SELECT reporter, kind, n FROM (SELECT reporter, kind, count(*) AS n, row_number() OVER (PARTITION BY reporter ORDER BY count(*) DESC, list_position(['bache_aislado','conjunto_de_baches','hundimiento_o_rotura_grande'], kind)) AS rn FROM ({REPORTS_SQL}) GROUP BY 1, 2) WHERE rn = 1""")
def modal_type_tiebreak(spark, sf):
    return incidents.modal_value(reports(spark, sf), "reporter", "kind", incidents.TYPES)


@query(f"SELECT reporter, arg_min(id, (created_at, id)) AS first_id, arg_max(status, (created_at, id)) AS last_status FROM ({REPORTS_SQL}) GROUP BY 1")
def primary_report(spark, sf):
    at = F.struct("created_at", "id")
    return reports(spark, sf).groupBy("reporter").agg(F.min_by("id", at).alias("first_id"), F.max_by("status", at).alias("last_status"))


@query("""SELECT l_orderkey AS report_id, l_partkey AS item FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1""")
def cover_item(spark, sf):
    items = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("report_id"))
    return items.agg(F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("item"))


@query()
def greedy_incidents(spark, sf):
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("reporter"), F.col("c_nationkey").cast("long").alias("municipality"))
    return incidents.cluster(scored(spark, sf).join(people, "reporter"), radius_m=120.0)


# --- joins, sets, pages ------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS municipality, n_name AS name, coalesce(people, 0) AS people, coalesce(trucks, 0) AS trucks FROM nation
LEFT JOIN (SELECT c_nationkey, count(*) AS people FROM customer GROUP BY 1) ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS trucks FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey""")
def municipality_coverage(spark, sf):
    towns = table(spark, sf, "nation").select(F.col("n_nationkey").alias("municipality"), F.col("n_name").alias("name"))
    for name, key, out in (("customer", "c_nationkey", "people"), ("supplier", "s_nationkey", "trucks")):
        counts = table(spark, sf, name).groupBy(F.col(key).alias("municipality")).agg(F.count(F.lit(1)).alias(out))
        towns = towns.join(counts, "municipality", "left").withColumn(out, F.coalesce(out, F.lit(0)))
    return towns


@query("SELECT s_nationkey AS barrio, count(DISTINCT l_partkey) AS routes FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def coverage_distinct_routes(spark, sf):
    stops = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    met = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey").join(stops, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return met.groupBy(F.col("s_nationkey").alias("barrio")).agg(F.count_distinct("l_partkey").alias("routes"))


@query("SELECT o_orderkey AS id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_suppkey = 7)")
def viewer_confirmed(spark, sf):
    mine = confirmations(spark, sf).where("confirmer = 7")
    return reports(spark, sf).join(mine, F.col("id") == F.col("report_id"), "left_semi").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def unconfirmed(spark, sf):
    return reports(spark, sf).join(confirmations(spark, sf), F.col("id") == F.col("report_id"), "left_anti").select("id")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 50")
def keyset_events(spark, sf):
    return table(spark, sf, "events").where("event_id > 100").orderBy("event_id").limit(50).select("event_id", "user_id", "event_type")


@query("SELECT o_orderkey AS id, o_totalprice AS total FROM orders ORDER BY nullif(o_totalprice < 50000, true) NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def paged_results(spark, sf):
    cheap = F.nullif(F.col("o_totalprice") < 50000, F.lit(True))
    return table(spark, sf, "orders").orderBy(cheap.asc_nulls_first(), F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"))


@query("""SELECT c_custkey AS customer, coalesce(CASE WHEN c_acctbal > 5000 THEN c_name END, CASE WHEN r_name LIKE 'A%' THEN n_name END, 'barrio-' || c_nationkey) AS label
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def label_coalesce_chain(spark, sf):
    met = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    label = F.coalesce(F.when(F.col("c_acctbal") > 5000, F.col("c_name")), F.when(F.col("r_name").like("A%"), F.col("n_name")), F.concat(F.lit("barrio-"), F.col("c_nationkey").cast("string")))
    return met.select(F.col("c_custkey").alias("customer"), label.alias("label"))


@query("""SELECT event_id, c_custkey AS subscriber, unnest(CASE WHEN c_custkey % 3 = 0 THEN ['email','push'] WHEN c_custkey % 3 = 1 THEN ['email'] ELSE ['push'] END) AS delivery FROM events JOIN customer ON c_custkey % 1000 = user_id % 1000 WHERE event_type = 'purchase'""")
def broadcast_fanout(spark, sf):
    events = table(spark, sf, "events").where("event_type = 'purchase'").select("event_id", (F.col("user_id") % 1000).alias("zone"))
    channel = F.element_at(F.array(F.lit("all"), F.lit("email"), F.lit("push")), (F.col("c_custkey") % 3 + 1).cast("int"))
    people = table(spark, sf, "customer").select((F.col("c_custkey") % 1000).cast("long").alias("zone"), F.col("c_custkey").alias("subscriber"), channel.alias("channel"))
    return activity.fan_out(events, people, "zone").select("event_id", "subscriber", "delivery")


# --- collection --------------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) > 1 THEN floor(CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / (count(*) - 1) / 3600000000.0 * 10 + 0.5) / 10 END AS mean_hours FROM events GROUP BY 1),
c AS (SELECT *, greatest(3.5, floor(coalesce(mean_hours, 0) / 24 * 10 + 0.5) / 10) AS cadence_days FROM s) SELECT *, CAST(least(greatest(floor(30 / cadence_days + 0.5), 1), 8) AS BIGINT) AS monthly_passes FROM c""")
def interval_stats(spark, sf):
    return collection.interval_stats(table(spark, sf, "events"), "user_id", "ts")


@query("""WITH r AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events), h AS (SELECT user_id, hour(ts - INTERVAL 3 HOUR) AS hour, count(*) AS n, max(ts) AS seen FROM r WHERE rn <= 20 GROUP BY 1, 2)
SELECT user_id, CAST(arg_max(hour, (n, seen)) AS INT) AS hour FROM h GROUP BY 1""")
def habitual_hour(spark, sf):
    return collection.habitual_hour(table(spark, sf, "events"), "user_id", "ts")


@query("SELECT user_id, arg_max(event_type, (n, seen)) AS event_type FROM (SELECT user_id, event_type, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1, 2) GROUP BY 1")
def frequent_route(spark, sf):
    return collection.frequent_value(table(spark, sf, "events"), "user_id", "event_type", "ts")


@query("""SELECT user_id, count(*) FILTER (ts BETWEEN TIMESTAMP '2024-01-18' AND TIMESTAMP '2024-01-25') AS last_7_days, count(*) FILTER (ts BETWEEN TIMESTAMP '2023-12-26' AND TIMESTAMP '2024-01-25') AS last_30_days FROM events GROUP BY 1""")
def rolling_counts(spark, sf):
    return collection.rolling_counts(table(spark, sf, "events"), "user_id", "ts", EVENTS_NOW, (7, 30))


@query("""SELECT event_id, user_id, is_past, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, is_past ORDER BY CASE WHEN is_past THEN -epoch_us(ts) ELSE epoch_us(ts) END) AS place FROM (SELECT *, ts < TIMESTAMP '2024-01-25' AS is_past FROM events)) WHERE place <= CASE WHEN is_past THEN 12 ELSE 3 END""")
def history_caps_past_future(spark, sf):
    return collection.capped_history(table(spark, sf, "events"), "user_id", "ts", EVENTS_NOW, 12, 3).select("event_id", "user_id", "is_past", "place")


@query("SELECT event_id, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS DOUBLE) / 1000000.0 AS gap_s FROM events")
def gaps_positions(spark, sf):
    return collection.gaps(table(spark, sf, "events"), "user_id", "ts").select("event_id", "gap_s")


@query("""SELECT event_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM (SELECT *, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS DOUBLE) / 1000000.0 AS gap FROM events)""")
def session_gaps(spark, sf):
    return collection.sessions(table(spark, sf, "events"), "user_id", "ts", 43200).select("event_id", "session")


_HAVERSINE = "2 * 6371000.0 * atan2(sqrt({a}), sqrt(1 - ({a})))"


def _haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    return _HAVERSINE.format(a=a)


_POINTS_SQL = "SELECT user_id AS route_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq, -25.38 + CAST((event_id * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 AS lat, -57.68 + CAST((event_id * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 AS lon FROM events"
_SHAPES_SQL = f"SELECT route_id, seq, lat, lon, round(sum(step) OVER (PARTITION BY route_id ORDER BY seq), 3) AS cum_m FROM (SELECT *, coalesce({_haversine_sql('plat', 'plon', 'lat', 'lon')}, 0) AS step FROM (SELECT *, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM ({_POINTS_SQL}) WINDOW w AS (PARTITION BY route_id ORDER BY seq)))"


def _points(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("long"))
    return events.select(F.col("user_id").alias("route_id"), "seq", latitude(F.col("event_id")).alias("lat"), longitude(F.col("event_id")).alias("lon"))


@query(f"SELECT route_id, seq, round(cum_m, 1) AS cum_m FROM ({_SHAPES_SQL})")
def cumulative_distance(spark, sf):
    return collection.shape_metrics(_points(spark, sf)).select("route_id", "seq", F.round("cum_m", 1).alias("cum_m"))


@query(f"""WITH s AS (SELECT *, lead(cum_m) OVER w AS to_m, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM ({_SHAPES_SQL}) WINDOW w AS (PARTITION BY route_id ORDER BY seq)), d AS (SELECT route_id, max(cum_m) / 2 AS distance_m FROM ({_SHAPES_SQL}) GROUP BY 1),
m AS (SELECT *, (distance_m - cum_m) / (to_m - cum_m) AS part, to_m - cum_m > 300 AS far FROM d JOIN s USING (route_id) WHERE distance_m >= cum_m AND distance_m < to_m), p AS (SELECT *, CASE WHEN far THEN CASE WHEN part < 0.5 THEN 0 ELSE 1 END ELSE part END AS share FROM m)
SELECT route_id, round(distance_m, 1) AS distance_m, round(lat + (lat2 - lat) * share, 3) AS lat, round(lon + (lon2 - lon) * share, 3) AS lon FROM p""")
def interpolate_position(spark, sf):
    shapes = collection.shape_metrics(_points(spark, sf))
    wanted = shapes.groupBy("route_id").agg((F.max("cum_m") / 2).alias("distance_m"))
    return collection.positions_along(shapes, wanted).select("route_id", F.round("distance_m", 1).alias("distance_m"), F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon"))


@query("SELECT p_partkey AS id, lpad(CAST((p_partkey * 7 % 1700) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((p_partkey * 7 % 1700) % 60 AS VARCHAR), 2, '0') || ':00' AS time, CAST(p_partkey * 7 % 1700 AS INT) AS minutes FROM part")
def transit_time_roundtrip(spark, sf):
    time = numbers.to_time(F.col("p_partkey") * 7 % 1700)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), time.alias("time")).withColumn("minutes", numbers.to_minutes(F.col("time")))


@query("SELECT s_suppkey AS truck, s_nationkey AS depot FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 10")
def fleet_round_robin(spark, sf):
    trucks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("truck"), F.col("s_nationkey").alias("depot"))
    return collection.round_robin(trucks, "depot", "truck").select("truck", "depot")


@query("""SELECT n_nationkey || ',' || CASE WHEN regexp_matches(n_name, '[",\\r\\n]') THEN '"' || replace(n_name, '"', '""') || '"' ELSE n_name END || ',"a ""b"", c"' AS line FROM nation""")
def transit_csv_lines(spark, sf):
    return transit_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", F.lit('a "b", c').alias("note")))


# --- geometry ----------------------------------------------------------------------------------------------------------

_BOX = (-25.33, -25.25, -57.64, -57.55)
_RING = [(-57.66, -25.36), (-57.52, -25.34), (-57.56, -25.28), (-57.50, -25.22), (-57.65, -25.21), (-57.60, -25.29)]


@query("SELECT id FROM (" + REPORTS_SQL + f") WHERE lat BETWEEN {_BOX[0]} AND {_BOX[1]} AND lon BETWEEN {_BOX[2]} AND {_BOX[3]}")
def bbox_filter(spark, sf):
    return reports(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), _BOX)).select("id")


_EDGES_SQL = " UNION ALL ".join(f"SELECT CAST({a[0]} AS DOUBLE) AS ax, CAST({a[1]} AS DOUBLE) AS ay, CAST({b[0]} AS DOUBLE) AS bx, CAST({b[1]} AS DOUBLE) AS by_" for a, b in zip(_RING[-1:] + _RING[:-1], _RING, strict=True))


@query(f"SELECT id FROM ({REPORTS_SQL}) r, ({_EDGES_SQL}) e GROUP BY id HAVING count(*) FILTER ((ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax) % 2 = 1")
def point_in_polygon(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _RING])
    return reports(spark, sf).where(geo.in_ring(F.col("lat"), F.col("lon"), ring)).select("id")


@query(f"""WITH d AS (SELECT id, n_nationkey AS place_id, {_haversine_sql('lat', 'lon', 'plat', 'plon')} AS m FROM ({REPORTS_SQL}) r, (SELECT n_nationkey, -25.38 + CAST((n_nationkey * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 AS plat, -57.68 + CAST((n_nationkey * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 AS plon FROM nation))
SELECT id, arg_min(place_id, (m, place_id)) AS place_id, round(min(m), 3) AS distance_m FROM d GROUP BY 1 HAVING min(m) <= 1200""")
def nearest_within_radius(spark, sf):
    key = F.col("n_nationkey").cast("long")
    places = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place_id"), latitude(key).alias("place_lat"), longitude(key).alias("place_lon"))
    found = zones.nearest_within(reports(spark, sf).select("id", "lat", "lon"), places, 1200.0)
    return found.select("id", "place_id", F.round("distance_m", 3).alias("distance_m"))


_PEOPLE_SQL = "SELECT c_custkey AS id, -25.38 + CAST((c_custkey * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 AS lat, -57.68 + CAST((c_custkey * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 AS lon FROM customer"
_CROWD_SQL = "SELECT id, -25.38 + CAST((g * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 + CAST((k * 7) % 53 AS DOUBLE) / 53.0 * 0.003 AS lat, -57.68 + CAST((g * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 + CAST((k * 31) % 59 AS DOUBLE) / 59.0 * 0.003 AS lon FROM (SELECT c_custkey AS id, c_custkey // 50 AS g, c_custkey % 50 AS k FROM customer)"
_NEAR_SQL = f"SELECT a.id AS a, b.id AS b, {_haversine_sql('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS m FROM ({_CROWD_SQL}) a JOIN ({_CROWD_SQL}) b ON a.id < b.id AND abs(a.lat - b.lat) < 0.002 AND abs(a.lon - b.lon) < 0.002"


def _people(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    return table(spark, sf, "customer").select(key.alias("id"), latitude(key).alias("lat"), longitude(key).alias("lon"))


def _crowd(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in groups of fifty that stand within some three hundred metres."""
    group, own = F.floor(F.col("c_custkey") / 50), F.col("c_custkey") % 50
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (latitude(group) + (own * 7) % 53 / F.lit(53.0) * F.lit(0.003)).alias("lat"), (longitude(group) + (own * 31) % 59 / F.lit(59.0) * F.lit(0.003)).alias("lon"))


@query(f"SELECT a, b, round(m, 3) AS distance_m FROM ({_NEAR_SQL}) WHERE m <= 75")
def grid_proximity_pairs(spark, sf):
    return graph.near_pairs(_crowd(spark, sf), 75.0).select("a", "b", F.round("distance_m", 3).alias("distance_m"))


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM ({_NEAR_SQL}) WHERE m <= 120), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r AS (SELECT a AS node, a AS label FROM u UNION SELECT u.b, r.label FROM r JOIN u ON u.a = r.node)
SELECT node, min(label) AS component FROM r GROUP BY 1""")
def components(spark, sf):
    return graph.near_components(_crowd(spark, sf), 120.0)


# --- text, URLs, retrieval ---------------------------------------------------------------------------------------------

_PLAIN_SQL = f"trim(regexp_replace(regexp_replace(translate(lower(coalesce(text, '')), '{text.ACCENTED}', '{text.BASE}'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_PLAIN_SQL}) AS plain, len(list_filter(string_split({_PLAIN_SQL}, ' '), lambda t: t <> '')) AS n_tokens FROM documents")
def text_normalize(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.normalize(F.col("text")).alias("plain"))
    return docs.select("doc_id", F.md5("plain").alias("plain"), text.words_in(F.col("plain")).alias("n_tokens"))


@query("SELECT n_nationkey AS id, lower(regexp_replace(regexp_replace(n_name, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM nation")
def slug(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), text.slug(F.col("n_name")).alias("slug"))


@query("""WITH p AS (SELECT page_id, regexp_replace(trim(url), '(?s)#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '(?i)^(https?://[^/?#]+)', 1)) AS origin, regexp_replace(regexp_extract(u, '(?i)^https?://[^/?#]+([^?]*)', 1), '/+$', '') AS path,
list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|yclid|mc_)')) AS kept FROM p),
r AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(kept, lambda x, i: {'k': regexp_extract(x, '^([^=]*)', 1), 'i': i, 'p': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END})), lambda s: s.p), '&') AS query FROM q)
SELECT page_id, CASE WHEN origin <> '' THEN origin || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url FROM r""")
def url_normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


@query("""SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) AS host, CASE WHEN regexp_matches(p, '\\.pdf$') THEN 'pdf' WHEN regexp_matches(p, '\\.(png|jpe?g|webp|gif|svg)$') THEN 'image' ELSE 'html' END AS kind FROM (SELECT *, lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)) AS p FROM pages)""")
def url_kind(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"), urls.kind(F.col("url")).alias("kind"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, len(regexp_extract_all(html, '(?i)<a[^>]+href=\"([^\"]+)\"', 1)) AS links, len(regexp_extract_all(html, '(?i)<img[^>]+src=\"([^\"]+)\"', 1)) AS images FROM pages")
def page_parts(spark, sf):
    html = F.col("html")
    count = lambda pattern: F.size(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).cast("long")
    title = F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf, "pages").select("page_id", title.alias("title"), count('(?i)<a[^>]+href="([^"]+)"').alias("links"), count('(?i)<img[^>]+src="([^"]+)"').alias("images"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS digest, CASE WHEN doc_id % 9 > 0 THEN source || doc_id % 9 END AS url, lang FROM documents), l AS (SELECT *, lag(digest) OVER w AS before FROM h WINDOW w AS (PARTITION BY lang, url ORDER BY doc_id))
SELECT doc_id, url IS NULL OR before IS NULL OR before <> digest AS changed, CAST(CASE WHEN url IS NULL THEN 1 ELSE sum(CASE WHEN before IS NULL OR before <> digest THEN 1 ELSE 0 END) OVER (PARTITION BY lang, url ORDER BY doc_id) END AS BIGINT) AS version FROM l""")
def content_versions(spark, sf):
    url = F.when(F.col("doc_id") % 9 > 0, F.concat("source", (F.col("doc_id") % 9).cast("string")))
    items = table(spark, sf, "documents").select("doc_id", "lang", url.alias("url"), F.sha2("text", 256).alias("digest"))
    return retrieval.versions(items, ["lang", "url"], "doc_id", "digest").select("doc_id", "changed", "version")


_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in spanish.STOP_WORDS) + ")"


def _words_sql(key: str, name: str) -> str:
    return f"SELECT {key}, unnest(list_distinct(list_filter(string_split({_PLAIN_SQL}, ' '), lambda t: length(t) >= 2 AND t NOT IN {_STOP_SQL}))) AS token FROM {name}"


_LEXICAL_SQL = f"SELECT item_id AS query_id, doc_id AS chunk_id, CAST(sum(CASE WHEN length(token) >= 8 THEN 10 WHEN length(token) >= 5 THEN 8 ELSE 5 END) AS BIGINT) AS score FROM ({_words_sql('item_id', 'benchmark')}) JOIN ({_words_sql('doc_id', 'documents')}) USING (token) GROUP BY 1, 2"


def _lexical(spark: SparkSession, sf: str, k: int) -> DataFrame:
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.top_k(retrieval.best_token_scores(queries, table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"), k), k)


@query(f"SELECT query_id, chunk_id, score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM ({_LEXICAL_SQL})) WHERE place <= 10")
def top_k_chunks(spark, sf):
    return _lexical(spark, sf, 10)


_COSINE_SQL = "SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0"


def _similar(spark: SparkSession, sf: str, k: int) -> DataFrame:
    stored = table(spark, sf, "embeddings")
    return vectors.nearest(stored.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), stored.select(F.col("vec_id").alias("chunk_id"), "embedding"), k)


@query(f"SELECT query_id, chunk_id, round(similarity, 6) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS place FROM ({_COSINE_SQL})) WHERE place <= 10")
def vector_topk(spark, sf):
    return _similar(spark, sf, 10).select("query_id", "chunk_id", F.round("similarity", 6).alias("score"), "place")


@query(f"""WITH l AS (SELECT query_id, chunk_id, score * 18.0::DOUBLE AS score FROM ({_LEXICAL_SQL})), v AS (SELECT query_id, chunk_id, similarity * 16.0 AS score FROM ({_COSINE_SQL})), u AS (SELECT query_id, chunk_id, max(score) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY 1, 2)
SELECT query_id, chunk_id, round(score, 6) AS score, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM u) WHERE place <= 10""")
def hybrid_score(spark, sf):
    # The better of both scores counts, so what is among the ten best is among its own side's ten best.
    similar = _similar(spark, sf, 10).drop("place")
    both = retrieval.hybrid(_lexical(spark, sf, 10).drop("place"), similar)
    return retrieval.top_k(both, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


#: Cells that each question looks into: many, as the vectors of the tables have next to no clusters.
PROBES = 36


@query()
def vector_cells(spark, sf):
    """``vector_topk`` by an inverted file; a test measures its recall."""
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    path = vectors.write_cells(stored, graph.shared_folder(spark), 64)
    asked = stored.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.near_cells(spark, path, asked, 10, PROBES).select("query_id", "chunk_id", F.round("similarity", 6).alias("score"), "place")


@query("""SELECT doc_id, CASE WHEN l.doc_id_l IS NULL THEN 'never_checked' WHEN quality = 0 THEN 'error' WHEN n_chars < 500 THEN 'stale' ELSE 'unchanged' END AS health FROM documents LEFT JOIN (SELECT doc_id AS doc_id_l, quality FROM labels) l ON doc_id_l = doc_id""")
def health_status(spark, sf):
    checked = table(spark, sf, "labels").select("doc_id", "quality")
    health = F.when(F.col("quality").isNull(), "never_checked").when(F.col("quality") == 0, "error").when(F.col("n_chars") < 500, "stale").otherwise("unchanged")
    return table(spark, sf, "documents").join(checked, "doc_id", "left").select("doc_id", health.alias("health"))


# --- activity ----------------------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_type, CAST(CAST(ts - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS used, greatest(2 - count(*), 0) AS remaining, count(*) >= 2 AS blocked FROM events GROUP BY 1, 2, 3""")
def daily_quota(spark, sf):
    return activity.daily_quota(table(spark, sf, "events"), "user_id", "event_type", "ts", 2).withColumn("day", F.col("day").cast("string"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, epoch_us(ts) / 1000000.0 AS at_s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, rn, at_s AS start, 1 AS attempts, CAST(0 AS DOUBLE) AS until, false AS away FROM e WHERE rn = 1
UNION ALL SELECT user_id, event_id, rn, start, attempts, CASE WHEN away THEN before ELSE CASE WHEN attempts >= 3 THEN at_s + 21600 ELSE 0 END END, away FROM (
SELECT e.user_id, e.event_id, e.rn, e.at_s, r.until AS before, r.until > e.at_s AS away, CASE WHEN r.until > e.at_s OR e.at_s - r.start <= 86400 THEN r.start ELSE e.at_s END AS start,
CASE WHEN r.until > e.at_s THEN r.attempts WHEN e.at_s - r.start <= 86400 THEN r.attempts + 1 ELSE 1 END AS attempts FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, CAST(attempts AS INT) AS attempts, away AS turned_away FROM r""")
def login_throttle(spark, sf):
    return activity.throttled(table(spark, sf, "events"), "user_id", "ts", "event_id", most=3, window_s=86400, block_s=21600)


@query("SELECT user_id, max(ts) AS ts, arg_max(value, ts) AS value, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def latest_position(spark, sf):
    return activity.latest_positions(table(spark, sf, "events"), "user_id", "ts", "value", "event_id")


@query("""WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_type = 'signup' THEN 0 ELSE 1 END AS ends FROM events WHERE event_type IN ('signup', 'purchase')), l AS (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, ends) AS ended_at FROM e)
SELECT event_id, ended_at, CASE WHEN ended_at IS NULL THEN 'online' ELSE 'ended' END AS status FROM l WHERE ends = 0""")
def shift_lifecycle(spark, sf):
    events = table(spark, sf, "events")
    return activity.shifts(events.where("event_type = 'signup'"), "user_id", "ts", events.where("event_type = 'purchase'")).select("event_id", "ended_at", "status")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 20 MINUTE")
def stale_filter(spark, sf):
    return activity.fresh(table(spark, sf, "events"), "ts", EVENTS_NOW).select("event_id")
