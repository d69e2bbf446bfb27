"""Queries of evaluation, crawl jobs, administration, feeds, replies and places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, spanish
from ..operators import activity, dashboards, graph, incidents, pages, search, vectors, zones
from ..sources import files
from . import answers
from .answers import _BOOST, _PROCEDURES_SQL, _QUERIES_SQL, _RANK_SQL, _SECTIONS_SQL, _WANTED, _best, _text_scores, _tokens
from .places import _LAT, _LON
from .queries import _haversine_sql, scored
from .registry import ORACLE_SQL, query
from .tables import EVENTS_NOW, SCORED_SQL, latitude, longitude, table


@query(f"SELECT count(*) FILTER (passed) = count(*) AS ok, count(*) FILTER (passed) AS passed, count(*) AS total FROM ({ORACLE_SQL['rag_eval_hits']})")
def rag_eval_total(spark, sf):
    return search.evaluation_total(answers.rag_eval_hits(spark, sf))


# --- crawl jobs --------------------------------------------------------------------------------------------------------

_LOG_SQL = r"""SELECT page_id % 9 AS job_id, page_id, url, CASE WHEN page_id % 5 = 1 THEN 'pdf' WHEN page_id % 5 = 2 THEN 'image' ELSE 'html' END AS kind, contains(url, '?') AS external, octet_length(encode(coalesce(html, ''))) > 2000 AS too_large,
CASE WHEN page_id % 11 = 0 THEN 'http ' || page_id % 7 END AS error, md5(html) AS digest, CASE WHEN page_id % 3 = 1 THEN md5(html) WHEN page_id % 3 = 2 THEN 'old' END AS known FROM pages"""


@query(f"""SELECT job_id, count(*) FILTER (ok AND kind = 'html') AS pages, count(*) FILTER (ok AND kind = 'pdf') AS pdfs, count(*) FILTER (ok AND kind = 'image') AS images, count(*) FILTER (ok AND digest IS DISTINCT FROM known) AS changed_items,
count(*) FILTER (ok AND digest IS NOT DISTINCT FROM known) AS unchanged_items, count(*) FILTER (external) AS external_skipped, count(*) FILTER (too_large AND NOT external AND error IS NULL) AS assets_too_large, count(error) AS errors, arg_max(error, page_id) FILTER (error IS NOT NULL) AS last_error
FROM (SELECT *, NOT external AND error IS NULL AND NOT too_large AS ok FROM ({_LOG_SQL})) GROUP BY 1""")
def crawl_jobs(spark, sf):
    n = F.col("page_id")
    log = table(spark, sf, "pages").select(
        (n % 9).alias("job_id"), n.alias("at"), "url", F.when(n % 5 == 1, "pdf").when(n % 5 == 2, "image").otherwise("html").alias("kind"), F.col("url").contains("?").alias("external"),
        (F.octet_length(F.coalesce("html", F.lit(""))) > 2000).alias("too_large"), F.when(n % 11 == 0, F.concat(F.lit("http "), (n % 7).cast("string"))).alias("error"), F.md5("html").alias("digest"),
        F.when(n % 3 == 1, F.md5("html")).when(n % 3 == 2, "old").alias("known"),
    )
    return pages.job_counters(log, "job_id")


@query("""WITH s AS (SELECT user_id AS job_id, list(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS ids FROM events GROUP BY 1)
SELECT job_id, len(ids) - 1 AS n_left, CAST(list_sum(list_filter(ids, lambda x: x <> 7)) AS BIGINT) AS sum_left, CASE WHEN job_id % 2 = 0 THEN '3' END AS kept, 'Seed 7 eliminada por admin' AS said FROM s WHERE list_contains(ids, 7)""")
def seed_removed(spark, sf):
    """Jobs that name a seed, without it, and the last message among their counters."""
    n = F.col("user_id")
    stats = F.when(n % 2 == 0, F.lit('{"pages":"3","lastEventMessage":"old"}')).when(n % 3 == 0, F.lit("{}"))
    lists = table(spark, sf, "events").groupBy(n.alias("user_id")).agg(F.to_json(F.collect_set(F.get_json_object("props", "$.k").cast("int"))).alias("seed_ids"))
    found = dashboards.without_seed(lists.select(n.alias("job_id"), "seed_ids", stats.alias("stats")), 7, "Seed 7 eliminada por admin")
    left = F.from_json("seed_ids", "array<bigint>")
    return found.select("job_id", F.size(left).cast("bigint").alias("n_left"), F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("sum_left"), F.get_json_object("stats", "$.pages").alias("kept"), F.get_json_object("stats", "$.lastEventMessage").alias("said"))


@query("""SELECT n_nationkey AS municipality, coalesce(b, 0) AS barrios, coalesce(s, 0) AS seeds, coalesce(i, 0) AS items, coalesce(v, 0) AS visible_items, coalesce(c, 0) AS chunks, coalesce(e, 0) AS embedded FROM nation
LEFT JOIN (SELECT c_nationkey AS m, count(*) AS b FROM customer GROUP BY 1) x ON x.m = n_nationkey LEFT JOIN (SELECT s_nationkey AS m, count(*) AS s FROM supplier WHERE s_nationkey > 3 GROUP BY 1) y ON y.m = n_nationkey
LEFT JOIN (SELECT doc_id % 24 AS m, count(*) AS i, count(*) FILTER (visible) AS v FROM documents LEFT JOIN (SELECT doc_id AS d, bool_or(quality = 1) AS visible FROM labels GROUP BY 1) ON d = doc_id GROUP BY 1) z ON z.m = n_nationkey
LEFT JOIN (SELECT doc_id % 23 AS m, count(*) AS c, count(vec_id) AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1) w ON w.m = n_nationkey""")
def town_totals(spark, sf):
    """Every town with the totals of four tables, each summed before the join."""
    count = F.count(F.lit(1))
    towns, docs = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("municipality")), table(spark, sf, "documents").select("doc_id")
    good = table(spark, sf, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("visible"))
    stored = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    totals = [
        table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("municipality")).agg(count.alias("barrios")),
        table(spark, sf, "supplier").where("s_nationkey > 3").groupBy(F.col("s_nationkey").alias("municipality")).agg(count.alias("seeds")),
        docs.join(good, "doc_id", "left").groupBy((F.col("doc_id") % 24).alias("municipality")).agg(count.alias("items"), F.count_if("visible").alias("visible_items")),
        docs.join(stored, "doc_id", "left").groupBy((F.col("doc_id") % 23).alias("municipality")).agg(count.alias("chunks"), F.count("embedded").alias("embedded")),
    ]
    for part in totals:
        towns = towns.join(part, "municipality", "left")
    return towns.fillna(0)


# --- administration ----------------------------------------------------------------------------------------------------


@query(f"""WITH r AS (SELECT id, status, priority_band FROM ({SCORED_SQL})), c AS (SELECT l_orderkey AS id, l_linenumber AS step, CASE WHEN l_linenumber % 3 > 0 THEN CASE l_returnflag WHEN 'R' THEN 'resuelto' WHEN 'A' THEN 'verificado' ELSE 'nuevo' END END AS s, CASE l_linenumber % 4 WHEN 1 THEN 'alta' WHEN 2 THEN 'baja' END AS b, CASE WHEN l_linenumber % 5 = 0 THEN ' visto ' WHEN l_linenumber % 5 = 1 THEN ' ' END AS note FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
w AS (SELECT c.*, status, priority_band, last_value(s IGNORE NULLS) OVER p AS s0, last_value(b IGNORE NULLS) OVER p AS b0 FROM c JOIN r USING (id) WINDOW p AS (PARTITION BY id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT id, step, coalesce(s0, status) AS from_status, coalesce(s, s0, status) AS to_status, coalesce(b0, priority_band) AS fb, coalesce(b, b0, priority_band) AS priority_band, nullif(trim(coalesce(note, '')), '') AS said FROM w)
SELECT id, step, from_status, to_status, priority_band, nullif(concat_ws(' ', CASE WHEN priority_band <> fb THEN 'Prioridad manual: ' || priority_band || '.' END, said), '') AS note FROM f WHERE from_status <> to_status OR priority_band <> fb OR said IS NOT NULL""")
def admin_history(spark, sf):
    """Line items as an administrator's changes of status, priority and note."""
    n, flag = F.col("l_linenumber"), F.col("l_returnflag")
    status = F.when(n % 3 > 0, F.when(flag == "R", "resuelto").when(flag == "A", "verificado").otherwise("nuevo"))
    changes = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("l_returnflag")).select(F.col("l_orderkey").alias("id"), n.alias("step"), status.alias("status"), F.when(n % 4 == 1, "alta").when(n % 4 == 2, "baja").alias("priority_band"), F.when(n % 5 == 0, " visto ").when(n % 5 == 1, " ").alias("note"))
    return dashboards.admin_changes(scored(spark, sf), changes, "step")


@query(f"""SELECT id, impact_score, risk_score FROM (SELECT *, CAST(least(14 + confirmations * 18, 100) AS BIGINT) AS impact_score, CAST(least(CASE severity WHEN 'alta' THEN 58 WHEN 'media' THEN 36 ELSE 18 END + CASE kind WHEN 'bache_aislado' THEN 10 WHEN 'conjunto_de_baches' THEN 18 ELSE 28 END, 100) AS BIGINT) AS risk_score FROM ({SCORED_SQL}))
WHERE status NOT IN ('resuelto', 'descartado') AND priority_band = 'alta' AND impact_score >= 70 AND risk_score BETWEEN 40 AND 69 AND reporter % 5 = 2""")
def incident_filters(spark, sf):
    """Open incidents of high priority, high impact and middle risk in one quarter."""
    rows = scored(spark, sf).withColumns({"impact_score": incidents.impact_score(F.lit(1), F.col("confirmations")), "risk_score": incidents.risk_score(F.col("severity"), F.col("kind")), "place": (F.col("reporter") % 5).cast("string")})
    return dashboards.incident_queue(rows, "abierto", "alta", "alta", "media", "2").select("id", F.col("impact_score").cast("bigint").alias("impact_score"), F.col("risk_score").cast("bigint").alias("risk_score"))


@query()
def client_incidents(spark, sf):
    """Incidents without regard to towns, with what their top report has: tested against a plain loop."""
    rows = scored(spark, sf).withColumns({"municipality": F.lit(0), "overridden": F.col("id") % 17 == 0})
    found = incidents.cluster(rows).select("id", "incident_id")
    return dashboards.copied_roll_up(rows.join(found, "id"), "incident_id")


# --- feeds -------------------------------------------------------------------------------------------------------------

_VEHICLES_SQL = "SELECT 'v' || user_id AS id, CASE WHEN user_id % 3 > 0 THEN 'Camion ' || user_id ELSE 'v' || user_id END AS label, 't' || event_id AS trip, event_type AS route, user_id % 90 / 2 AS lat, event_id % 170 / 4 AS lon, CASE WHEN event_id % 2 = 0 THEN 's' || event_id % 9 END AS stop FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"
_HEADER = """'{"header":{"gtfsRealtimeVersion":"2.0","incrementality":"FULL_DATASET","timestamp":1706140800,"timeZone":"America/Asuncion"}}'"""
_TRIP = """'{"tripId":"' || trip || '","routeId":"' || route || '"},"vehicle":{"id":"' || id || '","label":"' || label || '"}'"""


def _vehicles(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("e")).select("user_id", "e.*")
    u, e = F.col("user_id"), F.col("event_id")
    name = F.concat(F.lit("v"), u.cast("string"))
    return last.select(name.alias("vehicle_id"), F.when(u % 3 > 0, F.concat(F.lit("Camion "), u.cast("string"))).alias("label"), F.concat(F.lit("t"), e.cast("string")).alias("trip_id"), F.col("event_type").alias("route_id"), (u % 90 / 2).alias("lat"), (e % 170 / 4).alias("lon"), F.when(e % 2 == 0, F.concat(F.lit("s"), (e % 9).cast("string"))).alias("stop_id"))


@query(f"""SELECT CAST(NULL AS VARCHAR) AS vehicle_id, {_HEADER} AS json UNION ALL SELECT id, '{{"id":"' || id || '","vehicle":{{"trip":' || {_TRIP} || ',"position":{{"latitude":' || lat || ',"longitude":' || lon || '}},"currentStatus":"IN_TRANSIT_TO","stopId":' || coalesce('"' || stop || '"', 'null') || ',"timestamp":1706140800}}}}' FROM ({_VEHICLES_SQL})""")
def vehicle_positions_feed(spark, sf):
    return files.vehicle_entities(_vehicles(spark, sf), int(EVENTS_NOW.timestamp()))


@query(f"""SELECT CAST(NULL AS VARCHAR) AS vehicle_id, {_HEADER} AS json UNION ALL SELECT id, '{{"id":"' || trip || '","tripUpdate":{{"trip":' || {_TRIP} || ',"stopTimeUpdate":[],"timestamp":1706140800}}}}' FROM ({_VEHICLES_SQL})""")
def trip_updates_feed(spark, sf):
    return files.vehicle_entities(_vehicles(spark, sf), int(EVENTS_NOW.timestamp()), updates=True)


@query("""SELECT 'agency' AS section, CAST(r_regionkey AS VARCHAR) AS "order", '{"agency_id":' || r_regionkey || ',"agency_name":"' || r_name || '"}' AS json FROM region UNION ALL SELECT 'routes', CAST(n_nationkey AS VARCHAR), '{"route_id":' || n_nationkey || ',"agency_id":' || n_regionkey || '}' FROM nation
UNION ALL SELECT 'stop_times', l_orderkey || '/' || l_linenumber, '{"trip_id":' || l_orderkey || ',"stop_sequence":' || l_linenumber || ',"stop_id":' || CASE WHEN l_suppkey % 4 > 0 THEN CAST(l_suppkey AS VARCHAR) ELSE 'null' END || '}' FROM lineitem""")
def full_feed(spark, sf):
    """Every record of three tables as lines of the whole feed."""
    agency = table(spark, sf, "region").select(F.col("r_regionkey").alias("agency_id"), F.col("r_name").alias("agency_name"))
    routes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_regionkey").alias("agency_id"))
    times = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_linenumber").alias("stop_sequence"), F.when(F.col("l_suppkey") % 4 > 0, F.col("l_suppkey")).alias("stop_id"))
    found = files.full_feed({"agency": (agency, ["agency_id"]), "routes": (routes, ["route_id"]), "stop_times": (times, ["trip_id", "stop_sequence"])})
    return found.withColumn("order", F.array_join("order", "/"))


@query("""SELECT event_id, user_id AS vehicle FROM events JOIN customer ON c_custkey = user_id WHERE event_type <> 'signup' AND event_id % 7 > 0 AND event_id % 11 > 0 AND ts >= TIMESTAMP '2024-01-25' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-25'""")
def online_vehicles(spark, sf):
    """Vehicles on shift with a position that is fresh."""
    n = F.col("event_id")
    rows = table(spark, sf, "events").withColumns({"status": F.when(F.col("event_type") != "signup", "online").otherwise("offline"), "lat": F.when(n % 7 > 0, n), "lon": F.when(n % 11 > 0, n)})
    people = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    return activity.reported_vehicles(rows.where(F.col("ts").cast("timestamp") <= F.lit(EVENTS_NOW)).join(people, "user_id"), "ts", EVENTS_NOW, 24 * 60).select("event_id", F.col("user_id").alias("vehicle"))


# --- replies -----------------------------------------------------------------------------------------------------------

@query(f"""WITH q AS (SELECT query_id, len(list_filter({_tokens('text')}, lambda t: length(t) >= 5)) AS strong_words FROM ({_QUERIES_SQL})), e AS {_best(_RANK_SQL, _WANTED, 'total')},
b AS (SELECT query_id, max(total) AS best, arg_min(procedure_id, (-total, chunk_id)) FILTER (procedure_id IS NOT NULL) AS p FROM e GROUP BY 1),
s AS (SELECT e.query_id, arg_min(strong, (-round(total + CASE WHEN procedure_id = p THEN 12 ELSE 0 END + {_BOOST.format(s='section')}, 4), chunk_id)) AS strong_matches FROM e JOIN b USING (query_id) GROUP BY 1),
l AS (SELECT query_id, max(lexical) AS lexical FROM (SELECT query_id, procedure_id, sum(score) AS lexical FROM (SELECT query_id, chunk_id AS procedure_id, score FROM {_text_scores(_QUERIES_SQL, f'SELECT procedure_id AS chunk_id, title AS text FROM ({_PROCEDURES_SQL})', 14)}
UNION ALL SELECT query_id, chunk_id, score FROM {_text_scores(_QUERIES_SQL, f'SELECT procedure_id AS chunk_id, description AS text FROM ({_PROCEDURES_SQL})', 10)} UNION ALL SELECT query_id, chunk_id.p, score FROM {_text_scores(_QUERIES_SQL, f"SELECT {{'p': procedure_id, 's': section}} AS chunk_id, text FROM ({_SECTIONS_SQL})", 6)}) GROUP BY 1, 2) GROUP BY 1)
SELECT q.query_id, CASE WHEN q.query_id % 9 = 0 THEN 'conversational' WHEN q.query_id % 9 = 1 THEN 'out_of_scope' WHEN q.query_id % 9 = 2 THEN 'no_corpus' WHEN best IS NULL OR best < 60 THEN CASE WHEN lexical >= 10 THEN 'procedure' ELSE 'no_result' END
WHEN strong_words > 0 AND coalesce(strong_matches, 0) = 0 THEN CASE WHEN lexical >= 10 THEN 'procedure' ELSE 'no_evidence' END ELSE 'answer' END AS kind FROM q LEFT JOIN b ON b.query_id = q.query_id LEFT JOIN s ON s.query_id = q.query_id LEFT JOIN l ON l.query_id = q.query_id""")
def reply_kinds(spark, sf):
    """The reply that each question gets; some are small talk, another office's, or asked where there are no texts. The best chunk must reach 60."""
    from ..operators import retrieval

    asked = answers._asked(spark, sf)
    n = F.col("query_id")
    said = F.when(n % 9 == 0, "¡Hola!").when(n % 9 == 1, "perdí mi Cédula").otherwise(F.lit("x"))
    evidence = graph.cut(answers._retrieved(spark, sf).withColumn("score", F.col("total")).drop("place"))
    first = evidence.where("procedure_id IS NOT NULL").groupBy("query_id").agg(F.min_by("procedure_id", F.struct((-F.col("score")).alias("s"), "chunk_id")).alias("procedure_id"))
    shown = search.sorted_evidence(evidence.withColumn("score", F.round("score", 4)), first, 1).select("query_id", F.col("strong").alias("strong_matches"))
    none = spark.createDataFrame([], "query_id long, procedure_id long, score double")
    lexical = search.top(search.procedure_scores(asked, answers._procedures(spark, sf), none, 1), 1, item="procedure_id").select("query_id", "lexical")
    rows = asked.select("query_id", said.alias("said"), F.size(F.filter(spanish.query_tokens(F.col("text")), lambda t: F.length(t) >= 5)).alias("strong_words"))
    rows = rows.join(evidence.groupBy("query_id").agg(F.max("score").alias("best")), "query_id", "left").join(shown, "query_id", "left").join(lexical, "query_id", "left")
    kind = retrieval.reply_kind(rules.intent(F.col("said")), rules.other_office(F.col("said")), n % 9 == 2, F.col("best"), F.col("lexical"), F.col("strong_words"), F.col("strong_matches"), 60.0)
    return rows.select("query_id", kind.alias("kind"))


# --- vectors and places ------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0 ELSE 64 END AS n, CASE WHEN vec_id % 5 > 0 THEN md5('[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)), ',') || ']') END AS digest FROM embeddings""")
def vector_texts(spark, sf):
    """Vectors of whole numbers as JSON text, read and put as a vector column takes them; every fifth text is damaged."""
    stored = F.to_json(F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double")))
    read = table(spark, sf, "embeddings").select("vec_id", vectors.parse_vector(F.when(F.col("vec_id") % 5 > 0, stored).otherwise("{not a list")).alias("v"))
    return read.select("vec_id", F.size("v").alias("n"), F.md5(vectors.vector_text(F.col("v"), 64)).alias("digest"))


@query(f"""WITH p AS (SELECT c_custkey AS id, {_LAT.format(k='c_custkey')} AS lat, {_LON.format(k='c_custkey')} AS lon FROM customer), d AS (SELECT s_suppkey AS place_id, {_LAT.format(k='s_suppkey * 41 + 3')} AS lat, {_LON.format(k='s_suppkey * 41 + 3')} AS lon FROM supplier),
m AS (SELECT id, place_id, {_haversine_sql('p.lat', 'p.lon', 'd.lat', 'd.lon')} AS m FROM p, d) SELECT id, arg_min(place_id, (m, place_id)) AS place_id, round(min(m), 3) AS distance_m FROM m GROUP BY 1""")
def nearest_depot(spark, sf):
    """The nearest depot of every person, however far."""
    k, s = F.col("c_custkey"), F.col("s_suppkey") * 41 + 3
    people = table(spark, sf, "customer").select(k.alias("id"), latitude(k).alias("lat"), longitude(k).alias("lon"))
    depots = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("place_id"), latitude(s).alias("place_lat"), longitude(s).alias("place_lon"))
    return zones.nearest(people, depots, 500.0).select("id", "place_id", F.round("distance_m", 3).alias("distance_m"))


@query("""WITH f AS (SELECT s_suppkey, CAST(s_suppkey % 100 AS VARCHAR) AS district, 'PY-' || s_nationkey || s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE 'x' END AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey),
t AS (SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS district, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey || '1' ELSE '' END AS code, n_name FROM nation)
SELECT s_suppkey AS feature_id, n_nationkey AS town_id FROM f, t WHERE CASE WHEN length(f.district) < 2 THEN lpad(f.district, 2, '0') ELSE f.district END = t.district OR (code <> '' AND starts_with(regexp_replace(key, '[^0-9]', '', 'g'), code)) OR f.name = n_name""")
def town_features(spark, sf):
    """Districts meet towns by code, by the beginning of their key, or by name."""
    towns = table(spark, sf, "nation")
    n = F.col("n_nationkey").cast("string")
    own = towns.select(F.col("n_nationkey").alias("town_id"), n.alias("district"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(n, F.lit("-1"))).alias("code"), F.concat(F.lit(" "), F.lower("n_name"), F.lit("!")).alias("name"))
    s = F.col("s_suppkey")
    given = table(spark, sf, "supplier").join(towns.select(F.col("n_nationkey").alias("s_nationkey"), "n_name"), "s_nationkey")
    features = given.select(s.alias("feature_id"), (s % 100).cast("string").alias("district"), F.concat(F.lit("PY-"), F.col("s_nationkey").cast("string"), s.cast("string")).alias("key"), F.when(s % 3 == 0, F.col("n_name")).otherwise("x").alias("name"))
    return zones.matched_districts(features, own)
