"""Queries of pages, planning and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as chunks_
from ..operators import collection, graph, pages, planning, retrieval, validation
from ..operators.scoring import spread
from .registry import query
from .tables import EVENTS_NOW, REPORTS_SQL, latitude, longitude, reports, table


def _stops(spark, sf):
    key = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("municipality"), key.alias("id"), F.col("s_name").alias("label"), latitude(key).alias("lat"), longitude(key).alias("lon"),
    )


_STOPS_SQL = """SELECT s_nationkey AS municipality, s_suppkey AS id, s_name AS label, -25.38 + CAST((s_suppkey * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 AS lat,
-57.68 + CAST((s_suppkey * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 AS lon FROM supplier"""
_MADE_UP_SQL = f"""SELECT *, CAST(greatest(28, 18 + 12 * count(*) OVER (PARTITION BY municipality, route_index)) AS INT) AS duration_min FROM (
SELECT *, CAST(floor(p / 3.0) AS INT) AS route_index, CAST(p % 3 + 1 AS INT) AS sequence FROM (SELECT *, row_number() OVER (PARTITION BY municipality ORDER BY label, id) - 1 AS p FROM ({_STOPS_SQL})))"""


# --- pages -------------------------------------------------------------------------------------------------------------


@query()
def snapshot_blocks(spark, sf):
    found = pages.snapshot(table(spark, sf, "pages"))
    return found.select("page_id", "title", F.size("blocks").alias("blocks"), F.md5(F.array_join("blocks", "\n")).alias("digest"), "summary")


@query()
def boilerplate_strip(spark, sf):
    cleaned = pages.strip_boilerplate(F.col("text"))
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", cleaned.alias("t")).select("doc_id", F.length("t").alias("chars"), F.md5("t").alias("digest"))


@query()
def noisy_chunks(spark, sf):
    chunks = table(spark, sf, "documents").select("doc_id", F.posexplode(chunks_.split_long(F.coalesce("text", F.lit("")))).alias("place", "chunk"))
    return chunks.select("doc_id", "place", pages.is_noisy(F.col("chunk"), F.lit(True)).alias("noisy"))


_PATH_SQL = "regexp_replace(lower(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)), '/+$', '')"


@query(f"SELECT page_id, {_PATH_SQL} IN ('', '/archivo') OR regexp_matches({_PATH_SQL}, '^/({'|'.join(pages.LISTINGS)})/') AS listing FROM pages")
def listing_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", pages.is_listing(F.col("url")).alias("listing"))


@query()
def crawl_frontier(spark, sf):
    host = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    found = table(spark, sf, "pages").select("url", host.alias("host"), F.posexplode(F.regexp_extract_all("html", F.lit('(?i)<a[^>]+href="([^"]+)"'), F.lit(1))).alias("position", "href"))
    links = found.select(F.col("url").alias("source"), F.when(F.col("href").startswith("/"), F.concat("host", "href")).otherwise(F.col("href")).alias("target"), "position")
    return pages.crawl(table(spark, sf, "pages").select("url"), links)


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'error' WHEN doc_id % 3 = 0 THEN 'changed' WHEN sha256(CASE WHEN doc_id % 3 = 1 THEN text ELSE upper(text) END) <> sha256(text) THEN 'changed' ELSE 'unchanged' END AS status FROM documents""")
def source_check(spark, sf):
    last = F.when(F.col("doc_id") % 3 == 1, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 2, F.sha2(F.upper("text"), 256))
    return table(spark, sf, "documents").select("doc_id", pages.check_status(last, F.sha2("text", 256)).alias("status"))


@query("""SELECT c_custkey, CASE WHEN seen IS NULL THEN 'never_checked' WHEN c_nationkey = 3 THEN 'error' WHEN seen < TIMESTAMP '2024-01-25' - INTERVAL 2 DAY THEN 'stale' ELSE 'unchanged' END AS health
FROM customer LEFT JOIN (SELECT user_id, max(ts) AS seen FROM events GROUP BY 1) ON user_id = c_custkey""")
def source_health(spark, sf):
    checked = table(spark, sf, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("ts").alias("at"))
    status = F.when(F.col("c_nationkey") == 3, "error").otherwise("unchanged")
    return table(spark, sf, "customer").join(checked, "c_custkey", "left").select("c_custkey", pages.source_health(F.col("at"), status, F.lit(2), EVENTS_NOW).alias("health"))


# --- answers -----------------------------------------------------------------------------------------------------------

_SHARED_SQL = "SELECT d.doc_id AS query_id, d.doc_id % 7 AS procedure_id, d.lang AS section, c.doc_id AS chunk_id, c.doc_id % 7 AS chunk_procedure, c.lang AS chunk_section, c.n_chars AS score FROM documents d JOIN documents c ON c.doc_id BETWEEN d.doc_id + 1 AND d.doc_id + 6"


def _neighbours(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    asked = docs.select(F.col("doc_id").alias("query_id"), (F.col("doc_id") % 7).alias("procedure_id"), F.col("lang").alias("section"), F.explode(F.sequence(F.col("doc_id") + 1, F.col("doc_id") + 6)).alias("chunk_id"))
    return asked.join(docs.select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") % 7).alias("chunk_procedure"), F.col("lang").alias("chunk_section"), F.col("n_chars").alias("score")), "chunk_id")


@query(f"""SELECT query_id, chunk_id, CAST(tier AS INT) AS tier, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, chunk_id) AS place FROM (
SELECT *, CASE WHEN chunk_procedure = procedure_id AND chunk_section = section THEN 0 WHEN chunk_procedure = procedure_id OR chunk_section = section THEN 2 END AS tier FROM ({_SHARED_SQL})) WHERE tier IS NOT NULL) WHERE place <= 4""")
def section_citations(spark, sf):
    return retrieval.section_citations(_neighbours(spark, sf)).select("query_id", "chunk_id", "tier", "place")


@query(f"""WITH e AS (SELECT query_id, chunk_id, score, chunk_section = 'es' AS is_crawled, chunk_procedure < 3 AS is_official, chunk_section = section AS is_top FROM ({_SHARED_SQL})),
c AS (SELECT *, coalesce(max(CASE WHEN is_crawled THEN score END) OVER (PARTITION BY query_id) >= 5, false) AS crawled FROM e),
o AS (SELECT *, bool_or(is_official) OVER (PARTITION BY query_id) AS official FROM c WHERE NOT crawled OR is_crawled)
SELECT query_id, chunk_id, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (is_top AND NOT crawled) DESC, score DESC, chunk_id) AS place FROM o WHERE NOT official OR is_official) WHERE place <= 4""")
def reply_evidence(spark, sf):
    found = _neighbours(spark, sf).withColumn("is_crawled", F.col("chunk_section") == "es").withColumn("is_official", F.col("chunk_procedure") < 3)
    return retrieval.reply_evidence(found.withColumn("is_top_procedure", F.col("chunk_section") == F.col("section"))).select("query_id", "chunk_id", "place")


# --- planning ----------------------------------------------------------------------------------------------------------


@query()
def kmeans_zones(spark, sf):
    key = F.col("c_custkey")
    points = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("depot"), key.alias("id"), key.alias("place"), latitude(key).alias("lat"), longitude(key).alias("lon"))
    return planning.zones(points, "depot")


@query()
def nn_tour(spark, sf):
    stops = _stops(spark, sf).withColumnRenamed("municipality", "route_id").withColumn("place", F.col("id"))
    return planning.tours(stops.withColumn("depot_lat", F.lit(-25.3)).withColumn("depot_lon", F.lit(-57.6)))


def _ways(spark, sf):
    """The way from each town's first stop to its last."""
    stops = _stops(spark, sf)
    pairs = stops.groupBy(F.col("municipality").alias("pair_id")).agg(F.min("id").alias("start"), F.max("id").alias("goal"))
    return graph.near_paths(pairs, stops, 2500.0)


@query()
def shortest_path(spark, sf):
    return _ways(spark, sf).select("pair_id", F.round("distance_m", 3).alias("distance_m"), F.array_join("path", " ").alias("path"))


@query()
def route_shape(spark, sf):
    legs = _ways(spark, sf).select(F.col("pair_id").alias("route_id"), "path", F.explode(F.array(F.lit(0), F.lit(1))).alias("leg"))
    there_and_back = legs.withColumn("path", F.when(F.col("leg") == 1, F.reverse("path")).otherwise(F.col("path")))
    return collection.shape_metrics(planning.route_shapes(there_and_back, _stops(spark, sf))).select("route_id", "seq", "node", "is_anchor", "cum_m")


@query("""WITH r AS (SELECT n_nationkey AS route_id, n_regionkey AS depot, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS zone FROM nation),
f AS (SELECT s_nationkey % 5 AS depot, list_sort(list(DISTINCT s_suppkey)) AS fleet FROM supplier GROUP BY 1), s AS (SELECT unnest(range(22)) AS slot)
SELECT route_id, route_id || '-S' || printf('%02d', slot + 1) AS pattern_id, printf('%02d:%02d', CAST(((slot * 60 + 10 + zone * 10) % 1440) // 60 AS INT), CAST((slot * 60 + 10 + zone * 10) % 60 AS INT)) AS start_time,
fleet[CAST((zone + slot) % len(fleet) + 1 AS INT)] AS truck_id FROM r LEFT JOIN f USING (depot), s""")
def service_patterns(spark, sf):
    from pyspark.sql import Window

    zone = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    routes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_regionkey").alias("depot"), zone.alias("zone"))
    trucks = table(spark, sf, "supplier").select((F.col("s_nationkey") % 5).alias("depot"), F.col("s_suppkey").alias("truck_id"))
    return planning.service_patterns(routes, trucks)


@query(f"SELECT municipality, id, route_index, sequence, duration_min FROM ({_MADE_UP_SQL})")
def made_up_plan(spark, sf):
    return planning.made_up_routes(_stops(spark, sf)).select("municipality", "id", "route_index", "sequence", "duration_min")


@query(f"SELECT municipality, route_index, CAST(2 + 2 * count(*) AS INT) AS points FROM ({_MADE_UP_SQL}) GROUP BY 1, 2")
def made_up_shapes(spark, sf):
    routes = planning.made_up_routes(_stops(spark, sf)).withColumn("depot_lat", F.lit(-25.3)).withColumn("depot_lon", F.lit(-57.6))
    return planning.made_up_shapes(routes).select("municipality", "route_index", F.size("shape").alias("points"))


@query(f"""SELECT id, pass_at, is_past FROM (SELECT id, turn <= 0 AS is_past, TIMESTAMP '2024-01-25' + to_days(CAST(CASE WHEN turn <= 0 THEN -floor(-turn * cadence + 0.5) ELSE floor(turn * cadence + 0.5) END AS INT)) + to_minutes(CAST(minutes AS BIGINT)) AS pass_at
FROM (SELECT id, 3.5 + route_index % 3 AS cadence, (6 + (route_index * 2) % 10) * 60 + (route_index * 11) % 60 + (sequence - 1) * 9 AS minutes, unnest(range(-7, 4)) AS turn FROM ({_MADE_UP_SQL}))) WHERE NOT is_past OR pass_at <= TIMESTAMP '2024-01-25'""")
def made_up_passes(spark, sf):
    found = planning.made_up_passes(planning.made_up_routes(_stops(spark, sf)), EVENTS_NOW)
    return found.select("id", F.col("at").cast("timestamp_ntz").alias("pass_at"), "is_past")


# --- validation --------------------------------------------------------------------------------------------------------


@query(f"""SELECT id, CASE WHEN id % 11 = 0 THEN '{validation.REPORT_ERRORS[0]}' WHEN id % 13 = 0 THEN '{validation.REPORT_ERRORS[1]}' WHEN id % 17 = 0 THEN '{validation.REPORT_ERRORS[2]}' WHEN id % 19 = 0 THEN '{validation.REPORT_ERRORS[3]}'
WHEN id % 23 = 0 THEN '{validation.REPORT_ERRORS[4]}' WHEN id % 4 > 1 THEN '{validation.REPORT_ERRORS[5]}' WHEN reporter % 29 = 0 THEN '{validation.REPORT_ERRORS[6]}' END AS error_code FROM ({REPORTS_SQL})""")
def report_validation(spark, sf):
    n, bad = F.col("id"), lambda m, then, other: F.when(F.col("id") % m == 0, then).otherwise(other)
    error = validation.report_error(
        bad(11, F.lit("grave"), F.col("severity")), bad(13, F.lit(None), F.col("kind")), bad(17, F.lit(float("nan")), F.col("lat")), F.col("lon"),
        bad(19, F.lit("  "), F.lit("hueco")), F.lit("Ana"), bad(23, F.lit(None), F.lit("ana@x.py")), n % 4, F.when(F.col("reporter") % 29 != 0, F.col("reporter")),
    )
    return reports(spark, sf).select("id", error.alias("error_code"))
