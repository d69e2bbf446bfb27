"""Schedules, timings, timelines and merges over whole tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collection, retrieval
from .queries import _SHAPES_SQL, _points
from .registry import query
from .tables import REPORTS_SQL, confirmations, reports, table


@query(f"""WITH s AS (SELECT *, max(cum_m) OVER (PARTITION BY route_id) AS total, row_number() OVER (PARTITION BY route_id ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY route_id) AS n FROM ({_SHAPES_SQL})),
t AS (SELECT *, greatest(36, floor(total / 1000 / 22 * 60 + 0.5)) AS travel FROM s), a AS (SELECT *, CAST(floor(CASE WHEN total > 0 THEN cum_m / total ELSE 0 END * travel + 0.5) + 4 * place AS BIGINT) AS arrival_min FROM t)
SELECT route_id, seq, arrival_min, arrival_min + 3 AS exit_min, CAST(greatest(travel + 4 * n, max(arrival_min + 3) OVER (PARTITION BY route_id) + 8) AS BIGINT) AS duration_min FROM a""")
def route_timings(spark: SparkSession, sf: str) -> DataFrame:
    return collection.route_timings(collection.shape_metrics(_points(spark, sf))).select("route_id", "seq", "arrival_min", "exit_min", "duration_min")


@query("""SELECT pattern_id, strftime(d, '%Y-%m-%d') AS service_date, lower(dayname(d)) AS day, pattern_id || ':' || strftime(d, '%Y-%m-%d') AS run_key FROM (SELECT p_partkey AS pattern_id, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS d FROM part)
WHERE list_contains(CASE pattern_id % 3 WHEN 0 THEN ['monday','thursday'] WHEN 1 THEN ['tuesday','friday'] ELSE ['wednesday','saturday'] END, lower(dayname(d)))""")
def schedule_expand(spark: SparkSession, sf: str) -> DataFrame:
    days = F.element_at(F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in (("monday", "thursday"), ("tuesday", "friday"), ("wednesday", "saturday"))]), (F.col("p_partkey") % 3 + 1).cast("int"))
    patterns = table(spark, sf, "part").select(F.col("p_partkey").alias("pattern_id"), days.alias("service_days"))
    return collection.expand_schedule(patterns, dt.date(2024, 1, 1), dt.date(2024, 1, 14)).select("pattern_id", F.col("service_date").cast("string").alias("service_date"), "day", "run_key")


@query(f"""SELECT id AS report_id, 'creado' AS what, created_at AS at FROM ({REPORTS_SQL})
UNION ALL SELECT l_orderkey, 'confirmado', l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey
UNION ALL SELECT id, 'estado', created_at FROM ({REPORTS_SQL}) r WHERE status <> 'nuevo' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = id)""")
def timeline_union(spark: SparkSession, sf: str) -> DataFrame:
    every, seen = reports(spark, sf), confirmations(spark, sf)
    created = every.select(F.col("id").alias("report_id"), F.lit("creado").alias("what"), F.col("created_at").alias("at"))
    confirmed = seen.join(every.select(F.col("id").alias("report_id")), "report_id").select("report_id", F.lit("confirmado").alias("what"), "at")
    changed = every.where("status <> 'nuevo'").join(seen, F.col("id") == F.col("report_id"), "left_anti").select(F.col("id").alias("report_id"), F.lit("estado").alias("what"), F.col("created_at").alias("at"))
    return created.unionByName(confirmed).unionByName(changed)


@query("""SELECT doc_id, max(quality) AS visible FROM labels WHERE quality IS NOT NULL GROUP BY 1
UNION ALL SELECT doc_id, 1 FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality IS NOT NULL)""")
def publication_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("visible"))
    return retrieval.upsert(table(spark, sf, "documents").select("doc_id", F.lit(1).alias("visible")), new, "doc_id")


@query("""WITH u AS (SELECT s_suppkey AS id, 0 AS tier FROM supplier WHERE s_nationkey % 2 = 0 UNION ALL SELECT s_suppkey, 1 FROM supplier) SELECT id, min(tier) AS tier FROM u GROUP BY 1 ORDER BY tier, id LIMIT 10""")
def vehicle_merge(spark: SparkSession, sf: str) -> DataFrame:
    trucks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    return collection.merged_vehicles(trucks.where("s_nationkey % 2 = 0").select("id"), trucks.select("id"), "id")
