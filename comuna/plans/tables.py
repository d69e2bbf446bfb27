"""The driver's tables in the roles that the operators work on."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.incidents import STATUSES, TYPES

UTC = dt.timezone.utc
#: The current time of the orders' and of the events' world.
NOW = dt.datetime(1999, 1, 1, tzinfo=UTC)
EVENTS_NOW = dt.datetime(2024, 1, 25, tzinfo=UTC)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latitude(key: Column) -> Column:
    return F.lit(-25.38) + ((key * 7919) % 10007) / F.lit(10007.0) * F.lit(0.19)


def longitude(key: Column) -> Column:
    return F.lit(-57.68) + ((key * 104729) % 10009) / F.lit(10009.0) * F.lit(0.19)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident reports: orders."""
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    severity = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "alta").when(F.col("o_orderpriority") == "3-MEDIUM", "media").otherwise("baja")
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("id"), F.col("o_custkey").alias("reporter"), pick(STATUSES).alias("status"), pick(TYPES).alias("kind"), severity.alias("severity"),
        F.col("o_orderdate").alias("created_at"), latitude(key).alias("lat"), longitude(key).alias("lon"),
    )


def confirmations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmations: line items."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("confirmer"), F.col("l_shipdate").alias("at"))


#: The same reports for the SQL side.
REPORTS_SQL = f"""
SELECT o_orderkey AS id, o_custkey AS reporter,
  ({list(STATUSES)})[CAST(o_orderkey % {len(STATUSES)} + 1 AS INT)] AS status,
  ({list(TYPES)})[CAST(o_orderkey % {len(TYPES)} + 1 AS INT)] AS kind,
  CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'alta' WHEN o_orderpriority = '3-MEDIUM' THEN 'media' ELSE 'baja' END AS severity,
  o_orderdate AS created_at,
  -25.38 + CAST((o_orderkey * 7919) % 10007 AS DOUBLE) / 10007.0 * 0.19 AS lat, -57.68 + CAST((o_orderkey * 104729) % 10009 AS DOUBLE) / 10009.0 * 0.19 AS lon
FROM orders
"""
COUNTED_SQL = f"""
SELECT r.*, coalesce(n, 0) AS confirmations FROM ({REPORTS_SQL}) r
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) c ON c.l_orderkey = r.id
"""
SCORED_SQL = f"""
SELECT *, CASE WHEN priority_score >= 75 THEN 'alta' WHEN priority_score >= 45 THEN 'media' ELSE 'baja' END AS priority_band FROM (
  SELECT *, CAST(least(greatest(
    CASE severity WHEN 'alta' THEN 34 WHEN 'media' THEN 22 ELSE 12 END
    + CASE kind WHEN 'bache_aislado' THEN 6 WHEN 'conjunto_de_baches' THEN 12 ELSE 18 END
    + least(confirmations * 8, 24)
    + least(floor(greatest(0, (epoch_us(TIMESTAMP '1999-01-01') - epoch_us(created_at)) / 86400000000.0) * 2 + 0.5), 18), 0), 100) AS BIGINT) AS priority_score
  FROM ({COUNTED_SQL}))
"""
