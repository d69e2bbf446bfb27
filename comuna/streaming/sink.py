"""A notification sink that a replayed batch does not double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What is said where a broadcast has no text. Fixed value.
MESSAGE = "El recolector aviso que el recorrido esta por iniciar."


def _asked(broadcasts: DataFrame) -> DataFrame:
    """A row for every zone of a broadcast, with the channel of delivery that it wants and what it says."""
    zones = F.array_distinct(F.filter(F.transform("zones", lambda z: F.trim(z)), lambda z: z != ""))
    wanted = F.nullif(F.nullif(F.trim("channel"), F.lit("")), F.lit("all"))
    said = F.coalesce(F.nullif(F.trim("message"), F.lit("")), F.lit(MESSAGE))
    return broadcasts.select("broadcast_id", F.explode(zones).alias("zone"), wanted.alias("wanted"), said.alias("message"))


def _reached(subscribers: DataFrame) -> DataFrame:
    """A row for every channel of delivery of the active subscribers."""
    channels = F.when(F.col("channel").isin("both", "all"), F.array(F.lit("panel"), F.lit("email"))).otherwise(F.array("channel"))
    return subscribers.where("active AND user_id IS NOT NULL").select("subscriber_id", "user_id", "zone", "email", F.explode(channels).alias("delivery"))


def deliveries(broadcasts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """A row for every active subscriber of a broadcast's zones and channel of delivery.

    ``broadcasts`` has ``broadcast_id``, ``zones`` (array), ``channel`` (null, empty or all: any), ``message``; ``subscribers``
    ``subscriber_id``, ``user_id``, ``zone``, ``channel`` (both and all: panel and email), ``active``, ``email``. Zones asked for twice, or blank, count
    once, or not at all. Subscribers without a user or not active get nothing.
    """
    met = _asked(broadcasts).join(_reached(subscribers), "zone").where("wanted IS NULL OR delivery = wanted")
    return met.select("broadcast_id", "subscriber_id", "user_id", "zone", "delivery", "message", "email")


def delivery_counts(broadcasts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """``email_counts`` of the ``deliveries``, with their least ``message``, without listing them: subscribers are counted by zone first."""
    mail, has = F.col("delivery") == "email", F.coalesce(F.trim("email") != "", F.lit(False))
    counted = _reached(subscribers).groupBy("zone", "delivery").agg(F.count(F.lit(1)).alias("n"), F.count_if(mail & has).alias("with"), F.count_if(mail & ~has).alias("without"))
    met = _asked(broadcasts).join(counted, "zone").where("wanted IS NULL OR delivery = wanted")
    return met.groupBy("broadcast_id").agg(F.sum("n").alias("count"), F.sum("with").alias("attempted"), F.sum("without").alias("skipped"), F.min("message").alias("message"))


def email_counts(rows: DataFrame) -> DataFrame:
    """``broadcast_id``, ``count``, ``attempted`` (mails with an address), ``skipped`` (mails without one)."""
    mail, has = F.col("delivery") == "email", F.coalesce(F.trim("email") != "", F.lit(False))
    return rows.groupBy("broadcast_id").agg(F.count(F.lit(1)).alias("count"), F.count_if(mail & has).alias("attempted"), F.count_if(mail & ~has).alias("skipped"))


def notification_sink(folder: str, subscribers: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: a batch's deliveries and counts go to folders of its number, which a replay writes anew.

    The number is the same when Spark runs a batch again after a failure, so every delivery is there once. Subscribers are read for
    each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = deliveries(batch, subscribers())
        rows.write.mode("overwrite").parquet(f"{folder}/deliveries/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{folder}/deliveries/batch={number}")
        email_counts(stored).write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    return write


def read_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/deliveries")
