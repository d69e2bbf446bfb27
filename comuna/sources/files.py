"""File sources and sinks: GeoJSON, CSV uploads, zipped entries, transit CSV, merged tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import csv_field
from ..operators.collection import ZONE


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: ``properties`` (map) and ``geometry`` (JSON text); collections and single features alike."""
    raw = spark.read.text(path, wholetext=True)
    kind = "struct<type:string,features:array<string>>"
    parsed = raw.select("value", F.from_json("value", kind).alias("c"))
    feature = F.explode(F.when(F.col("c.type") == "FeatureCollection", F.col("c.features")).otherwise(F.array("value"))).alias("feature")
    return parsed.select(feature).select(F.from_json(F.get_json_object("feature", "$.properties"), "map<string,string>").alias("properties"), F.get_json_object("feature", "$.geometry").alias("geometry"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted fields with commas and line breaks; headers become hyphenated slugs; wholly empty rows go."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    slugs = ["-".join("".join(c if c.isalnum() else " " for c in name.lower()).split()) for name in df.columns]
    return df.toDF(*slugs).dropna("all")


def read_zip_entries(spark: SparkSession, path: str, ending: str) -> DataFrame:
    """``archive``, ``entry``, ``text`` of every entry with that ending in the archives under ``path``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows = [(name, e, z.read(e).decode("utf-8", "replace")) for e in sorted(z.namelist()) if e.endswith(ending)]
                yield pd.DataFrame(rows, columns=["archive", "entry", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, entry string, text string")


def transit_lines(rows: DataFrame) -> DataFrame:
    """Each row as a line of transit CSV (``line``); the header is the sink's."""
    return rows.select(F.concat_ws(",", *[csv_field(F.col(f"`{c}`")) for c in rows.columns]).alias("line"))


def write_transit_csv(rows: DataFrame, path: str) -> None:
    """A folder of CSV part files with CRLF line ends; the header goes to ``_header`` beside them."""
    transit_lines(rows).write.mode("overwrite").text(path, lineSep="\r\n")
    rows.sparkSession.createDataFrame([(",".join(rows.columns),)], "line string").coalesce(1).write.mode("overwrite").text(f"{path}/_header", lineSep="\r\n")


def feed(rows: DataFrame) -> DataFrame:
    """Each row as JSON text (``json``)."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def feature_collection(features: list[dict]) -> str:
    return json.dumps({"type": "FeatureCollection", "features": features})


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """Keeps ``name``, ``digest`` and ``content`` in folders by the first two signs of the digest, so that one artifact is read without the others."""
    rows.select("name", "digest", "content", F.left("digest", F.lit(2)).alias("prefix")).write.mode("append").partitionBy("prefix").parquet(folder)


def read_artifacts(spark: SparkSession, folder: str, digest: str | None = None) -> DataFrame:
    """All artifacts, or those of one digest from its folder alone."""
    kept = spark.read.schema("name string, digest string, content string, prefix string").parquet(folder)
    return (kept if digest is None else kept.where((F.col("prefix") == digest[:2]) & (F.col("digest") == digest))).drop("prefix")


def vehicle_entities(vehicles: DataFrame, at: int, updates: bool = False) -> DataFrame:
    """``vehicle_id``, ``json``: the header and an entity for every vehicle of a realtime feed, of positions or of trip updates.

    ``vehicles`` has ``vehicle_id``, ``label``, ``trip_id``, ``route_id``, ``lat``, ``lon``, ``stop_id``; ``at`` is the feed's second. A row a line, so that a feed
    of any size is written by many tasks; the header has no vehicle.
    """
    trip = F.struct(F.col("trip_id").alias("tripId"), F.col("route_id").alias("routeId")).alias("trip")
    own = F.struct(F.col("vehicle_id").alias("id"), F.coalesce("label", "vehicle_id").alias("label")).alias("vehicle")
    stamp = F.lit(at).cast("long").alias("timestamp")
    if updates:
        body = F.struct(F.col("trip_id").alias("id"), F.struct(trip, own, F.array().cast("array<string>").alias("stopTimeUpdate"), stamp).alias("tripUpdate"))
    else:
        position = F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("position")
        body = F.struct(F.col("vehicle_id").alias("id"), F.struct(trip, own, position, F.lit("IN_TRANSIT_TO").alias("currentStatus"), F.col("stop_id").alias("stopId"), stamp).alias("vehicle"))
    head = F.struct(F.struct(F.lit("2.0").alias("gtfsRealtimeVersion"), F.lit("FULL_DATASET").alias("incrementality"), stamp, F.lit(ZONE).alias("timeZone")).alias("header"))
    keep = {"ignoreNullFields": "false"}
    header = vehicles.sparkSession.range(1).select(F.lit(None).cast(dict(vehicles.dtypes)["vehicle_id"]).alias("vehicle_id"), F.to_json(head, keep).alias("json"))
    return header.unionByName(vehicles.select("vehicle_id", F.to_json(body, keep).alias("json")))


def full_feed(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """``section``, ``order`` (what the section is ordered by, as an array of strings), ``json``: every record of the feed's tables as a line."""
    lines = [rows.select(F.lit(name).alias("section"), F.array(*[F.col(c).cast("string") for c in order]).alias("order"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json")) for name, (rows, order) in tables.items()]
    return reduce(DataFrame.unionByName, lines)
