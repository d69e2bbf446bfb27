"""A keyed table in folders that upsert, delete, update and purge rewrite only where they must.

Rows lie in parts: buckets of the key's hash, or dates. Every write puts the parts that it touches into a new folder and then adds
a manifest, a small table that says where each part is now; readers take the newest manifest, so they see a write whole or not at
all, and a write that dies leaves the old one in force. Parts that a write does not touch are neither read nor written.
One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of a part when it is written, so that a large date is no single task's work.
FILES = 4
_MANIFEST = "part string, path string"


class Store:
    """Rows with a unique key, by parts."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, part: Callable[[], Column]):
        self.spark, self.folder, self.schema, self.key, self.part = spark, folder.rstrip("/"), schema, key, part

    @classmethod
    def by_key(cls, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 64) -> Store:
        return cls(spark, folder, schema, key, lambda: F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"))

    @classmethod
    def by_date(cls, spark: SparkSession, folder: str, schema: str, key: str, when: str) -> Store:
        """Rows without a time lie in a part of their own."""
        return cls(spark, folder, schema, key, lambda: F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("none")))

    def manifest(self) -> tuple[int, dict[str, str]]:
        """The newest version and where its parts are: one row a part. Version 0 has none."""
        try:
            every = self.spark.read.schema(f"{_MANIFEST}, version long").parquet(f"{self.folder}/manifest")
        except Exception as e:  # noqa: BLE001  no folder yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0, {}
        newest = every.agg(F.max("version")).first()[0] or 0
        return newest, {r["part"]: r["path"] for r in every.where(F.col("version") == newest).collect() if r["part"] is not None}

    def _read(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*sorted(paths))

    def read(self) -> DataFrame:
        return self._read(list(self.manifest()[1].values()))

    def _touched(self, changes: DataFrame) -> list[str]:
        """The parts of some rows: at most as many as there are parts."""
        return [r["part"] for r in changes.select(self.part().alias("part")).distinct().collect()]

    def _replace(self, parts: list[str], rows: DataFrame | None, version: int, held: dict[str, str]) -> list[str]:
        """Writes ``rows`` as the whole content of ``parts`` and adds a manifest; returns the parts written."""
        folder, written = f"{self.folder}/data-{uuid.uuid4().hex}", []
        if rows is not None:
            placed = rows.withColumn("_part", self.part())
            placed.repartition("_part", F.pmod(F.xxhash64(self.key), F.lit(FILES))).write.partitionBy("_part").parquet(folder)
            try:
                written = [r["_part"] for r in self.spark.read.schema(f"{self.schema}, _part string").parquet(folder).select("_part").distinct().collect()]
            except Exception as e:  # noqa: BLE001  nothing was written
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        new = {k: v for k, v in held.items() if k not in parts} | {p: f"{folder}/_part={p}" for p in written}
        listed = self.spark.createDataFrame(list(new.items()) or [(None, None)], _MANIFEST)
        listed.coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest/version={version + 1}")
        return written

    def upsert(self, changes: DataFrame) -> list[str]:
        """Rows replace those of the same key, or are new; of several changes of one key any one counts. Returns the parts written.

        A store by date finds a key only in the date that the change has.
        """
        changes = changes.select(*self.read().columns).dropDuplicates([self.key])
        version, held = self.manifest()
        parts = self._touched(changes)
        old = self._read([held[p] for p in parts if p in held])
        return self._replace(parts, old.join(changes.select(self.key), self.key, "left_anti").select(*changes.columns).unionByName(changes), version, held)

    def delete(self, keys: DataFrame) -> list[str]:
        """Takes the rows with these keys out of the parts that the keys belong to (columns: the key, and the time of a store by date)."""
        version, held = self.manifest()
        parts = [p for p in self._touched(keys) if p in held]
        if not parts:
            return []
        return self._replace(parts, self._read([held[p] for p in parts]).join(keys.select(self.key), self.key, "left_anti"), version, held)

    def update(self, changes: DataFrame, values: dict[str, Column]) -> list[str]:
        """Sets ``values``, expressions over the row and the columns of ``changes`` (the key and others), where a key is met; adds no row."""
        version, held = self.manifest()
        changes = changes.dropDuplicates([self.key])
        parts = [p for p in self._touched(changes) if p in held]
        if not parts:
            return []
        old = self._read([held[p] for p in parts])
        met = old.join(changes.withColumn("_met", F.lit(True)), self.key, "left")
        new = met.select(*[F.when(F.col("_met"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
        return self._replace(parts, new, version, held)

    def purge(self, when: str, limit: str) -> list[str]:
        """Drops rows of a store by date before the time ``limit`` (``yyyy-MM-dd HH:mm:ss``): whole dates are only struck from the manifest, the limit's own is rewritten."""
        version, held = self.manifest()
        gone = [p for p in held if p != "none" and p < limit[:10]]
        edge = [p for p in held if p == limit[:10]]
        if not gone and not edge:
            return []
        kept = self._read([held[p] for p in edge]).where(F.col(when) >= F.lit(limit).cast("timestamp")) if edge else None
        return self._replace(gone + edge, kept, version, held)
