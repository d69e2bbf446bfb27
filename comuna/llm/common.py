"""Helpers that several training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one table through Spark, so that any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on one machine, where the session has none (tests), is a folder under the temporary folder set and used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", uuid.uuid4().hex)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the shared folder: survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, column: str, parts: int) -> list[int]:
    """At most ``parts - 1`` values of an integer column that cut it into parts of about equal row counts.

    A mergeable quantile sketch computes them, so the driver receives one short list whatever the size of ``df``.
    Nulls are ignored; an empty table gives no bounds.
    """
    if parts < 2:
        return []
    shares = ",".join(repr(i / parts) for i in range(1, parts))
    row = df.agg(F.expr(f"percentile_approx(`{column}`, array({shares}), {max(10_000, 20 * parts)})")).first()
    return sorted(set(row[0] or []))


def bucket_of(column: str, bounds: list[int]) -> Column:
    """How many bounds are at or below the value: the number of its range. Null goes to range 0.

    Two levels of literal arrays keep the work per row near twice the square root of the number of bounds.
    """
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    lists = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    array = lambda xs: "array(" + ",".join(f"{x}L" if x > -(2**63) else f"({x + 1}L - 1L)" for x in xs) + ")"
    coarse = f"size(filter({array([x[0] for x in lists])}, b -> b <= `{column}`))"
    fine = f"size(filter(element_at(array({','.join(map(array, lists))}), {coarse}), b -> b <= `{column}`))"
    return F.expr(f"CASE WHEN `{column}` IS NULL OR `{column}` < {array(bounds[:1])}[0] THEN 0 ELSE ({coarse} - 1) * {step} + {fine} END").cast("int")


def deal_by_range(df: DataFrame, column: str) -> DataFrame:
    """Deals rows out by ranges of a long column, so that partition p holds only smaller values than partition p + 1.

    Adds ``_range``. Nulls go to the first range.
    """
    bounds = range_bounds(df, column, shuffle_partitions(df.sparkSession))
    return df.withColumn("_range", bucket_of(column, bounds)).repartitionById(len(bounds) + 1, F.col("_range"))


def out_dir(spark: SparkSession, kind: str) -> str:
    """A new folder, as a URI, in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """The pyarrow file system of a URI and the path in it: local, HDFS or an object store, from driver or executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, suffix: str):
    """Opens a file of this task attempt in ``folder``: its URI and a binary output stream.

    Every attempt has a name of its own. What counts is the list of names that successful tasks return, so files of lost
    executors are never read.
    """
    from pyspark import TaskContext

    task = TaskContext.get()
    uri = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}{suffix}"
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    return uri, system.open_output_stream(f"{path}/{uri.rpartition('/')[2]}", compression=None)


def open_file(uri: str):
    """A file of ``new_file`` for random access."""
    system, path = open_fs(uri)
    return system.open_input_file(path)


#: Rows of one key that meet its counterpart in one task at most, unless the table is so large that the keys above it could be
#: more than ``BROADCAST_KEYS``.
FREQUENT, BROADCAST_KEYS = 200, 100_000


def lookup(rows: DataFrame, found: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Left join of ``rows`` with ``found``, which has one row a key and in ``count`` how many of the ``total`` rows have it.

    Rows of frequent keys stay where they are and their counterparts are broadcast, so no key's rows gather in one task. Of
    keys with more than ``total / BROADCAST_KEYS`` rows there are fewer than ``BROADCAST_KEYS``, whatever the data. ``count`` is
    dropped; both inputs are read more than once, so they should be cheap to read.
    """
    limit = max(FREQUENT, total // BROADCAST_KEYS)
    frequent = F.broadcast(found.where(F.col(count) > limit).drop(count))
    rare = rows.join(frequent.select(key), key, "left_anti").join(found.where(F.col(count) <= limit).drop(count), key, "left")
    return rare.unionByName(rows.join(frequent, key))


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as no column of ``columns`` has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def quoted(name: str) -> str:
    """A column name for Spark's parser, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def fields_of(df: DataFrame, names=None) -> str:
    """The schema string of some columns (all by default) of ``df``, each followed by a comma."""
    kept = df.columns if names is None else names
    return "".join(f"{quoted(f.name)} {f.dataType.simpleString()}, " for f in df.schema if f.name in kept)


def append_by_arrow(df: DataFrame, added: dict[str, str], make) -> DataFrame:
    """``df`` with the columns ``added`` (name: type) behind its own, worked out in Arrow batches; columns of these names are replaced.

    ``make()`` is called once a task and gives a function from a batch to pairs of a part of it and the new columns' arrays.
    Inside, columns go by number, so that names may hold any signs.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in {name.lower() for name in added}])
    names = [f"c{i}" for i in range(len(df.columns) + len(added))]

    def run(batches):
        work = make()
        for batch in batches:
            for part, arrays in work(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=names)

    own = df.toDF(*names[: len(df.columns)])
    found = own.mapInArrow(run, fields_of(own) + ", ".join(f"{n} {kind}" for n, kind in zip(names[len(df.columns) :], added.values(), strict=True)))
    return found.toDF(*df.columns, *added)
