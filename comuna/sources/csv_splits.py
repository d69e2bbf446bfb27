"""Quoted CSV of any size in splits, where fields may hold line breaks.

A first pass counts the quotes of every split. Whether a split begins inside a quoted field follows from the parity of all quotes
before it, so each split finds its first record on its own, and a record belongs to the split that it begins in.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a split; bytes that are read beyond it at a time for the record that runs over its end.
SPLIT, AHEAD = 32 << 20, 1 << 16


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def splits_of(spark: SparkSession, path: str, size: int) -> DataFrame:
    """``path``, ``start``, ``end`` of the splits of the files under ``path``; files are only listed."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long")))
    return files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + size, "length").alias("end"))


def record_ends(data: bytes, inside: bool) -> Iterator[int]:
    """The places just behind each line break that ends a record, if the data begins inside quotes or not."""
    at = 0
    while True:
        stop = data.find(b'"' if inside else b"\n", at)
        if inside:
            if stop < 0:
                return
            inside, at = False, stop + 1
            continue
        quote = data.find(b'"', at, stop if stop >= 0 else len(data))
        if quote >= 0:
            inside, at = True, quote + 1
        elif stop < 0:
            return
        else:
            yield stop + 1
            at = stop + 1


def records_of(path: str, start: int, end: int, inside: bool) -> bytes:
    """The bytes of the records that begin in [start, end), whole, if the split begins inside quotes or not."""
    with _open(path) as f:
        total = f.size()
        before = b"\n"
        if start:
            f.seek(start - 1)
            before = f.read(1)
        f.seek(start)
        data = f.read(end - start)
        # A split begins with a record only where the byte before it ends one outside quotes.
        first = 0 if before == b"\n" and not inside else next(record_ends(data, inside), len(data))
        data = bytearray(data[first:])
        last = 0
        for last in record_ends(bytes(data), False):  # noqa: B007  where the last whole record ends
            pass
        at, stop = end, None
        while last < len(data) and stop is None and at < total:
            f.seek(at)
            more = f.read(min(max(AHEAD, len(data) - last), total - at))  # twice as much each time
            at += len(more)
            data += more
            stop = next(record_ends(bytes(data[last:]), False), None)
        return bytes(data if stop is None else data[: last + stop])


def read_csv_splits(spark: SparkSession, path: str, size: int = SPLIT) -> DataFrame:
    """The rows of quoted CSV files under ``path`` (a URI), all columns as strings, with the first record of the first file as the header of all.

    Headers become hyphenated slugs, fields are trimmed, missing fields are null, wholly empty rows go. Two quotes in a quoted field
    are one; a quote elsewhere than at a field's ends is no valid CSV. A task reads one split of ``size`` bytes after the other, about ``SPLIT`` bytes in all, whatever the size of a file; counts of quotes are collected, a row a split.
    """
    found = splits_of(spark, path, size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quotes = []
            for row in batch.to_pylist():
                with _open(row["path"]) as f:
                    f.seek(row["start"])
                    quotes.append(f.read(row["end"] - row["start"]).count(b'"'))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(quotes, pa.int64())], names=["path", "start", "end", "quotes"])

    size_of = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("bytes")).first()
    tasks = max(1, min(size_of["n"], max(8 * spark.sparkContext.defaultParallelism, -(-size_of["bytes"] // SPLIT))))
    spread = found.repartition(tasks)
    counted = sorted((r["path"], r["start"], r["end"], r["quotes"]) for r in spread.mapInArrow(count, "path string, start long, end long, quotes long").collect())
    rows, before, last = [], 0, None
    for name, start, end, quotes in counted:
        before = before if name == last else 0
        rows.append((name, start, end, before % 2 == 1))
        before, last = before + quotes, name
    if not rows:
        raise ValueError(f"no file under {path}")
    head = next(csv.reader(io.StringIO(records_of(rows[0][0], 0, min(rows[0][2], AHEAD), False).decode("utf-8-sig"), newline=""), skipinitialspace=True), [])
    names = ["-".join("".join(c if c.isalnum() else " " for c in name.lower()).split()) or f"column-{i}" for i, name in enumerate(head)]
    width = len(names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = records_of(row["path"], row["start"], row["end"], row["inside"]).decode("utf-8" if row["start"] else "utf-8-sig", "replace")
                records = csv.reader(io.StringIO(text, newline=""), skipinitialspace=True)
                if row["start"] == 0:
                    next(records, None)
                held = []
                for record in records:
                    fields = [x.strip() or None for x in record[:width]]
                    if any(fields):
                        held.append(fields + [None] * (width - len(fields)))
                    if len(held) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=[f"c{i}" for i in range(width)])
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names=[f"c{i}" for i in range(width)])

    dealt = spark.createDataFrame(rows, "path string, start long, end long, inside boolean").repartition(tasks)
    return dealt.mapInArrow(parse, ", ".join(f"c{i} string" for i in range(width))).toDF(*names)
