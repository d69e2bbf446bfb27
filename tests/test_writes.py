"""Stored writes, CSV in splits, projection."""

import csv
import io
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from comuna.functions import projection
from comuna.operators.graph import shared_folder
from comuna.sources import csv_splits
from comuna.sources.store import Store

SCHEMA = "id long, name string, n long"


def test_store_writes_only_touched_parts(spark, tmp_path):
    rng = random.Random(1)
    store = Store.by_key(spark, f"file://{tmp_path}/s", SCHEMA, "id", 8)
    assert store.read().count() == 0 and store.delete(spark.createDataFrame([(1,)], "id long")) == []
    held = {i: (i, f"n{i}", i % 3) for i in range(300)}
    assert len(store.upsert(spark.createDataFrame(list(held.values()), SCHEMA))) == 8
    for step in range(6):
        before = store.manifest()[1]
        ids = [rng.randrange(400) for _ in range(2)]
        frame = spark.createDataFrame([(i,) for i in ids], "id long")
        touched = {r["p"] for r in frame.select(store.part().alias("p")).collect()}
        if step % 3 == 0:
            store.upsert(frame.selectExpr("id", f"'new{step}' AS name", f"{step}L AS n"))
            held |= {i: (i, f"new{step}", step) for i in ids}
        elif step % 3 == 1:
            store.delete(frame)
            for i in ids:
                held.pop(i, None)
        else:
            store.update(frame.withColumn("more", F.lit(100)), {"n": F.col("n") + F.col("more")})
            held |= {i: (i, held[i][1], held[i][2] + 100) for i in ids if i in held}
        after = store.manifest()[1]
        assert {p for p in after if after[p] != before.get(p)} | (before.keys() - after.keys()) <= touched
        assert {tuple(r) for r in store.read().collect()} == set(held.values())


def test_store_survives_a_write_that_dies(spark, tmp_path):
    store = Store.by_key(spark, f"file://{tmp_path}/s", SCHEMA, "id", 4)
    store.upsert(spark.createDataFrame([(1, "a", 1)], SCHEMA))
    bad = spark.createDataFrame([(1, "b", 1)], SCHEMA).withColumn("n", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        store.upsert(bad)
    assert [tuple(r) for r in store.read().collect()] == [(1, "a", 1)]
    assert store.upsert(spark.createDataFrame([], SCHEMA)) == [] and store.read().count() == 1


def test_purge_strikes_dates_and_rewrites_one(spark, tmp_path):
    store = Store.by_date(spark, f"file://{tmp_path}/s", "id long, at timestamp", "id", "at")
    rows = spark.range(240).select("id", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, id)").alias("at")).unionByName(spark.createDataFrame([(999, None)], "id long, at timestamp"))
    store.upsert(rows)
    before = store.manifest()[1]
    assert len(before) == 11
    assert store.purge("at", "2024-01-04 05:00:00") == ["2024-01-04"]
    after = store.manifest()[1]
    assert {p for p in after if after[p] != before[p]} == {"2024-01-04"} and before.keys() - after.keys() == {f"2024-01-0{d}" for d in (1, 2, 3)}
    assert {r["id"] for r in store.read().collect()} == {999, *range(77, 240)}
    assert store.purge("at", "2023-01-01 00:00:00") == []


def written(rng, rows, end):
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=end, quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
    writer.writerows(rows)
    return out.getvalue()


def test_csv_records_in_splits_of_any_size(tmp_path, monkeypatch):
    """Every record comes from one split only, at every split size, as Python's reader gives it from the whole file."""
    monkeypatch.setattr(csv_splits, "AHEAD", 7)
    rng = random.Random(3)
    for k in range(12):
        rows = [["".join(rng.choice('ab,"\n\r\né ') for _ in range(rng.randint(0, 9))) for _ in range(3)] for _ in range(rng.randint(1, 12))]
        data = written(rng, rows, rng.choice(["\n", "\r\n"])).encode()
        data = data if k % 3 else data.rstrip(b"\r\n")
        path = tmp_path / f"{k}.csv"
        path.write_bytes(data)
        want = list(csv.reader(io.StringIO(data.decode(), newline="")))
        for size in range(1, len(data) + 2):
            parts, quotes = [], 0
            for start in range(0, len(data), size):
                end = min(start + size, len(data))
                parts.append(csv_splits.records_of(f"file://{path}", start, end, quotes % 2 == 1))
                quotes += data[start:end].count(b'"')
            assert b"".join(parts) == data, (data, size)
            assert [r for p in parts for r in csv.reader(io.StringIO(p.decode(), newline=""))] == want


def test_read_csv_splits(spark, tmp_path):
    rng = random.Random(5)
    rows = [[str(i), rng.choice(["plain", 'with "quotes"', "two\nlines", "a,b", " padded ", ""]), "x" * rng.randint(0, 300)] for i in range(400)]
    for k in range(2):
        head = "﻿" if k == 0 else ""
        (tmp_path / f"{k}.csv").write_text(head + written(rng, [["Número id", "Texto  (largo)", "Más"], *rows[k::2], ["", "", ""]], "\r\n"), newline="")
    (tmp_path / "2.csv").write_text("Número id,Texto,Más\n")
    read = csv_splits.read_csv_splits(spark, f"file://{tmp_path}/*.csv", 1000)
    assert read.columns == ["número-id", "texto-largo", "más"] and read.rdd.getNumPartitions() > 20
    assert sorted(map(tuple, read.collect())) == sorted((a, b.strip() or None, c.strip() or None) for a, b, c in rows)
    short = tmp_path / "short"
    short.mkdir()
    (short / "a.csv").write_text("a,b\n1\n2,3,4\n\n")
    assert sorted(map(tuple, csv_splits.read_csv_splits(spark, f"file://{short}").collect())) == [("1", None), ("2", "3")]
    assert os.path.getsize(short / "a.csv") and shared_folder(spark)


def test_projection_is_true_on_the_meridian_and_back(spark):
    e2 = projection.FLATTENING * (2 - projection.FLATTENING)
    arc = lambda to, n=20_000: sum(projection.AXIS * (1 - e2) / (1 - e2 * math.sin((i + 0.5) * to / n) ** 2) ** 1.5 * to / n for i in range(n))
    points = [(lat, -57.0) for lat in (-55.0, -25.2637, -1.0, 0.0)]
    frame = spark.createDataFrame(points, "lat double, lon double")
    for (lat, _), row in zip(points, frame.select(*[c.alias(n) for n, c in zip("xy", projection.to_metres(F.col("lat"), F.col("lon"), 21))]).collect()):
        assert abs(row["x"] - 500_000) < 1e-6 and abs(row["y"] - (10_000_000 + 0.9996 * arc(math.radians(lat)))) < 1e-3
    grid = spark.range(2000).select((-40 + F.col("id") % 50 * 0.8).alias("lat"), (-60.5 + F.floor(F.col("id") / 50) * 0.17).alias("lon"))
    x, y = projection.to_metres(F.col("lat"), F.col("lon"), 21)
    back = grid.withColumns({"x": x, "y": y})
    lat, lon = projection.to_degrees(F.col("x"), F.col("y"), 21)
    far = back.select(F.max(F.abs(lat - F.col("lat"))).alias("a"), F.max(F.abs(lon - F.col("lon"))).alias("b")).first()
    assert far["a"] < 9e-9 and far["b"] < 9e-9  # a millimetre
    assert spark.range(1).select(projection.to_degrees(F.lit(None).cast("double"), F.lit(1.0), 21)[0].alias("x")).first()["x"] is None


def test_tasks_of_csv_splits_follow_the_bytes_not_the_splits(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n" + "".join(f'{i},"x\ny{i}"\n' for i in range(3000)))
    read = csv_splits.read_csv_splits(spark, f"file://{tmp_path}/*.csv", 50)
    assert sorted(int(r["a"]) for r in read.collect()) == list(range(3000)) and {r["b"][:3] for r in read.take(5)} == {"x\ny"}
    assert read.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
