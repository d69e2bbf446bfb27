"""Incidents without towns, slugs, nearest places, vector texts, administration: small cases and plain loops."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from comuna.operators import dashboards, incidents, vectors, zones
from comuna.sources import files
from tests.test_operators import one


def metres(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6_371_000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_incidents_without_towns_are_a_plain_loop(spark):
    rng = random.Random(12)
    bands, born = ("alta", "media", "baja"), dt.datetime(2024, 1, 1)
    rows = [(i, i % 3, rng.choice(["nuevo", "resuelto", "descartado", "verificado"]), -25.3 + rng.uniform(0, 0.004), -57.6 + rng.uniform(0, 0.004), rng.choice(bands), rng.randint(0, 100), rng.choice(bands), f"k{i % 2}", rng.randint(0, 4), born + dt.timedelta(hours=rng.randint(0, 99)), rng.random() < 0.1) for i in range(220)]
    schema = "id long, municipality long, status string, lat double, lon double, priority_band string, priority_score long, severity string, kind string, confirmations long, created_at timestamp, overridden boolean"
    frame = spark.createDataFrame(rows, schema).withColumn("municipality", F.lit(0))
    found = dashboards.copied_roll_up(frame.join(incidents.cluster(frame, 60.0).select("id", "incident_id"), "id"), "incident_id")
    clusters = []
    for r in sorted((r for r in rows if r[2] != "descartado"), key=lambda r: (bands.index(r[5]), -r[10].timestamp(), r[0])):
        near = [(metres(r[3], r[4], c["lat"], c["lon"]), i) for i, c in enumerate(clusters) if c["done"] == (r[2] == "resuelto")]
        best = min(near, default=(1e9, 0))
        if best[0] > 60.0:
            clusters.append({"lat": r[3], "lon": r[4], "done": r[2] == "resuelto", "rows": [r]})
            continue
        mine = clusters[best[1]]
        mine["rows"].append(r)
        mine["lat"], mine["lon"] = (sum(x[k] for x in mine["rows"]) / len(mine["rows"]) for k in (3, 4))
    want = {}
    for c in clusters:
        first, top = min(c["rows"], key=lambda r: (r[10], r[0])), max(c["rows"], key=lambda r: (r[11], r[6], r[9], -r[0]))
        want[first[0]] = (len(c["rows"]), sum(r[9] for r in c["rows"]), top[8], top[5], top[6], top[11])
    assert {r["incident_id"]: (r["reports"], r["confirmations"], r["kind"], r["priority_band"], r["priority_score"], r["overridden"]) for r in found.collect()} == want


def test_slugs_move_on_past_made_ones(spark):
    names = [("a", "1"), ("a", "1"), ("a-1", "2"), ("a", "1"), ("a-1-2", ""), ("a", "1"), ("", ""), ("", ""), ("", "7"), ("a", "")]
    rows = spark.createDataFrame([(i, 0, b, c) for i, (b, c) in enumerate(names)] + [(99, 1, "a", "1"), (100, None, "a", "1")], "n int, town int, b string, c string")
    got = {r["n"]: r["slug"] for r in zones.unique_slugs(rows, F.col("b"), F.col("c"), "n", "town").collect()}
    used, want = set(), {99: "a", 100: "a"}
    for i, (b, c) in enumerate(names):
        b, slug = b or f"barrio-{c or 'sin-codigo'}", None
        for slug in (b, f"{b}-{c or 'dup'}", *(f"{b}-{c or 'dup'}-{k}" for k in range(2, 99))):
            if slug not in used:
                break
        used.add(slug)
        want[i] = slug
    assert got == want


def test_nearest_however_far(spark):
    points = spark.createDataFrame([(1, -25.0, -57.0), (2, 60.0, 100.0), (3, None, 1.0), (4, 25.0, 123.0), (5, -25.0, -57.0001)], "id long, lat double, lon double")
    places = spark.createDataFrame([(10, -25.001, -57.0), (11, 10.0, 10.0), (12, -25.001, -57.0)], "place_id long, place_lat double, place_lon double")
    rows = {r["id"]: r["place_id"] for r in zones.nearest(points, places, 200.0).collect()}
    spots = {10: (-25.001, -57.0), 11: (10.0, 10.0)}
    assert rows == {i: min(spots, key=lambda k: metres(lat, lon, *spots[k])) for i, lat, lon in [(1, -25.0, -57.0), (2, 60.0, 100.0), (4, 25.0, 123.0), (5, -25.0, -57.0001)]}
    assert zones.nearest(points, places.limit(0)).count() == 0


def test_vector_texts(spark):
    text = lambda v, n: one(spark, vectors.vector_text(vectors.parse_vector(F.lit(v)), n))
    assert text("[1, 2.5, null]", 3) == "[1,2.5,0]" and text("[1]", 2) is None and text("{}", 0) == "[]" and text(None, 1) is None and text("x", 1) is None


def test_administration(spark):
    reports = spark.createDataFrame([(1, "nuevo", "media"), (2, "nuevo", "baja")], "id long, status string, priority_band string")
    changes = spark.createDataFrame([(1, 1, None, "alta", None), (1, 2, "nuevo", "alta", " "), (1, 3, "resuelto", None, "listo"), (1, 4, None, None, "nota"), (9, 1, "nuevo", None, "x"), (2, 1, None, "baja", None)], "id long, step int, status string, priority_band string, note string")
    got = [tuple(r) for r in dashboards.admin_changes(reports, changes, "step").orderBy("id", "step").collect()]
    assert got == [(1, 1, "nuevo", "nuevo", "alta", "Prioridad manual: alta."), (1, 3, "nuevo", "resuelto", "alta", "listo"), (1, 4, "resuelto", "resuelto", "alta", "nota")]
    jobs = spark.createDataFrame([(1, "[3,7,7,4]", None), (2, "[1]", "{}"), (3, "[7]", '{"a":"b"}'), (4, None, None)], "job_id long, seed_ids string, stats string")
    assert {r["job_id"]: (r["seed_ids"], r["stats"]) for r in dashboards.without_seed(jobs, 7, "ya").collect()} == {1: ("[3,4]", '{"lastEventMessage":"ya"}'), 3: ("[]", '{"a":"b","lastEventMessage":"ya"}')}


def test_empty_feeds(spark):
    none = spark.createDataFrame([], "vehicle_id string, label string, trip_id string, route_id string, lat double, lon double, stop_id string")
    assert files.vehicle_entities(none, 5).count() == 1 and files.vehicle_entities(none, 5, True).first()["json"].startswith('{"header"')
