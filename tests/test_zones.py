"""Zone coverings of any size against the polygons themselves."""

import math
import random

import pytest
from pyspark.sql import functions as F

from comuna.functions import rules, urls
from comuna.operators import chunks, zones
from tests.test_operators import one

POLYGONS = "zone_id int, label string, polygons array<array<array<struct<lon:double,lat:double>>>>"


def star(rng, lat, lon, degrees, corners=9):
    turn = rng.random()
    return [{"lon": lon + degrees * rng.uniform(0.3, 1) * math.cos(2 * math.pi * (i + turn) / corners), "lat": lat + degrees * rng.uniform(0.3, 1) * math.sin(2 * math.pi * (i + turn) / corners)} for i in range(corners)]


def inside(lat, lon, ring):
    return sum((a["lat"] > lat) != (b["lat"] > lat) and lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


@pytest.mark.parametrize("holes", [False, True])
def test_zones_from_a_street_to_a_country(spark, holes):
    rng = random.Random(11)
    shapes = []
    for i, metres in enumerate([100, 100, 500, 3_000, 3_000, 20_000, 100_000, 400_000, 1_000_000]):
        lat, lon, wide = rng.uniform(-27, -23), rng.uniform(-60, -55), metres / 220_000
        shapes.append((i, f"z{i % 4}", [[star(rng, lat, lon, wide), star(rng, lat, lon, wide / 4)]] + ([[star(rng, lat + 3 * wide, lon, wide)]] if i % 2 else [])))
    shapes += [(50, "a", []), (51, "a", None), (52, "a", [[]]), (53, "a", [[[{"lon": -57.0, "lat": -25.0}] * 3]]), (54, "a", [[[{"lon": -10.0, "lat": 60.0}, {"lon": 20.0, "lat": 60.0}, {"lon": 20.0, "lat": 60.0001}]]])]
    points = []
    for i in range(3000):
        zone = shapes[rng.randrange(9)][2]
        corner, wide = rng.choice(zone[0][0]), abs(zone[0][0][0]["lon"] - zone[0][0][4]["lon"])
        points.append((i, corner["lat"] + rng.gauss(0, wide), corner["lon"] + rng.gauss(0, wide)))
    points += [(9000, None, 1.0), (9001, -25.0, None), (9002, -89.9, 179.9), (9003, 60.00001, 15.0)]
    hit = lambda lat, lon, polygons: any((inside(lat, lon, p[0]) and not any(inside(lat, lon, r) for r in p[1:])) if holes else any(inside(lat, lon, r) for r in p) for p in polygons or [] if p and p[0])
    want = {}
    for i, lat, lon in points:
        found = [(label, z) for z, label, polygons in shapes if lat is not None and lon is not None and hit(lat, lon, polygons)]
        if found:
            want[i] = min(found)[1]
    frame = spark.createDataFrame(shapes, POLYGONS)
    got = zones.in_zone(spark.createDataFrame(points, "id long, lat double, lon double"), frame, holes)
    assert {r["id"]: r["zone_id"] for r in got.collect()} == want and len(want) > 1000
    cells = zones.covers(frame, holes).groupBy("zone_id").agg(F.count("*").alias("n"), F.count_if("whole").alias("whole")).collect()
    assert max(r["n"] for r in cells) <= 4 * zones.COVER and sum(r["whole"] for r in cells) > 100
    assert zones.in_zone(spark.createDataFrame(points, "id long, lat double, lon double"), frame.limit(0), holes).count() == 0


def test_crawled_items(spark):
    schema = "item_id long, source_type string, url string, canonical_url string, page_url string, title string, summary string, text string, visible boolean"
    long = "Una frase con varias palabras que sigue. " * 60
    rows = [
        (7, "html", "https://a.py/tramites/x", None, None, "Patente comercial", None, long, True),
        (8, "html", "https://a.py/b", None, None, "Servicio de agua", "El resumen dice que hay un turno.", "", True),
        (9, "pdf", "", "https://a.py/category/Licencias/", None, "Un título largo de treinta letras.", None, None, True),
        (10, "html", "https://a.py/category/x", None, None, "Lista", None, long, True),
        (11, "html", "https://a.py/c", None, None, "Oculta", None, long, False),
        (12, "html", "https://a.py/c", None, None, "Sin dato", None, long, None),
        (13, "image", None, "nada", "https://a.py/recaudaciones", None, None, "Texto de una imagen que tiene más de treinta letras.", True),
        (14, "image", None, None, None, "", None, None, True),
        (15, "html", "https://a.py/d", None, None, "Archivos - mayo", None, long, True),
    ]
    got = {r["chunk_id"]: r for r in chunks.crawled_chunks(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {"spider-7-0", "spider-7-1", "spider-8-0", "spider-9-0", "spider-13-0"}
    assert [got[f"spider-7-{i}"]["place"] for i in (0, 1)] == [0, 1] and (got["spider-7-0"]["text"] + " " + got["spider-7-1"]["text"]) == long.strip()
    assert got["spider-8-0"]["text"] == "El resumen dice que hay un turno." and got["spider-8-0"]["kind"] == "servicio" and got["spider-8-0"]["category"] == "b"
    assert got["spider-9-0"]["text"] == "Un título largo de treinta letras." and got["spider-9-0"]["category"] == "licencia" and got["spider-9-0"]["kind"] == "informacion"
    assert (got["spider-13-0"]["category"], got["spider-13-0"]["kind"], got["spider-13-0"]["title"]) == ("patente", "recurso", "Fuente 13")


def test_urls_of_sources(spark):
    for url, want in [("https://A.py/x#y", "https://a.py/x"), (" http://a.py:80?q=1#z ", "http://a.py/?q=1"), ("https://a.py:443", "https://a.py/"), ("http://a.py:443/", "http://a.py:443/"), ("mailto:a@b", None), ("a.py/x", None), ("", None)]:
        assert one(spark, urls.without_fragment(F.lit(url))) == want
    assert [one(spark, urls.kind(F.lit(f"https://a.py/x.{e}?q"))) for e in ("avif", "BMP", "pdf", "php")] == ["image", "image", "pdf", "html"]
    assert one(spark, rules.item_category(F.lit("https://a.py/"), F.lit(""), F.lit("https://a.py/q/Reclamos-y-Tramites"), F.lit(None).cast("string"), F.lit("html"))) == "reclamos"
    assert one(spark, rules.item_category(F.lit(None).cast("string"), F.lit(""), F.lit("x"), F.lit(""), F.lit("html"))) == "html"


def test_text_steps_are_worked_out_once(spark):
    from comuna.functions import text
    from comuna.operators import pages
    from comuna.plans.answers import chunk_pack, crawled_chunks
    from comuna.plans.city import boilerplate_strip

    rows = spark.createDataFrame([("niÃ±o",), ("a�o",), (" Inicio\nTRÁMITES servicios 3 Transparencia\n ab  c\tWHATſAPP views: 12 d",), ("leer ́mas.",), ("Leer-MAS. x",), (None,)], "t string")
    t = F.col("t")
    found = rows.select(text.repair_mojibake(t).alias("m"), pages.strip_boilerplate(t).alias("s"), pages.is_noisy(t, F.lit(False)).alias("n"))
    assert [tuple(r) for r in found.collect()] == [
        ("niño", "niño", False), ("año", "año", False), (" Inicio\nTRÁMITES servicios 3 Transparencia\n ab  c\tWHATſAPP views: 12 d", "ab c WHATſAPP d", False),
        ("leer ́mas.", "leer ́mas.", True), ("Leer-MAS. x", "Leer-MAS. x", True), (None, "", True),
    ]
    plan = rows.select(pages.strip_boilerplate(t))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("encode(") <= 4
    for query in (boilerplate_strip, chunk_pack, crawled_chunks):  # texts of one file are dealt out
        assert "RoundRobinPartitioning" in query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
