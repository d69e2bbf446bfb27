"""Pages, planning, answers and validation against brute force on small inputs."""

import heapq
import math
import random

from pyspark.sql import functions as F

from comuna.operators import graph, pages, planning, retrieval, validation


def metres(a, b):
    p, q = map(math.radians, (a[0], b[0]))
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000.0 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_snapshot(spark):
    a, b, c = "Primer bloque con más de treinta letras", "Segundo bloque con más de treinta letras", "Nunca llega este bloque de treinta letras"
    html = f"<title>T</title><p>{c}</p><article><h1>H &amp; <b>x</b></h1><p>{a}<p>{a}</p><ul><li>{b}<ul><li>corto</ul></ul><p>Leer más sobre este tema tan interesante</p><p>{c}</p></article>"
    row = pages.snapshot(spark.createDataFrame([(html,), (None,)], "html string")).orderBy(F.desc("html")).first()
    assert row["title"] == "H & x" and row["blocks"] == [a, b + "corto"] and row["summary"] == f"{a} {b}corto"
    empty = pages.snapshot(spark.createDataFrame([(None,)], "html string")).first()
    assert (empty["title"], empty["blocks"], empty["summary"]) == ("", [], "")


def test_boilerplate(spark):
    raw = "Inicio\r\nTrámites Servicios 12 Más\nLa oficina abre a las 7.\nLeer más\nViews: 31 Fin. Navegación de entradas uno\ndos"
    assert one(spark, pages.strip_boilerplate(F.lit(raw))) == "La oficina abre a las 7. Fin."
    assert one(spark, pages.strip_boilerplate(F.lit(None).cast("string"))) == ""
    listing = {"https://x.py": True, "https://x.py/tag/a": True, "https://x.py/archivo/": True, "https://x.py/archivos": False, "https://x.py/a?b=/tag/c": False}
    assert {u: one(spark, pages.is_listing(F.lit(u))) for u in listing} == listing
    assert one(spark, pages.is_skipped(F.lit("html"), F.lit("https://x.py/a"), F.lit("Municipalidad de Luque")))
    assert not one(spark, pages.is_skipped(F.lit("pdf"), F.lit("https://x.py/"), F.lit("x")))
    assert one(spark, pages.is_noisy(F.lit("a b c"), F.lit(True))) and not one(spark, pages.is_noisy(F.lit("a b c"), F.lit(False)))


def test_crawl_goes_as_a_queue(spark):
    rng = random.Random(5)
    urls = [f"https://{'ab'[i % 5 == 0]}.py/{i}" for i in range(40)]
    links = [(u, rng.choice(urls), p) for u in urls for p in range(4)]
    seed = urls[1]
    order, depth, queue = [seed], {seed: 0}, [seed]
    while queue:
        u = queue.pop(0)
        if depth[u] < 3:
            for _, target, _ in sorted((x for x in links if x[0] == u), key=lambda x: x[2]):
                if target not in depth and target.startswith("https://a."):
                    depth[target] = depth[u] + 1
                    order.append(target)
                    queue.append(target)
    found = pages.crawl(spark.createDataFrame([(seed,)], "url string"), spark.createDataFrame(links, "source string, target string, position int"), 3, 12)
    assert [(r["url"], r["depth"]) for r in found.orderBy("place").collect()] == [(u, depth[u]) for u in order[:12]]


def test_zones_match_k_means(spark):
    rng = random.Random(7)
    rows = [(g, i, i, -25.3 + rng.random() * 0.1, -57.6 + rng.random() * 0.1) for g, n in (("x", 60), ("y", 3)) for i in range(n)]
    found = {(r["g"], r["id"]): r["zone"] for r in planning.zones(spark.createDataFrame(rows, "g string, id int, place int, lat double, lon double"), "g", k=4).collect()}
    for g in "xy":
        points = [r[3:] for r in rows if r[0] == g]
        centres = [points[0]]
        while len(centres) < 4:
            centres.append(max(points, key=lambda p: min(metres(p, c) for c in centres)))
        for _ in range(20):
            label = [min(range(4), key=lambda i: metres(p, centres[i])) for p in points]
            of = lambda i: [p for p, q in zip(points, label, strict=True) if q == i]
            new = [tuple(sum(v) / len(of(i)) for v in zip(*of(i), strict=True)) if of(i) else centres[i] for i in range(4)]
            rest, centres = all(metres(a, b) < 1 for a, b in zip(centres, new, strict=True)), new
            if rest:
                break
        wanted = {frozenset(i for i, q in enumerate(label) if q == z) for z in set(label)}
        got = {z: frozenset(i for (h, i), y in found.items() if h == g and y == z) for z in {y for (h, _), y in found.items() if h == g}}
        assert set(got.values()) == wanted and sorted(got) == list(range(len(wanted)))
        north = [sum(points[i][0] for i in got[z]) / len(got[z]) for z in sorted(got)]
        assert north == sorted(north, reverse=True)


def test_tours_and_shapes(spark):
    stops = [("r", i, i, 0.0, x, 0.0, 0.0) for i, x in enumerate((0.5, -0.1, 0.2, -0.5))]
    tour = planning.tours(spark.createDataFrame(stops, "route_id string, id int, place int, lat double, lon double, depot_lat double, depot_lon double"))
    assert [r["id"] for r in tour.orderBy("sequence").collect()] == [1, 2, 0, 3]
    legs = spark.createDataFrame([("r", 0, [1, 2, 3]), ("r", 1, [3, 4]), ("r", 2, [4])], "route_id string, leg int, path array<int>")
    nodes = spark.createDataFrame([(i, 0.0, float(i)) for i in range(6)], "id int, lat double, lon double")
    found = planning.route_shapes(legs, nodes).orderBy("seq").collect()
    assert [(r["seq"], r["node"]) for r in found] == [(0, 1), (1, 2), (2, 3), (3, 4)] and [r["is_anchor"] for r in found] == [False, False, True, True]


def test_shortest_paths_match_dijkstra(spark):
    rng = random.Random(3)
    at = {i: (rng.random() * 0.05, rng.random() * 0.05) for i in range(40)}
    nodes = spark.createDataFrame([(i, *p) for i, p in at.items()], "id int, lat double, lon double")
    edges = [(i, j, metres(at[i], at[j])) for i in at for j in at if i < j < 39 and metres(at[i], at[j]) < 1500]
    near = {i: [] for i in at}
    for a, b, m in edges:
        near[a].append((b, m))
        near[b].append((a, m))
    pairs = [(0, 1, 2), (1, 5, 30), (2, 7, 7), (3, 4, 39)]
    found = {r["pair_id"]: r for r in graph.shortest_paths(spark.createDataFrame(pairs, "pair_id int, start int, goal int"), spark.createDataFrame(edges, "a int, b int, distance_m double"), nodes).collect()}
    for pair, start, goal in pairs:
        best, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            far, u = heapq.heappop(heap)
            for v, m in near[u]:
                if far + m < best.get(v, math.inf):
                    best[v] = far + m
                    heapq.heappush(heap, (far + m, v))
        assert abs(found[pair]["distance_m"] - best.get(goal, metres(at[start], at[goal]))) < 1e-6
        assert (found[pair]["path"][0], found[pair]["path"][-1]) == (start, goal)
    assert found[2]["path"] == [7] and found[3]["path"] == [4, 39]


def test_reply_kinds(spark):
    none = F.lit(None)
    kind = lambda **k: one(spark, retrieval.reply_kind(*[{"intent": none, "topic": none, "no_corpus": F.lit(False), "best": F.lit(9), "procedure": F.lit(0), "strong": F.lit(0), "matches": F.lit(0)} .__or__({a: F.lit(b) for a, b in k.items()})[n] for n in ("intent", "topic", "no_corpus", "best", "procedure", "strong", "matches")]))
    assert kind(intent="saludo", topic="x") == "conversational" and kind(topic="x") == "out_of_scope" and kind(no_corpus=True) == "no_corpus"
    assert kind(best=4) == kind(best=None) == "no_result" and kind(best=4, procedure=10) == "procedure"
    assert kind(strong=1) == "no_evidence" and kind(strong=1, procedure=12) == "procedure" and kind(strong=1, matches=1) == kind() == "answer"


def test_validation(spark):
    good, bad = validation.split(spark.createDataFrame([(" Nuevo ",), ("otro",), (None,)], "status string"), validation.status_error(F.col("status")))
    assert good.columns == ["status"] and good.count() == 1
    assert {r["error_code"] for r in bad.collect()} == {"pothole-status-invalid"} and bad.count() == 2
    error = lambda limit, score, others, cap: one(spark, validation.settings_error(*[F.lit(x).cast("double") for x in (limit, score)], F.lit(others), F.lit(cap)))
    assert error(0, None, 0, 20) == error(21, None, 0, 20) == "rag-assistant-chunk-limit-invalid" and error(5, None, 0, None) == "rag-assistant-chunk-limit-max-unavailable"
    assert error(None, 51, 0, 20) == "rag-assistant-min-relevance-score-invalid" and error(None, None, 0, 20) == "rag-runtime-update-required" and error(5, 5, 0, 20) is None


def test_near_paths_are_those_over_all_edges(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, -25.3 + rng.random() * 0.1, -57.6 + rng.random() * 0.1) for i in range(90)] + [(200, -20.0, -50.0)]
    nodes = spark.createDataFrame(rows, "id long, lat double, lon double")
    pairs = spark.createDataFrame([(1, 0, 50), (2, 7, 7), (3, 3, 200), (4, 12, 80)], "pair_id int, start long, goal long")
    edges = graph.near_pairs(nodes, 2200.0)
    wanted = {r["pair_id"]: (r["path"], round(r["distance_m"], 3)) for r in graph.shortest_paths(pairs, edges, nodes).collect()}
    monkeypatch.setattr(graph, "near_pairs", None)
    assert {r["pair_id"]: (r["path"], round(r["distance_m"], 3)) for r in graph.near_paths(pairs, nodes, 2200.0).collect()} == wanted


def test_zone_points_of_one_file_are_dealt_out(spark, tmp_path):
    spark.range(40).select(F.lit("a").alias("d"), "id", F.col("id").alias("place"), (-25.0 + F.col("id") % 2 + F.col("id") / 1000).alias("lat"), (F.col("id") / 1000 - 57).alias("lon")).coalesce(1).write.parquet(f"{tmp_path}/p")
    found = planning.zones(spark.read.parquet(f"{tmp_path}/p"), "d", k=2)
    assert found.rdd.getNumPartitions() > 1
    assert {tuple(r) for r in found.select("id", "zone").collect()} == {(i, 1 - i % 2) for i in range(40)}
