"""Seeds, artifacts, embeddings and merged details on small rows."""

import datetime as dt

from pyspark.sql import functions as F

from comuna.functions import text
from comuna.operators import dashboards, pages, search, validation
from comuna.sources import files


def test_seed_limits(spark):
    given = ["7.9", "-3", "99999999999", "many", None, "NaN", "1e2"]
    rows = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, g string")
    got = rows.select("i", validation.seed_limit(F.col("g"), "max_depth").alias("d"), validation.seed_limit(F.col("g"), "concurrency").alias("c")).orderBy("i").collect()
    assert [(r["d"], r["c"]) for r in got] == [(7, 6), (0, 1), (8, 6), (3, 2), (3, 2), (3, 2), (8, 6)]


def test_lost_letters(spark):
    made = lambda t: spark.range(1).select(text.repair_mojibake(F.lit(t))).first()[0]
    assert [made(t) for t in ("ni\ufffdo", "NI\ufffdO", "\ufffd", "ma\ufffd\ufffdana", None, "")] == ["niño", "NIÑO", "Ñ", "maññana", None, ""]


def test_normalized_words(spark):
    rows = spark.createDataFrame([(t,) for t in ("  Árbol—verde\u00a0y  AZUL!", "plain ASCII, words", "", None, "...", "日本 語")], "t string")
    got = rows.select(text.normalize(F.col("t")).alias("p")).select("p", text.words_in(F.col("p")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("arbol verde y azul", 4), ("plain ascii words", 3), ("", 0), ("", 0), ("", 0), ("日本 語", 2)]


def test_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([("a.html", "00ff", "x"), ("b.html", "00ee", "y"), ("c.html", "12aa", None)], "name string, digest string, content string")
    files.write_artifacts(rows, f"file://{tmp_path}/kept")
    assert files.read_artifacts(spark, f"file://{tmp_path}/kept").count() == 3
    one = files.read_artifacts(spark, f"file://{tmp_path}/kept", "00ff")
    assert [tuple(r) for r in one.collect()] == [("a.html", "00ff", "x")]
    assert "PartitionFilters: [isnotnull(prefix" in one._jdf.queryExecution().toString()


def test_page_without_anything(spark):
    rows = spark.createDataFrame([(None, "u"), ("", "v"), ('<link rel="canonical" href="/c"><a href="/x">a</a><a href="/x">b &amp; c</a>', "w")], "html string, url string")
    got = pages.extract(rows).select("canonical", F.size("links"), "plain").collect()
    assert [tuple(r) for r in got][1:] == [("v", 0, ""), ("/c", 1, "a b & c")] and got[0]["canonical"] == "u"


def test_seeds_not_crawled_stay(spark):
    now = dt.datetime(2024, 1, 1)
    seeds = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", None), (4, None, None)], "seed int, last_digest string, last_changed_at timestamp")
    checks = spark.createDataFrame([(1, "a", 3, 0, 0, ""), (2, None, 0, 2, 0, "timeout"), (4, "b", 1, 0, 0, "")], "seed int, digest string, pages int, errors int, changed_items int, last_error string")
    got = {r["seed"]: (r["status"], r["last_digest"], r["check_error"]) for r in pages.checked_seeds(seeds, checks, now).collect()}
    assert got == {1: ("unchanged", "a", None), 2: ("error", "a", "timeout"), 3: (None, "a", None), 4: ("changed", "b", None)}


def test_hand_set_priority_comes_first(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, 9, "nuevo", "bache_aislado", "baja", day, 2, 90, "alta", False), (2, 9, "resuelto", "conjunto_de_baches", "alta", day, 0, 30, "baja", True)]
    schema = "id int, incident_id int, status string, kind string, severity string, created_at date, confirmations int, priority_score int, priority_band string, overridden boolean"
    got = dashboards.copied_roll_up(spark.createDataFrame(rows, schema), "incident_id").first()
    assert (got["kind"], got["priority_score"], got["status"], got["severity"], got["primary_id"]) == ("conjunto_de_baches", 30, "nuevo", "alta", 1)


def test_embeddings_in_calls_of_a_size(spark):
    rows = [(i, None, "t" * i, [1.0] if i % 2 else None, "m" if i % 4 == 1 else "old") for i in range(9)]
    found = search.embedded(spark.createDataFrame(rows, "chunk_id int, title string, text string, embedding array<double>, model string").coalesce(1), lambda texts: [[float(len(texts))] for _ in texts], "m", size=4)
    got = {r["chunk_id"]: r["embedding"][0] for r in found.collect()}
    assert got == {0: 4.0, 2: 4.0, 3: 4.0, 4: 4.0, 6: 3.0, 7: 3.0, 8: 3.0, 1: 1.0, 5: 1.0}
