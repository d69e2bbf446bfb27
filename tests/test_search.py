"""Search: the best of each task, full-text match and vector cells against plain versions."""

import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from comuna.functions import spanish
from comuna.operators import fulltext, graph, scoring, search, vectors
from comuna.operators.retrieval import best_token_scores, exact_token_scores, top_k
from tests.test_operators import plain_score

POOL = "casa licencia licencias patente patentes agua municipal tramite pago pagos registro civil acta de la un permiso obra calle basura".split()


def said(rng, n):
    return " ".join(rng.choice(POOL) for _ in range(n))


def test_best_of_tasks_is_the_best_of_all(spark, monkeypatch):
    """Pruned tasks, several blocks of queries, phrases with and without inner words, pairs asked for."""
    rng = random.Random(2)
    docs = [(i, said(rng, rng.randint(0, 14))) for i in range(200)]
    asked = [(i, said(rng, rng.randint(0, 5))) for i in range(20)]
    queries, rows = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    whole = search.text_scores(queries, rows, 8)
    want = {(r["query_id"], r["chunk_id"], r["score"]) for r in search.top(whole, 4).collect()}
    monkeypatch.setattr(scoring, "HELD", 50)
    monkeypatch.setattr(scoring, "BLOCK_WORDS", 12)
    few = search.text_scores(queries, rows, 8, 4)
    assert {(r["query_id"], r["chunk_id"], r["score"]) for r in search.top(few, 4).collect()} == want and want
    best = scoring.Best(3, 4)
    assert best.cut().empty and few.count() < whole.count()
    wanted = rows.select("chunk_id", F.array(search.part(F.col("text"), 8)).alias("parts"), F.lit(1).alias("extra"), F.when(F.col("chunk_id") == 7, F.array(F.lit(3).cast("long"))).alias("asked"))
    assert scoring.scored(queries, wanted, 1).where("query_id = 3 AND chunk_id = 7").count() == 1


def test_strong_words(spark):
    queries = spark.createDataFrame([(1, "agua licencia patentes")], "query_id long, text string")
    rows = spark.createDataFrame([(1, "agua y licencias"), (2, "patente")], "chunk_id long, text string")
    got = {r["chunk_id"]: (r["matched"], r["strong"]) for r in search.text_scores(queries, rows, 8).collect()}
    assert got == {1: (2, 1), 2: (1, 1)}


def test_empty_search_shows_the_first_procedures(spark):
    procedures = spark.createDataFrame([(i, f"licencia {i}", "obra", ["pago"]) for i in range(9)], "procedure_id long, title string, description string, sections array<string>")
    queries = spark.createDataFrame([(1, "de la"), (2, "licencia 3"), (3, None)], "query_id long, text string")
    none = spark.createDataFrame([], "query_id long, procedure_id long, score double")
    got = search.search(procedures, queries, none, 4).collect()
    rows = {q: [(r["procedure_id"], r["score"], r["total"]) for r in sorted(got, key=lambda r: r["place"]) if r["query_id"] == q] for q in (1, 2, 3)}
    assert rows[1] == rows[3] == [(i, 1.0, 9) for i in range(4)]
    # 10 for the whole word and 14 for the title where all of it is there; single digits are no words.
    assert [p for p, _, _ in rows[2]] == [0, 1, 2, 3] and {s for _, s, _ in rows[2]} == {24.0}
    evidence = spark.createDataFrame([(2, 8, 5.5), (2, 8, 7.25), (2, None, 50.0)], "query_id long, procedure_id long, score double")
    assert search.search(procedures, queries, evidence, 1).where("query_id = 2").first()["procedure_id"] == 8


# --- full-text match ---


def plain_match(queries, docs, k):
    """Every text against every query, by regular expressions and loops."""
    stem = lambda w: re.sub(spanish.STEM_PATTERN, r"\1", w)
    kept = lambda ws: [(i, stem(w)) for i, w in enumerate(ws) if len(w) > 1 and w not in spanish.STOP_WORDS]
    out = {}
    for q, text in queries:
        ranks = {}
        for alternative in re.split(r"(?i)(?:^|\s)or(?=\s|$)", text or ""):
            terms = [(m.startswith("-"), kept(re.sub("[^a-z0-9]+", " ", m.lower()).strip().split(" "))) for m in re.findall(r'-?"[^"]*"|\S+', alternative)]
            terms = [(neg, ws) for neg, ws in terms if ws]
            for d, body in docs:
                at = dict(kept((body or "").split(" ")))
                found, good = [], any(not neg for neg, _ in terms)
                for neg, ws in terms:
                    starts = [s for s in range(-5, max(at, default=0) + 1) if all(at.get(s + i) == w for i, w in ws)]
                    good = good and bool(starts) != neg
                    if not neg:
                        found.append([(s + ws[0][0], s + ws[-1][0], len(ws)) for s in starts])
                if not good:
                    continue
                spans = sorted({(min(f[0] for f in fs), q_) for q_ in {e for o in found for _, e, _ in o} if all(any(e <= q_ for _, e, _ in o) for o in found) for fs in [[max(x for x in o if x[1] <= q_) for o in found]]})
                first = {}
                for p, q_ in spans:
                    first[p] = min(q_, first.get(p, q_))
                rank = sum(0.1 / (1 + max(0, q_ - p - (sum(n for o in found for s, e, n in o if s >= p and e <= q_) - 1))) for p, q_ in first.items())
                ranks[d] = max(rank, ranks.get(d, 0))
        out[q] = sorted(((-round(r, 9), d) for d, r in ranks.items()))[:k]
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [(i, said(rng, rng.choice([0, 3, 30, 120]))) for i in range(300)] + [(900, None), (901, ""), (902, "licencia " * 200)]


def test_full_text_match_is_a_plain_scan(spark, texts, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 20)
    rng = random.Random(6)
    queries = [(1, "licencia"), (2, '"acta de la obra"'), (3, "registro -civil"), (4, "pago or basura calle"), (5, '-"pago pagos" agua permiso'), (6, "de la"), (7, None), (8, "-agua"), (9, 'casa "registro civil" OR "agua un permiso" -obra'), (10, "nada"), (11, "licencia licencias")]
    queries += [(20 + i, " ".join(rng.choice(["", "", "-"]) + rng.choice([rng.choice(POOL), f'"{rng.choice(POOL)} {rng.choice(POOL)}"']) for _ in range(rng.randint(1, 3)))) for i in range(25)]
    path = fulltext.write_index(spark.createDataFrame(texts, "chunk_id long, text string"), graph.shared_folder(spark))
    got = {}
    for r in fulltext.match(spark, path, spark.createDataFrame(queries, "query_id long, text string"), 7).collect():
        got.setdefault(r["query_id"], []).append((-round(r["rank"], 9), r["chunk_id"]))
    want = plain_match(queries, texts, 7)
    assert {q: sorted(rows) for q, rows in got.items()} == {q: rows for q, rows in want.items() if rows} and len(got) > 15


def test_full_text_match_reads_no_block_that_cannot_win(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 10)
    docs = [(i, "licencia " * (30 if i < 12 else 1) + f"palabra{i}") for i in range(600)]
    path = fulltext.write_index(spark.createDataFrame(docs, "chunk_id long, text string"), graph.shared_folder(spark))
    index, terms = spark.read.parquet(path), fulltext.terms_of(spark.createDataFrame([(1, "licencia")], "query_id long, text string"))
    every = fulltext.bounds(index, terms).selectExpr("*", "row_number() over (order by bound desc, block) as order")
    probed = fulltext._best(fulltext.read(index, terms, every.where(f"order <= {fulltext.PROBE}")), 2)
    assert every.count() == 60 and fulltext.still_promising(every, probed, 2).count() <= 12
    assert "PartitionFilters" in index.where("bucket = 3")._jdf.queryExecution().toString()
    assert fulltext.match(spark, path, spark.createDataFrame([], "query_id long, text string")).count() == 0


def shuffle_files(spark):
    """Sizes of the shuffle files there are."""
    folder = Path(spark.conf.get("spark.local.dir"))
    return {p: p.stat().st_size for p in folder.rglob("shuffle_*.data")}


def test_index_and_match_shuffle_no_more_than_the_postings_asked_for(spark):
    """No word is shuffled for the index; a block's postings meet once for all questions, not once for each."""
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, said(rng, 300)) for i in range(400)], "chunk_id long, text string")
    before = shuffle_files(spark)
    path = fulltext.write_index(docs, graph.shared_folder(spark))
    assert sum(size for p, size in shuffle_files(spark).items() if p not in before) == 0
    moved = []
    for n in (1, 30):
        before = shuffle_files(spark)
        found = fulltext.match(spark, path, spark.createDataFrame([(q, "licencia agua -nada") for q in range(n)], "query_id long, text string"), 3)
        assert found.count() == 3 * n
        moved.append(sum(size for p, size in shuffle_files(spark).items() if p not in before))
    assert 0 < moved[1] < 2 * moved[0]


@pytest.mark.parametrize(("texts", "size"), [(1024, 1 << 20), (1024, 1), (7, 40)])
def test_full_text_match_whatever_the_blocks(spark, monkeypatch, texts, size):
    """Ids that are no numbers, no id, texts of one word, phrases that end one text and begin the next, many equal ranks."""
    monkeypatch.setattr(fulltext, "BLOCK", texts)
    monkeypatch.setattr(fulltext, "BLOCK_BYTES", size)
    rng = random.Random(9)
    docs = [(f"ñ{i}" if i % 3 else f"b{i:03}", said(rng, rng.choice([1, 2, 5, 40]))) for i in range(120)] + [("z", None), (None, "licencia agua"), ("y", "a de ¿ü? 𝔸𝔸 licencia"), ("x", "ACTA, obrás")]
    queries = [(1, '"acta obra"'), (2, "agua pago"), (3, "licencia or agua -pago"), (4, '"casa de la" obra'), (5, "𝔸𝔸"), (6, "agua agua"), (7, '-"acta obra" civil')]
    path = fulltext.write_index(spark.createDataFrame(docs, "chunk_id string, text string").coalesce(1), graph.shared_folder(spark))
    got = {}
    for r in fulltext.match(spark, path, spark.createDataFrame(queries, "query_id long, text string"), 4).collect():
        got.setdefault(r["query_id"], []).append((-round(r["rank"], 9), r["chunk_id"]))
    plain = [(d, " ".join(w.translate(str.maketrans("áñü", "anu")) for w in re.findall(r"\w+", (body or "").lower()))) for d, body in docs if d]
    want = {q: rows for q, rows in plain_match([x for x in queries if x[0] != 5], plain, 4).items() if rows} | {5: [(-0.1, "y")]}
    assert {q: sorted(rows) for q, rows in got.items()} == want and len(got) == 7


def test_same_id_twice_in_a_block_is_one_text(spark):
    docs = spark.createDataFrame([(1, "agua y pago"), (2, "pago"), (1, "pago agua obra")], "chunk_id long, text string").coalesce(1)
    index = spark.read.parquet(fulltext.write_index(docs, graph.shared_folder(spark))).where("word <> ''")
    assert {r["word"]: (list(zip(r["ids"], r["counts"])), r["places"]) for r in index.collect()} == {"agua": ([(1, 2)], [0, 1]), "pago": ([(1, 2), (2, 1)], [0, 2, 0]), "obra": ([(1, 1)], [2])}


def test_no_words_match_nothing(spark):
    queries = spark.createDataFrame([(1, "agua -pago")], "query_id long, text string")
    for docs in ([], [(1, "de la"), (2, None)]):
        path = fulltext.write_index(spark.createDataFrame(docs, "chunk_id long, text string"), graph.shared_folder(spark))
        assert fulltext.match(spark, path, queries).count() == 0


def test_excluded_phrase_with_a_word_that_is_nowhere(spark):
    path = fulltext.write_index(spark.createDataFrame([(1, "acta civil")], "chunk_id long, text string"), graph.shared_folder(spark))
    found = fulltext.match(spark, path, spark.createDataFrame([(1, '-"acta obra" civil')], "query_id long, text string"))
    assert [r["chunk_id"] for r in found.collect()] == [1]


# --- vectors ---


def test_vector_cells_recall(spark):
    stored = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("vec_id AS chunk_id", "embedding")
    asked = stored.where("chunk_id % 100 = 0").selectExpr("chunk_id AS query_id", "embedding AS q")
    exact = {(r["query_id"], r["chunk_id"]) for r in top_k(vectors.vector_scores(asked, stored), 10, score="similarity").collect()}
    path = vectors.write_cells(stored, graph.shared_folder(spark), 64)
    recall = {}
    for probes in (4, 36, 1000):
        found = {(r["query_id"], r["chunk_id"]) for r in vectors.near_cells(spark, path, asked, 10, probes).collect()}
        recall[probes] = len(found & exact) / len(exact)
    assert recall[4] <= recall[36] and recall[36] >= 0.95 and recall[1000] == 1.0, recall


def test_few_cells_do_where_vectors_cluster(spark):
    rng = np.random.default_rng(3)
    means = rng.normal(size=(40, 16))
    stored = spark.createDataFrame([(i, (means[i % 40] + 0.2 * rng.normal(size=16)).tolist()) for i in range(2000)], "chunk_id long, embedding array<double>")
    asked = stored.where("chunk_id % 50 = 0").selectExpr("chunk_id AS query_id", "embedding AS q")
    exact = {(r["query_id"], r["chunk_id"]) for r in top_k(vectors.vector_scores(asked, stored), 10, score="similarity").collect()}
    path = vectors.write_cells(stored, graph.shared_folder(spark), 16)
    found = {(r["query_id"], r["chunk_id"]) for r in vectors.near_cells(spark, path, asked, 10, 4).collect()}
    assert len(found & exact) / len(exact) >= 0.95


def test_vector_cells_edges(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)] + [(100 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(60)] + [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 1.0, 1.0]), (904, [1.0] * 3)]
    stored = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    path = vectors.write_cells(stored, graph.shared_folder(spark), 4, sample=30)
    asked = spark.createDataFrame([(100, [2.0] * 4), (1, None), (2, [0.0] * 4), (3, [1.0])], "query_id long, q array<double>")
    got = vectors.near_cells(spark, path, asked, 5, 1).collect()
    assert [(r["query_id"], r["chunk_id"], r["place"]) for r in sorted(got, key=lambda r: r["place"])] == [(100, 101 + i, i + 1) for i in range(5)]
    empty = vectors.write_cells(stored.limit(0), graph.shared_folder(spark), 4)
    assert vectors.near_cells(spark, empty, asked).count() == 0


def test_equal_ranks_go_by_id_whatever_the_order_of_sums(spark):
    found = spark.createDataFrame([(1, 7, 0.3), (1, 9, 0.1 + 0.2)], "query_id long, chunk_id long, rank double")
    assert [r["chunk_id"] for r in fulltext._best(found, 1).collect()] == [7]
    placed = spark.createDataFrame([(1, 0, 5, 0.3 - 4e-10, 9)], "query_id long, grp int, block int, bound double, order int")
    probed = spark.createDataFrame([(1, 9, 0.3, 1)], "query_id long, chunk_id long, rank double, place int")
    assert fulltext.still_promising(placed, probed, 1).count() == 1


def test_all_texts_of_a_query_come_back(spark):
    from comuna.plans.answers import fuzzy_chunk_score

    found = fuzzy_chunk_score(spark, "/root/testdata/sf0.001").groupBy("query_id").count()
    assert found.where("count > 20").count()


def test_nearest_is_the_best_of_all_scores(spark, monkeypatch):
    """Copies, other lengths, nulls, zeros, tiny and huge numbers, NaN; several blocks of queries; only the best of a task are sent."""
    rng = np.random.default_rng(5)
    odd = [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 1.0, 1.0]), (904, [1.0] * 3), (905, [1e-200] * 4), (906, [1e200, 1.0, 1.0, 1.0]), (907, [float("nan"), 1.0, 1.0, 1.0])]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(400 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + odd
    stored = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(3)
    asked = stored.where("chunk_id % 20 = 0 OR chunk_id >= 899").selectExpr("chunk_id AS query_id", "embedding AS q")
    shown = lambda df: sorted((r["query_id"], r["place"], r["chunk_id"], repr(r["similarity"])) for r in df.collect())
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 20)
    monkeypatch.setattr(vectors, "PAIRS", 640)
    for itself in (False, True):
        want = top_k(vectors.vector_scores(asked, stored, itself), 7, score="similarity")
        assert shown(vectors.nearest(asked, stored, 7, itself)) == shown(want)
    plan = vectors.nearest(asked, stored, 7)._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert vectors.nearest(asked.limit(0), stored, 7).count() == 0 == vectors.nearest(asked, stored.limit(0), 7).count()


def test_an_index_of_asked_words_gives_the_same_matches(spark):
    rng = random.Random(9)
    chunks = spark.createDataFrame([(i, said(rng, rng.randint(0, 30))) for i in range(300)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, 'licencias "agua municipal"'), (2, "pagos -obra or registro civil"), (3, "de la")], "query_id long, text string")
    folder = graph.shared_folder(spark)
    terms = fulltext.terms_of(queries)
    whole, few = fulltext.write_index(chunks, folder), fulltext.write_index(chunks, folder, terms)
    shown = lambda path: sorted(tuple(r) for r in fulltext.match(spark, path, queries, 20).collect())
    assert shown(few) == shown(whole) != []
    words = {r["word"] for r in spark.read.parquet(few).select("word").distinct().collect()}
    assert words == {r["word"] for r in terms.select("word").distinct().collect()} & {r["word"] for r in spark.read.parquet(whole).select("word").distinct().collect()}


def test_best_of_single_texts_is_held_compactly():
    """A task holds a few frames, not one for every text."""
    best = scoring.Best(2, 3)
    for i in range(5000):
        best.add_text((i, "pasos"), ["key", "c0"], np.array([0, 1]), np.array([float(i % 7), 1.0]), np.array([1, 1]), np.array([0, 0]), np.array([False, i == 4999]))
    assert len(best.pairs) <= 3 and len(best.few) < 2000
    found = best.cut_texts(["key", "c0"])
    assert found[found["query"] == 0]["key"].tolist() == [6, 13, 20] and found[found["query"] == 1]["key"].tolist() == [0, 1, 2, 4999] and set(found["c0"]) == {"pasos"}


def test_whole_words_are_scored_where_the_texts_are(spark, monkeypatch):
    rng = random.Random(4)
    docs = [(i, said(rng, rng.randint(0, 14)) or None) for i in range(200)]
    asked = [(i, said(rng, rng.randint(0, 5))) for i in range(20)] + [(99, None)]
    queries, rows = spark.createDataFrame(asked, "query_id long, text string"), spark.createDataFrame(docs, "chunk_id long, text string").repartition(3)
    monkeypatch.setattr(scoring, "HELD", 50)
    monkeypatch.setattr(scoring, "BLOCK_WORDS", 12)
    shown = lambda df: sorted(tuple(r) for r in top_k(df, 4).select("query_id", "chunk_id", "score", "place").collect())
    found = best_token_scores(queries, rows, 4)
    assert shown(found) == shown(exact_token_scores(queries, rows)) != [] and "HashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert best_token_scores(queries, rows.limit(0), 4).count() == 0 == best_token_scores(queries.limit(0), rows, 4).count()


def test_a_task_scores_no_more_texts_however_many_there_are(spark, monkeypatch, tmp_path):
    """One file is dealt out by its bytes, also beyond the size up to which rows are dealt over the cores."""
    rng = random.Random(8)
    docs = [(i, said(rng, rng.randint(0, 60))) for i in range(2000)]
    spark.createDataFrame(docs, "chunk_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/rows")
    rows, queries = spark.read.parquet(f"file://{tmp_path}/rows"), spark.createDataFrame([(1, "agua licencia"), (2, "pagos")], "query_id long, text string")
    want = sorted(tuple(r) for r in search.text_scores(queries, rows, 8).collect())
    monkeypatch.setattr(scoring, "SPREAD_BYTES", 1)
    size = sum(f.stat().st_size for f in (tmp_path / "rows").glob("*.parquet"))
    monkeypatch.setattr(scoring, "SHARE_BYTES", size // 40, raising=False)
    found = search.text_scores(queries, rows, 8)
    assert found.rdd.getNumPartitions() >= 40 and max(found.groupBy(F.spark_partition_id()).agg(F.countDistinct("chunk_id").alias("n")).toPandas()["n"]) < 200
    assert sorted(tuple(r) for r in found.collect()) == want != []
    assert scoring.spread(rows).rdd.getNumPartitions() == 1 == scoring.spread(spark.createDataFrame(docs[:1], rows.schema).coalesce(1), "chunk_id").rdd.getNumPartitions()


def test_texts_are_scored_as_blocks(spark, monkeypatch):
    """Texts of several parts, repeated and unknown words, few cells and pairs at a time, words forgotten on the way: as a plain loop says."""
    rng = random.Random(6)
    docs = [(i, [(said(rng, rng.randint(0, 9)), 8 * (i % 2)) for _ in range(rng.randint(0, 3))], i % 3) for i in range(150)]
    asked = [(i, said(rng, rng.randint(1, 3))) for i in range(30)]
    # Between other letters a lone word is a phrase of its text, but no word of it.
    docs += [(900, [("xpagosx", 0)], 1), (901, [("xpagosx", 8)], 1), (902, [("a ag agua ag a", 0)], None)]
    asked += [(90, "pagos"), (91, "agua")]
    rows = spark.createDataFrame(docs, "chunk_id long, parts array<struct<plain:string,boost:int>>, extra int").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    want = {}
    for q, question in asked:
        tokens = [t for t in dict.fromkeys(question.split()) if len(t) > 1 and t not in spanish.STOP_WORDS]
        for d, parts, extra in docs:
            worth = [plain_score(t, list(dict.fromkeys(plain.split()))) for plain, _ in parts for t in tokens]
            phrases = [boost for plain, boost in parts if boost and tokens and " ".join(tokens) in plain]
            if any(worth) or phrases:
                want[q, d] = sum(worth) + sum(phrases) + (extra or 0), sum(w > 0 for w in worth)
    monkeypatch.setattr(scoring, "TEXTS", 7)
    for name, value in (("CELLS", 40), ("PAIRS", 100), ("REMEMBERED", 5)):
        monkeypatch.setattr(scoring, name, value, raising=False)
    got = {(r["query_id"], r["chunk_id"]): (r["score"], r["matched"]) for r in scoring.scored(queries, rows).collect()}
    assert got == want and (90, 901) in got and (90, 900) not in got
