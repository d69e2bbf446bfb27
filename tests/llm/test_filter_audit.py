"""The filter audit against a plain loop over documents and orders."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from comuna.llm import filter_audit


def brute(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    first, rows = {}, []
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(d, first.get(text or "", d))
    for d, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > first[t]}
        rows.append((lang or "", {k for k, v in fails.items() if v}, d in good, d in toxic))
    out, total = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, k in enumerate(order, 1):
                gone = [r for r in left if k in r[1]]
                redundant = sum(1 for r in rows if r[0] == part and k in r[1]) - len(gone)
                left = [r for r in left if k not in r[1]]
                unique = sum(1 for r in rows if r[0] == part and r[1] == {k})
                out[part, order, step] = [len(left), len(gone), redundant, unique, sum(r[2] for r in gone), sum(r[3] for r in gone)]
                total[part, k] = total.get((part, k), 0) + len(gone)
    return {(p, o, s): (*v, total[p, o[s - 1]]) for (p, o, s), v in out.items()}


def test_audit_against_a_loop(spark):
    rng = random.Random(4)
    words = ["rain", "river", "Stone", "LETTER", "a", "b|c", "d e", "ñ"]
    texts = [None, "", " \t\n\x0b\x0c\r ", "x" * 50_000, *(" ".join(rng.choice(words) + str(rng.randrange(300)) for _ in range(rng.choice([3, 99, 100, 101, 250]))) for _ in range(25))]
    docs = [(i if i % 9 else None, rng.choice(texts), rng.choice(["en", "es", "", None])) for i in range(160)]
    docs += docs[:7]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (None, 1, 1), (4, 0, 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("part", "mask", "digest", "good", "n", "step", "first")})
    got = filter_audit.filter_audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in got} == brute(docs, labels)
    assert len(got) == 3 * 600


def test_audit_of_copies_beyond_the_frequent_bound(spark, monkeypatch):
    docs = [(i, "same" if i % 3 else f"own {i}", "en") for i in range(900)]
    got = filter_audit.filter_audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    row = got.where("filter_order = 'EABCD' AND step = 1").first()
    assert (row["removed"], row["kept"], row["unique_fails"]) == (599, 301, 0)


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.filter_audit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
