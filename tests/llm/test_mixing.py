"""The mix against a plain version with every quotient written out."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from comuna.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def highest(votes, blocks, limits):
    """Sainte-Laguë with all quotients sorted."""
    every = sorted((-v / (2 * k - 1), i) for i, (v, most) in enumerate(zip(votes, limits)) for k in range(1, most + 1))
    given = [0] * len(votes)
    for _, i in every[:blocks]:
        given[i] += 1
    return given


def brute(docs, most_blocks):
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in docs if s is not None}) + ([None] if any(s is None for _, _, s in docs) else [])
    size = {n: sum(size_of(t) for _, t, s in docs if s == n) for n in names}
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, full = sum(size.values()), set()
    while True:
        rest, shares = 150 * total - sum(200 * size[n] for n in full), sum(weight[n] for n in names if n not in full)
        new = {n for n in names if n not in full and rest * weight[n] > 200 * size[n] * shares}
        if not new:
            break
        full |= new
    target = {n: float(2 * size[n]) if n in full else rest * weight[n] / (100 * shares) for n in names}
    block = max(1, 150 * total // (100 * most_blocks))
    open_ = [n for n in names if n not in full]
    given = dict(zip(open_, highest([target[n] for n in open_], (rest + 50 * block) // (100 * block), [2 * size[n] // block + 1 for n in open_])))
    out = []
    for n in names:
        mine = [(i, t) for i, t, s in docs if s == n]
        if n in full or given[n] * block >= 2 * size[n]:
            out += [(i, size_of(t), size[n], target[n], 2 * size_of(t)) for i, t in mine]
            continue
        count = min(mixing.SHARDS, max(1, -(-given[n] // mixing.SHARD_BLOCKS)))
        shards = {}
        for i, t in mine:
            mark = hashlib.md5(f"mix:{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
            if given[n] and size_of(t):
                shards.setdefault(int(mark[:8], 16) % count, []).append((mark, i, size_of(t)))
            else:
                out.append((i, size_of(t), size[n], target[n], 0))
        keys = sorted(shards)
        words = [sum(w for _, _, w in shards[k]) for k in keys]
        for k, quota in zip(keys, highest(words, given[n], [-(-2 * w // block) for w in words])):
            slots = [(i, w) for _, i, w in sorted(shards[k], key=repr) for _ in range(w)]
            due, taken = min(quota * block, 2 * len(slots)), {}
            place = 0
            for at, (_, i, w) in enumerate(sorted(shards[k], key=repr)):
                taken[at] = sum(len(range(p, due, len(slots))) for p in range(place, place + w))
                out.append((i, w, size[n], target[n], taken[at]))
                place += w
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed, most_blocks", [(0, 50), (1, 400), (2, 10**6)])
def test_mix_against_all_quotients(spark, seed, most_blocks, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_BLOCKS", 8)
    rng = random.Random(seed)
    names = [None, "", "a", "B", "é", "z", "\U0001f600", "￮"]
    docs = [(i, rng.choice([None, "", " \t ", *[" ".join(["w"] * rng.randint(1, 60))] * 9]), rng.choice(names[: 5 + seed])) for i in range(150)]
    docs += [(None, "two words", "z"), (None, None, "a"), (900, "long " * 3000, "z"), (7, "same row", "B"), (7, "same row", "B")]
    frame = spark.createDataFrame(docs, SCHEMA)
    clash = frame.withColumns({c: F.lit("x") for c in ("size", "key", "target", "n", "rank", "shard", "taken")})
    got = sorted((tuple(r) for r in mixing.mix(clash.repartition(5), most_blocks=most_blocks).collect()), key=repr)
    assert got == brute(docs, most_blocks)
    assert all(taken <= 2 * size for _, size, _, _, taken in got)


def test_equal_targets_share_the_last_blocks_by_rank(spark):
    docs = [(i, "w " * 40, f"s{i:02d}") for i in range(12)]
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(spark.createDataFrame(docs, SCHEMA), weights=(1,), percent=100, most_blocks=7).collect()}
    # 480 words in 7 blocks of 68: sources with equal quotients get one each, the first ones.
    assert got == {i: 68 if i < 7 else 0 for i in range(12)}


def test_nothing_to_mix(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mixing.mix(spark.createDataFrame([(1, None, "a"), (2, "", None)], SCHEMA)).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_a_hot_source_is_dealt_over_its_shards(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', 20 + id % 50)").alias("text"), F.expr("if(id % 3 > 0, 'hot', concat('s', id % 20))").alias("source"))
    rows = mixing.sized(docs, "mix").where("source = 'hot'").withColumn("shard", F.col("draw") % mixing.SHARDS)
    assert rows.groupBy("shard").count().agg(F.max("count")).first()[0] < 20


def test_sainte_lague_against_sorted_quotients():
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = int(rng.integers(1, 12))
        votes = rng.integers(0, 60, m) * rng.choice([1, 1, 50], m)
        limits = rng.integers(0, 30, m)
        blocks = int(rng.integers(0, 80))
        limits = np.where(votes > 0, limits, 0)
        got = mixing.sainte_lague(votes, blocks, limits).tolist()
        assert got == highest(votes.tolist(), blocks, limits.tolist()), (votes, blocks, limits)
