"""Ball-tree clustering against plain integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from comuna.llm import clustering

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, rounds, size, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), p) for i, p in kept if i is not None)
    centroids = [p for _, p in order[:k]]
    far = lambda p, c: sum((a - b) ** 2 for a, b in zip(p, c))
    near = lambda p: min((far(p, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, p in kept:
            groups.setdefault(near(p)[1], []).append(p)
        for j, ps in groups.items():
            centroids[j] = [sum(x) // len(ps) for x in zip(*ps)]
    found = [(i, *near(p)) for i, p in kept]
    total = {}
    for _, d, j in found:
        total[j] = total.get(j, 0) + d
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, total[j], sum(total.values()), shown[j]) for i, d, j in found), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_plain_integers(spark, seed):
    rng = random.Random(seed)
    means = [[rng.uniform(-3, 3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [rng.gauss(m, 0.2 + seed) for m in rng.choice(means)]) for i in range(400)]
    rows += [(1000 + i, means[0]) for i in range(200)] + rows[:5] + [(None, means[1]), (None, means[2])]
    rows += [(2000, None), (2001, []), (2002, means[0][:5]), (2003, [*means[0][:5], None]), (2004, [*means[0][:5], float("nan")]), (2005, [*means[0][:5], float("inf")]), (2006, [0.0] * 6)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("clash") for c in ("point", "cluster", "n", "label")})
    got = clustering.cluster_vectors(frame, k=9, rounds=4, size=6, scale=16)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 9, 4, 6, 16)


def test_small_and_empty_tables(spark):
    assert clustering.cluster_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    three = [(i, [float(i)] * 64) for i in range(3)]
    assert sorted((tuple(r) for r in clustering.cluster_vectors(spark.createDataFrame(three, SCHEMA)).collect()), key=repr) == brute(three, 40, 5, 64, 256)
    huge = [(1, [1e300] * 64), (2, [-1e300] * 64)]
    got = {r["vec_id"]: r["distance"] for r in clustering.cluster_vectors(spark.createDataFrame(huge, SCHEMA), k=1, rounds=0).collect()}
    assert sorted(got.values()) == [0, 64 * (2 * clustering.MOST) ** 2]


def test_whole_balls_are_settled_without_looking_inside():
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.integers(-20, 20, (2000, 8)) + 500 * j for j in range(3)])
    tree = clustering.BallTree(np.arange(len(points)), points)
    centroids = np.array([[500 * j] * 8 for j in range(3)])
    left = sum(len(tree.rows_of(nodes)[0]) for nodes, whole, _ in tree.balls(centroids) if whole is None)
    counts, sums = tree.totals(centroids)
    assert left < 100 and counts.tolist() == [2000] * 3 and sums.sum() == points.sum()
    mixed = rng.integers(-300, 1300, (7, 8))
    near, far = clustering.exact_nearest(tree.points, mixed)
    got = tree.nearest(mixed)
    assert (got[0] == near).all() and (got[1] == far).all()
    again = clustering.BallTree.of(dict(zip("ids points low high left radius sums".split(), tree.row())))
    assert (again.nearest(mixed)[1] == far).all()
