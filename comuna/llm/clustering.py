"""Centroid clustering with ball-tree filtering.

Every task builds metric trees over blocks of its own vectors once: a ball has a centre, a radius, how many vectors it holds and
their integer sum. The trees are written to the shared folder, and each round reads them instead of the vectors. Going down a
tree, a centroid is dropped for a ball if the triangle inequality shows that another is nearer to every vector in it; a ball with
one centroid left is counted whole, by its count and sum, and leaves with several are settled by exact integer distances. Only
sums by cluster and component are shuffled. No vector moves, so no cluster, however large, gathers in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors of one tree, and of a leaf at most.
BLOCK, LEAF = 4096, 24
#: Scaled components are held within this, so that a squared distance of vectors of up to 127 components fits 64 bits.
MOST = 1 << 27
#: Components up to this have exact products and sums in double precision.
_EXACT = 1 << 20

_TREES = "ids array<long>, points binary, low array<int>, high array<int>, left array<int>, radius array<double>, sums binary"


def integer_vectors(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """``vec_id`` and ``point`` (array<int>) of the vectors with exactly ``size`` components, none null or infinite or no number.

    A component x becomes floor(scale * x), held within ``MOST``.
    """
    x = F.col("embedding").cast("array<double>")
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    held = lambda v: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * scale))
    kept = vectors.where(F.coalesce(whole, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(held(v)).cast("int")).alias("point"))


class BallTree:
    """A metric tree over the rows of an integer matrix; a node's children stand side by side, and a leaf has no left child."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.arange(len(points))
        low, high, left = [0], [len(points)], [-1]
        node = 0
        while node < len(low):
            a, z = low[node], high[node]
            mine = points[order[a:z]]
            spread = mine.max(axis=0) - mine.min(axis=0)
            if z - a > LEAF and spread.max() > 0:
                half = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(mine[:, spread.argmax()], half)]
                left[node] = len(low)
                low += [a, a + half]
                high += [a + half, z]
                left += [-1, -1]
            node += 1
        self.ids, self.points = ids[order], points[order]
        self.low, self.high, self.left = np.array(low), np.array(high), np.array(left)
        before = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(self.points, axis=0, dtype=np.int64)))
        self.sums = before[self.high] - before[self.low]
        centres = self.centres()
        self.radius = np.array([np.sqrt((((self.points[a:z] - c) ** 2).sum(axis=1)).max()) for a, z, c in zip(low, high, centres)])

    def centres(self) -> np.ndarray:
        return self.sums / (self.high - self.low)[:, None]

    def row(self) -> list:
        """The tree as the values of a row of ``_TREES``."""
        return [self.ids.tolist(), self.points.astype("<i4").tobytes(), self.low.tolist(), self.high.tolist(), self.left.tolist(), self.radius.tolist(), self.sums.astype("<i8").tobytes()]

    @classmethod
    def of(cls, row: dict) -> BallTree:
        tree = cls.__new__(cls)
        n = len(row["ids"])
        tree.ids = row["ids"]
        tree.points = np.frombuffer(row["points"], "<i4").reshape(n, -1).astype(np.int64)
        tree.low, tree.high, tree.left, tree.radius = (np.array(row[k]) for k in ("low", "high", "left", "radius"))
        tree.sums = np.frombuffer(row["sums"], "<i8").reshape(len(tree.low), -1)
        return tree

    def balls(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, centroid) of balls settled whole, then (leaves, flags of the centroids left, None) of those that are not."""
        centres = self.centres()
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            away = np.sqrt(((centres[nodes][:, None, :] - centroids[None]) ** 2).sum(axis=2))
            nearest = np.where(open_, away, np.inf).min(axis=1)
            # A vector of the ball is at most nearest + radius from one centroid and at least away - radius from another.
            open_ &= away - self.radius[nodes][:, None] <= (nearest + self.radius[nodes])[:, None] * (1 + 1e-9) + 1e-6
            one = open_.sum(axis=1) == 1
            yield nodes[one], open_[one].argmax(axis=1), None
            nodes, open_ = nodes[~one], open_[~one]
            leaf = self.left[nodes] < 0
            yield nodes[leaf], None, open_[leaf]
            first = self.left[nodes[~leaf]]
            nodes, open_ = np.concatenate((first, first + 1)), np.concatenate((open_[~leaf], open_[~leaf]))

    def rows_of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of some nodes and, for each, its node's place in ``nodes``."""
        count = self.high[nodes] - self.low[nodes]
        owner = np.repeat(np.arange(len(nodes)), count)
        return np.arange(count.sum()) + np.repeat(self.low[nodes] - np.concatenate(([0], np.cumsum(count)[:-1])), count), owner

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and integer sum of the vectors nearest to each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for nodes, centroid, left in self.balls(centroids):
            if left is None:
                np.add.at(counts, centroid, self.high[nodes] - self.low[nodes])
                np.add.at(sums, centroid, self.sums[nodes])
            elif len(nodes):
                rows, owner = self.rows_of(nodes)
                nearest, _ = exact_nearest(self.points[rows], centroids, left[owner])
                counts += np.bincount(nearest, minlength=len(centroids))
                np.add.at(sums, nearest, self.points[rows])
        return counts, sums

    def nearest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of every row."""
        cluster, distance = np.zeros(len(self.points), np.int64), np.zeros(len(self.points), np.int64)
        for nodes, centroid, left in self.balls(centroids):
            rows, owner = self.rows_of(nodes)
            if left is None:
                cluster[rows] = centroid[owner]
                distance[rows] = ((self.points[rows] - centroids[cluster[rows]]) ** 2).sum(axis=1)
            elif len(rows):
                cluster[rows], distance[rows] = exact_nearest(self.points[rows], centroids, left[owner])
        return cluster, distance


def exact_nearest(points: np.ndarray, centroids: np.ndarray, allowed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and exact squared distance, in integers or in doubles that are exact."""
    kind = np.float64 if max(abs(points).max(initial=0), abs(centroids).max(initial=0)) <= _EXACT else np.int64
    p, c = points.astype(kind), centroids.astype(kind)
    far = ((p**2).sum(axis=1)[:, None] - 2 * (p @ c.T) + (c**2).sum(axis=1)).astype(np.int64)
    if allowed is not None:
        far = np.where(allowed, far, np.iinfo(np.int64).max)
    nearest = far.argmin(axis=1)
    return nearest, far[np.arange(len(points)), nearest]


def trees(points: DataFrame) -> DataFrame:
    """The trees of every partition, a row each, written to the shared folder. A task holds one block of vectors at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def built(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            block = pa.Table.from_batches(held).combine_chunks()
            listed = block.column("point").combine_chunks()
            matrix = listed.flatten().to_numpy(zero_copy_only=False).reshape(len(block), -1).astype(np.int64)
            tree = BallTree(np.array(block.column("vec_id").to_pylist(), object), matrix)
            return pa.RecordBatch.from_arrays([pa.array([v]) if isinstance(v, bytes) else pa.array([v], pa.list_(kind)) for v, kind in zip(tree.row(), kinds)], names=names)

        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                while part.num_rows:
                    held.append(part.slice(0, BLOCK - n))
                    part, n = part.slice(BLOCK - n), n + held[-1].num_rows
                    if n == BLOCK:
                        yield built(held)
                        held, n = [], 0
        if held:
            yield built(held)

    names, kinds = "ids points low high left radius sums".split(), [pa.int64(), None, pa.int32(), pa.int32(), pa.int32(), pa.float64(), None]
    return cut(points.mapInArrow(run, _TREES))


def _from_trees(found: DataFrame, schema: str, work) -> DataFrame:
    """``work`` over the trees of each task, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (BallTree.of(batch.slice(i, 1).to_pylist()[0]) for batch in batches for i in range(batch.num_rows))
        yield from work(every)

    return found.mapInArrow(run, schema)


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose hash of ``salt`` and id is least, in that order; equal ids go by their components. Rows without an id are left out."""
    hashed = points.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h"), "point")
    return np.array([r["point"] for r in hashed.orderBy("h", "point").limit(k).collect()], np.int64)


def moved(found: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: componentwise floor(sum / count) of each one's vectors; one without vectors stays.

    Tasks send a row of sums a cluster; the driver receives the centroids.
    """

    def work(every: Iterator[BallTree]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for tree in every:
            own_counts, own_sums = tree.totals(centroids)
            counts += own_counts
            sums += own_sums
        has = np.flatnonzero(counts)
        if len(has):
            yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array(counts[has]), pa.array(sums[has].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = _from_trees(found, "cluster int, n long, sums array<long>", work)
    new = centroids.copy()
    each = parts.select("cluster", "n", F.posexplode("sums").alias("at", "part")).groupBy("cluster", "at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    for r in each.collect():  # one row a centroid and component
        new[r["cluster"], r["at"]] = int(r["total"]) // int(r["n"])
    return new


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, salt: str = "2:") -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256`` of every vector that is kept.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are not read. Vectors of another length or with a null, infinite or
    undefined component are left out. Repeated rows each keep a row; rows without an id are assigned like others but begin no
    cluster. Fewer vectors than ``k`` make fewer clusters; an empty table, or one without ids, gives no rows. Equal distances go
    to the smaller number. Components are held within 2**27 after scaling, so that squared distances fit a long.
    """
    points = integer_vectors(vectors, size, scale)
    found = trees(points)
    centroids = first_centroids(points, k, salt)
    spark = vectors.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(found, centroids)

    def work(every: Iterator[BallTree]) -> Iterator[pa.RecordBatch]:
        for tree in every:
            cluster, distance = tree.nearest(centroids)
            yield pa.RecordBatch.from_arrays([pa.array(tree.ids, pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    assigned = cut(_from_trees(found, "vec_id long, cluster int, distance long", work))
    own = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}  # a row a centroid
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(i, own.get(i, 0), sum(own.values()), shown[i]) for i in range(len(centroids))]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
