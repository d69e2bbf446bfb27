"""Vector similarity: exact, and by an inverted file."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scoring import Best, spread

#: Queries that are broadcast at a time.
BROADCAST_QUERIES = 10_000


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, unequal lengths or zero norms."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, v: t + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def vector_scores(queries: DataFrame, vectors: DataFrame, itself: bool = False) -> DataFrame:
    """Similarity of every stated query (``query_id``, ``q``) to every other vector (``chunk_id``, ``embedding``), and with ``itself`` to that of its own id.

    Queries are broadcast in blocks of bounded size, so the vectors stay where they are.
    """
    blocks = max(1, -(-queries.count() // BROADCAST_QUERIES))
    part = lambda i: F.broadcast(queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i))
    met = lambda i: vectors.join(part(i), F.lit(True) if itself else F.col("query_id") != F.col("chunk_id")).select("query_id", "chunk_id", cosine(F.col("q"), F.col("embedding")).alias("similarity"))
    return reduce(DataFrame.unionByName, [met(i) for i in range(blocks)])


#: Pairs that a task compares at a time, and how far a product of unit vectors may be from the similarity it stands for.
PAIRS, SLACK = 1 << 21, 1e-9


def _exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``cosine`` of the rows of ``q`` and ``v``, to the last bit: sums run over the components in order."""
    with np.errstate(all="ignore"):
        dot, a, b = (np.zeros(len(q)) for _ in range(3))
        for i in range(q.shape[1]):
            dot += q[:, i] * v[:, i]
            a += q[:, i] * q[:, i]
            b += v[:, i] * v[:, i]
        norm = np.sqrt(a) * np.sqrt(b)
        return np.where((norm > 0) | np.isnan(norm), dot / norm, 0.0)


def _by_size(lists: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places, vectors and unit vectors of the lists of each length, without null and empty ones. A vector whose unit cannot be told has none but NaN."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == size)
        found = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
        with np.errstate(all="ignore"):
            most = np.abs(found).max(axis=1)
            unit = found / np.linalg.norm(found, axis=1, keepdims=True)
        unit[most == 0] = 0.0
        unit[~((most == 0) | ((most > 1e-100) & (most < 1e100)))] = np.nan
        out[size] = at, found, unit
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int, itself: bool = False) -> DataFrame:
    """The ``k`` most similar of what ``vector_scores`` gives for each query, with ``place``; ties go to the smaller id.

    Vectors stay where they are. A task multiplies a few of them with a block of the queries, and works out exactly only those
    pairs that may be among its ``k`` best, so it sends ``k`` rows a query.
    """
    spark = vectors.sparkSession
    whole = lambda c: F.when(F.forall(c, lambda x: x.isNotNull()), F.col(c).cast("array<double>"))
    asked = queries.select("query_id", whole("q").alias("q"))
    stored = spread(vectors.select("chunk_id", "embedding")).select("chunk_id", whole("embedding").alias("embedding"))
    kinds = dict(asked.dtypes)["query_id"], dict(stored.dtypes)["chunk_id"]
    types = to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(stored.schema["chunk_id"].dataType)
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))

    def part(number: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()  # at most about BROADCAST_QUERIES
        held = spark.sparkContext.broadcast((own.column(0).to_pylist(), own.column(1).combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, by_size = held.value[0], _by_size(held.value[1])
            best, number_of = Best(len(ids), k), {}
            for i, q in enumerate(ids):
                number_of.setdefault(q, []).append(i)
            step = max(1, PAIRS // max(1, len(ids)))
            for whole_batch in batches if ids else ():
                for batch in pa.Table.from_batches([whole_batch]).to_batches(max_chunksize=step):
                    keys = batch.column(0).to_pylist()
                    near = np.zeros((len(ids), len(keys)))
                    of = _by_size(batch.column(1))
                    for size in of.keys() & by_size.keys():
                        near[np.ix_(by_size[size][0], of[size][0])] = np.nan_to_num(by_size[size][2] @ of[size][2].T, nan=np.inf)
                    if not itself:
                        same = [(i, j) for j, key in enumerate(keys) for i in number_of.get(key, ())]
                        near[[i for i, _ in same], [j for _, j in same]] = -np.inf
                    least = best.least
                    if len(keys) > k and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(near, len(keys) - k, axis=1)[:, len(keys) - k])
                    i, j = np.nonzero((near >= least[:, None] - SLACK) & (near > -np.inf))
                    value = np.zeros(len(i))
                    for size in of.keys() & by_size.keys():
                        row_q, row_v = np.full(len(ids), -1), np.full(len(keys), -1)
                        row_q[by_size[size][0]], row_v[of[size][0]] = range(len(by_size[size][0])), range(len(of[size][0]))
                        both = np.flatnonzero((row_q[i] >= 0) & (row_v[j] >= 0))
                        for start in range(0, len(both), PAIRS // 32):
                            few = both[start : start + PAIRS // 32]
                            value[few] = _exact(by_size[size][1][row_q[i[few]]], of[size][1][row_v[j[few]]])
                    score = np.where(np.isnan(value), np.inf, value)  # NaN is the greatest number
                    kept = score >= best.least[i]
                    best.add(pd.DataFrame({"query": i[kept], "score": score[kept], "value": value[kept], "key": np.array(keys)[j[kept]], "asked": False}))
                    if np.isneginf(best.least).any():
                        best.cut()
            found = best.cut()
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found["query"]], types[0]), pa.array(found["key"].tolist(), types[1]), pa.array(found["value"].to_numpy(), from_pandas=False)], names=["query_id", "chunk_id", "similarity"])

        return stored.mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, similarity double")

    found = reduce(DataFrame.unionByName, [part(i) for i in range(blocks)])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


#: Vectors that the coarse centroids are learnt from at most, rounds of learning, cells at most, and files that a cell is dealt over.
SAMPLE, ROUNDS, CELLS, SALTS = 20_000, 10, 4096, 8


def _unit(rows: list[list[float]] | np.ndarray) -> np.ndarray:
    found = np.asarray(rows, np.float64)
    return found / np.linalg.norm(found, axis=1, keepdims=True)


def coarse_centroids(vectors: DataFrame, cells: int, sample: int = SAMPLE) -> np.ndarray:
    """Directions that cut the vectors into cells: spherical k-means over a sample of at most about ``sample`` of them, by a hash of the id.

    The sample bounds only how well the cells fit; every vector goes to a cell.
    """
    n = vectors.count()
    kept = vectors.where(F.pmod(F.xxhash64(F.lit("cells"), "chunk_id"), F.lit(1_000_000)) < F.lit(min(1_000_000, -(-1_000_000 * sample // max(n, 1)))))
    found = [r["embedding"] for r in kept.orderBy(F.xxhash64("chunk_id"), "chunk_id").select("embedding").limit(sample).collect()]
    if not found:
        return np.empty((0, 0))
    points = _unit(found)
    centres = points[:cells]
    for _ in range(ROUNDS):
        cell = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, points)
        has = np.linalg.norm(sums, axis=1) > 0
        centres = np.where(has[:, None], sums / np.where(has, np.linalg.norm(sums, axis=1), 1)[:, None], centres)
    return centres


def write_cells(vectors: DataFrame, folder: str, size: int, cells: int | None = None, sample: int = SAMPLE) -> str:
    """Writes an inverted file of ``vectors`` (``chunk_id``, ``embedding``) to a new folder below ``folder`` and returns it.

    Every vector of ``size`` numbers goes to the cell of the nearest coarse centroid, a folder each, dealt over ``SALTS`` files, so a
    cell that holds a third of all is no single task's. ``cells`` is the square root of their number by default. Vectors of another
    length, with a null or of norm zero are similar to nothing and left out.
    """
    path = f"{folder.rstrip('/')}/cells-{uuid.uuid4().hex}"
    spark = vectors.sparkSession
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select("chunk_id", x.alias("embedding")).where((F.size("embedding") == size) & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("embedding", lambda v: v != 0))
    number = cells or max(1, min(CELLS, round(rows.count() ** 0.5)))
    centres = spark.sparkContext.broadcast(coarse_centroids(rows, number, sample))  # at most CELLS directions
    kind = dict(rows.dtypes)["chunk_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)) if batch.num_rows else np.empty((0, size))
            cell = (points @ centres.value.T).argmax(axis=1) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=["chunk_id", "embedding", "cell"])

    placed = rows.mapInArrow(run, f"chunk_id {kind}, embedding array<double>, cell int")
    placed.repartition("cell", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS))).write.partitionBy("cell").parquet(f"{path}/vectors")
    listed = list(enumerate(centres.value.tolist()))
    spark.createDataFrame(listed, "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    return path


def near_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, itself: bool = False) -> DataFrame:
    """``query_id``, ``chunk_id``, ``similarity`` of the ``k`` most similar vectors of each query (``query_id``, ``q``) in the ``probes`` nearest cells.

    Only folders of cells that some query probes are read; in them every vector is compared exactly, so all that can be missed
    lies in cells that were not probed, and with all cells probed nothing is. A task keeps the ``k`` best of each query. A query's
    own id counts only with ``itself``; queries without a vector of the right length find nothing.
    """
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()]  # at most CELLS
    if not centres:
        return spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, chunk_id long, similarity double, place int")
    stored = spark.read.schema(f"chunk_id {dict(spark.read.parquet(f'{path}/vectors').dtypes)['chunk_id']}, embedding array<double>, cell int").parquet(f"{path}/vectors")
    size = len(centres[0])
    asked = queries.select("query_id", F.col("q").cast("array<double>").alias("q")).where((F.size("q") == size) & F.forall("q", lambda v: v.isNotNull() & ~F.isnan(v)) & F.exists("q", lambda v: v != 0))
    kinds = dict(asked.dtypes)["query_id"], dict(stored.dtypes)["chunk_id"]
    types = to_arrow_type(asked.schema["query_id"].dataType), to_arrow_type(stored.schema["chunk_id"].dataType)
    blocks = max(1, -(-asked.count() // BROADCAST_QUERIES))

    def part(number: int) -> DataFrame:
        own = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).collect()  # at most about BROADCAST_QUERIES
        q = _unit([r["q"] for r in own]) if own else np.empty((0, size))
        order = np.argsort(-(q @ np.array(centres).T), axis=1, kind="stable")[:, :probes] if own else np.empty((0, 0), int)
        held = spark.sparkContext.broadcast(([r["query_id"] for r in own], q, {c: np.flatnonzero((order == c).any(axis=1)) for c in np.unique(order).tolist()}))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors, by_cell = held.value
            best = Best(len(ids), k)
            for batch in batches:
                cells = batch.column(2).to_numpy()
                for cell in np.unique(cells).tolist():
                    at, mine = by_cell[cell], np.flatnonzero(cells == cell)
                    few = batch.take(pa.array(mine))
                    near = vectors[at] @ _unit(few.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)).T
                    keys = np.array(few.column(0).to_pylist())
                    i, j = np.nonzero(near >= best.least[at][:, None])
                    if not itself:
                        other = np.array([ids[a] for a in at[i]]) != keys[j]
                        i, j = i[other], j[other]
                    best.add(pd.DataFrame({"query": at[i], "score": near[i, j], "key": keys[j], "asked": False}))
            found = best.cut()
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in found["query"]], types[0]), pa.array(found["key"].tolist(), types[1]), pa.array(found["score"])], names=["query_id", "chunk_id", "similarity"])

        return stored.where(F.col("cell").isin(*np.unique(order).tolist())).mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, similarity double")

    found = reduce(DataFrame.unionByName, [part(i) for i in range(blocks)])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


def parse_vector(text: Column) -> Column:
    """A JSON list of numbers as an array; anything else as an empty one."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def vector_text(vector: Column, size: int = 1536) -> Column:
    """The text that a vector column takes, numbers without needless zeros, missing ones as 0; null for another number of elements."""
    shown = F.transform(vector, lambda x: F.regexp_replace(F.coalesce(F.when(~F.isnan(x), x), F.lit(0.0)).cast("string"), r"\.0$", ""))
    return F.when(F.size(vector) == size, F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]")))
