"""Order MinHash: document fingerprints that are sensitive to edit distance.

The k-mers of a text are numbered by occurrence, so that a repeated k-mer counts as often as it occurs. Each of the
fingerprint's elements has its own order of the numbered k-mers; the ``tuple_size`` smallest are selected, put back in text
order and hashed as a tuple. Two texts agree in an element if they select the same k-mers in the same order, so moving a
block of text costs agreement, which a plain MinHash would not notice.

Order i ranks a numbered k-mer with hash h by (h - c_i) mod 2**64 for a fixed constant c_i. One sort of the hashes
therefore serves all elements: the smallest k-mers of order i are the successors of c_i on the circle of sorted hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, shuffle_partitions
from .simhash import _mixed

K, TUPLE, ELEMENTS = 8, 2, 96
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class OrderMinHash:
    """Sketches of ``elements`` 16-bit numbers from tuples of ``tuple_size`` k-mers of ``k`` code points.

    A text of fewer than k code points is one k-mer; a text with fewer k-mers than a tuple selects all it has; the empty
    text has the all-zero sketch.
    """

    def __init__(self, k: int = K, tuple_size: int = TUPLE, elements: int = ELEMENTS):
        self.k, self.tuple_size, self.elements = k, tuple_size, elements
        self.starts = np.sort(_mixed(elements, 11))

    def _kmers(self, points: np.ndarray) -> np.ndarray:
        """A hash of every k-mer, by joining hashes of runs of doubling length."""
        whole = points.astype(np.uint64) + np.uint64(1)
        k = min(self.k, len(points))
        out, done = None, 0
        run, length, rest = whole, 1, k
        while rest:
            if rest & 1:
                part = run[done : done + len(points) - k + 1]
                out = part.copy() if out is None else _mix(out * _ODD + part)
                done += length
            rest >>= 1
            if rest:
                run = _mix(run[:-length] * _ODD + run[length:])
                length *= 2
        return out

    def sketch(self, points: np.ndarray) -> np.ndarray:
        if not len(points):
            return np.zeros(self.elements, np.uint16)
        kmers = _mix(self._kmers(points))
        n = len(kmers)
        bits = np.uint64(max(20, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        at = np.arange(n, dtype=np.uint64)
        # Sorting (hash, place) in one integer puts equal k-mers together in text order.
        order = np.sort((kmers & ~low) | at)
        prefix = order >> bits
        first = np.zeros(n, np.int64)
        new = np.flatnonzero(prefix[1:] != prefix[:-1]) + 1
        first[new] = new
        occurrence = np.arange(n) - np.maximum.accumulate(first)
        place = (order & low).astype(np.int64)
        numbered = np.empty(n, np.uint64)
        numbered[place] = _mix(kmers[place] + occurrence.astype(np.uint64) * _ODD)
        circle = np.sort((numbered & ~low) | at)
        take = min(self.tuple_size, n)
        chosen = (np.searchsorted(circle, self.starts)[:, None] + np.arange(take)) % n
        places = np.sort((circle[chosen] & low).astype(np.int64), axis=1)
        value = np.full(self.elements, take, np.uint64)
        for j in range(take):
            value = _mix(value * _ODD + numbered[places[:, j]])
        return (value >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal elements, 0 to 1."""
    return float((a == b).mean())


def as_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u2").tobytes().hex()


def order_minhash(docs: DataFrame, k: int = K, tuple_size: int = TUPLE, elements: int = ELEMENTS) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hexadecimal) of every row's whole text.

    A null text is empty. Every row, repeated or without doc_id, gives a row; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OrderMinHash(k, tuple_size, elements)
        for batch in batches:
            prints = [as_hex(hasher.sketch(code_points(t or ""))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``_tail`` in partitions of ascending doc_id, each ended by the next partition's first document.

    No global window: rows are dealt out by ranges of doc_id, and the first document of a range (of the first range, for the
    last) is sent to the range before as well, flagged ``_tail``. The driver sees one number per range.
    """
    spark = docs.sparkSession
    lowest = -(2**63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_key", F.coalesce("doc_id", F.lit(lowest)))
    bounds = range_bounds(rows, "_key", shuffle_partitions(spark))
    own = bucket_of("_key", bounds)
    heads = sorted(tuple(r) for r in rows.groupBy(own.alias("range")).agg(F.min("_key").alias("head")).collect())
    own_place = F.struct(own.alias("range"), F.lit(False).alias("tail"))
    places = F.array(own_place)
    if heads:
        before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
        to = F.element_at(F.create_map(*[F.lit(x).cast(t) for pair in before.items() for x, t in zip(pair, ("long", "int"), strict=True)]), F.col("_key"))
        tail = F.struct(to.alias("range"), F.lit(True).alias("tail"))
        places = F.when(F.col("_key").isin(list(before)), F.array(own_place, tail)).otherwise(places)
    placed = rows.withColumn("_place", F.explode(places)).select("doc_id", "text", "_key", F.col("_place.range").alias("_range"), F.col("_place.tail").alias("_tail"))
    dealt = placed.repartitionById(len(bounds) + 1, F.col("_range"))
    return dealt.sortWithinPartitions("_tail", "_key", "text").select("doc_id", "text", "_tail")


def edit_probe(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last floor(n / ``share``) code points replaced by the first as many (or all) of the next
    document's, by ascending doc_id (rows without doc_id come first, ties go by text, null first); the first follows the
    last, and a single document follows itself. A null text is empty. Columns: ``doc_id``, ``n_chars``, ``edited_sha256``,
    ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = OrderMinHash()
        held = None
        for batch in batches:
            out = []
            for doc_id, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tail and held is None:
                    continue
                text = text or ""
                sketch = hasher.sketch(code_points(text))
                if held is not None:
                    was_id, was, was_sketch = held
                    cut = len(was) // share
                    edited = was[: len(was) - cut] + text[:cut]
                    new = hasher.sketch(code_points(edited))
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((was_id, len(was), digest, as_hex(was_sketch), as_hex(new), likeness(was_sketch, new), likeness(was_sketch, sketch)))
                held = None if tail else (doc_id, text, sketch)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
