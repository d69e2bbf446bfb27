"""SimHash near-duplicate detection with pivot distance tables.

A fingerprint bit is the majority of that bit over the hashes of a text's word shingles. Fingerprints link when they
differ in at most ``radius`` bits. The search runs in four steps, none of which looks at all pairs:

1. Pivot distances. Every distinct fingerprint gets its Hamming distances to fixed reference fingerprints, once; the row of the
   table travels with the fingerprint.
2. Blocking. Every distinct fingerprint is sent to buckets in which each linked pair must (``pigeonhole_keys``: exact) or
   almost surely does (``sampled_rows``: for wide fingerprints and large radii) meet.
3. Inside a bucket members lie in the order of their distance to the pivot that spreads them most, so a member is held only
   against those whose distance to it differs by ``radius`` at most. By the triangle inequality the maximum difference over all
   pivots discards most of these as well; survivors are verified by XOR and population count. A breadth-first search over the
   bucket gives its components, and only one edge per member is emitted, to the component's least member: a bucket of n
   copies gives n - 1 edges and not n * (n - 1) / 2 pairs.
4. The edges' connected components, by the large-star/small-star method, with a reliable checkpoint every round.

Exact copies are one fingerprint, so they cost one row from step 1 on. Buckets above ``hot`` members are split into
sub-buckets for every pair of member groups: all pairs still meet, but no task holds the bucket whole. Rows that all look for
the same counterpart stay in place and have it broadcast (``common.lookup``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

SEED = 42
#: Members of a bucket that one task may compare with each other.
HOT_BUCKET = 16_384
PIVOTS = 16
#: Runs of up to this many members are compared by offset, vectorised over all runs of a batch.
SMALL_RUN = 12


def _mixed(count: int, salt: int) -> np.ndarray:
    """``count`` fixed 64-bit constants by the splitmix rule."""
    z = np.uint64(salt) + np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included, as unsigned 64-bit integers.

    Words are runs of bytes other than ASCII white space after lower-casing A-Z. A text of fewer words has one shingle, the
    whole sequence; a text without words (or null) has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[min(words, len(found)) - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]), ">u8").astype(np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint: bit i is 1 if it is set in over half the hashes; no hashes give zero."""
    if not len(hashes):
        return 0
    counts = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id``, ``fp`` (the fingerprint's 64 bits as a signed long) of every row; other columns are left behind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((majority(shingle_hashes(t, words)) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


class WideSimHash:
    """Fingerprints of ``bits`` bits for similarities at which 64 bits tell too little.

    The set of a text's shingle hashes is sketched into ``cells`` signed counts and projected on ``bits`` fixed hyperplanes;
    two sets with Jaccard similarity J disagree in about ``arccos(2J / (1 + J)) / pi`` of the bits.
    """

    def __init__(self, words: int, bits: int, cells: int = 1024):
        self.words, self.bits, self.cells = words, bits, cells
        # Sums of four bytes are close to normal, so the angle formula holds for sets of few shingles too; as integers they add
        # up exactly, and equal sets have equal codes in any batch.
        parts = _mixed(cells * bits // 2, 7).view(np.uint8).reshape(cells, bits, 4)
        self.planes = parts.sum(axis=2, dtype=np.int64).astype(np.float32) - 510

    def codes(self, sets: list[np.ndarray]) -> np.ndarray:
        sketch = np.zeros((len(sets), self.cells), np.float32)
        for i, h in enumerate(sets):
            if len(h):
                sign = ((h >> np.uint64(40)) & np.uint64(1)).astype(np.float64) * 2 - 1
                sketch[i] = np.bincount((h & np.uint64(self.cells - 1)).astype(np.int64), sign, self.cells)
        return np.packbits(sketch @ self.planes > 0, axis=1, bitorder="little").view("<u8").astype(np.uint64).reshape(len(sets), -1)


def wide_fingerprints(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``doc_id``, ``code`` (array of ``bits / 64`` longs, zero for texts without words), ``digest`` (equal for equal shingle sets), ``size`` of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WideSimHash(words, bits)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column(1).to_pylist()]
                codes = hasher.codes(sets).view(np.int64)
                digests = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(codes), pa.list_(pa.int64())), pa.array(digests), pa.array(list(map(len, sets)), pa.int32())], names=["doc_id", "code", "digest", "size"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, code array<long>, digest long, size int")


def pigeonhole_keys(fp: Column, radius: int = 4, blocks: int = 7) -> Column:
    """Array of bucket keys of a 64-bit fingerprint: one for every ``blocks - radius`` of its blocks.

    At most ``radius`` differing bits touch at most ``radius`` blocks, so two linked fingerprints agree in some
    ``blocks - radius`` blocks and share that key.
    """
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    chosen = [sum(c) for c in combinations(masks, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in chosen]
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(m).cast("long"))) for i, m in enumerate(signed)])


def pivot_table(nodes: DataFrame, bits: int, pivots: int) -> DataFrame:
    """``node``, ``code`` (the code's bytes, and behind them its distances to the pivots as 16-bit numbers) of every node.

    ``nodes`` has ``node`` long and ``code`` array<long> of ``bits / 64``.
    """
    words = bits // 64
    refs = _mixed(pivots * words, 99).reshape(pivots, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                codes = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False)).view(np.uint64).reshape(part.num_rows, words)
                row = np.empty((part.num_rows, 8 * words + 2 * pivots), np.uint8)
                row[:, : 8 * words] = codes.view(np.uint8)
                near = np.stack([np.bitwise_count(codes ^ ref).sum(axis=1, dtype=np.int16) for ref in refs], axis=1)
                row[:, 8 * words :] = np.ascontiguousarray(near).view(np.uint8)
                yield pa.RecordBatch.from_arrays([part.column(0), _fixed(row)], names=["node", "code"])

    return nodes.select("node", "code").mapInArrow(run, "node long, code binary")


def _fixed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as a binary column."""
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes_of(column: pa.Array) -> np.ndarray:
    """A binary column of equal lengths as a matrix of bytes."""
    n = len(column)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(n, -1)


def sampled_rows(nodes: DataFrame, bits: int, tables: int, width: int) -> DataFrame:
    """``key``, ``node``, ``code``: each node of a pivot table in a bucket of each of ``tables`` tables.

    A table's key is made of ``width`` of the code's bits, chosen by a fixed rule.
    """
    picks = [np.sort(np.argsort(_mixed(bits, 1000 + 7919 * t))[:width]) for t in range(tables)]
    powers = (1 << np.arange(width)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = _bytes_of(part.column(1))
                set_bits = np.unpackbits(rows[:, : bits // 8], axis=1, bitorder="little")
                keys = np.concatenate([(set_bits[:, p] @ powers) + (t << 32) for t, p in enumerate(picks)])
                nodes_of = pa.array(np.tile(part.column(0).to_numpy(zero_copy_only=False), tables))
                yield pa.RecordBatch.from_arrays([pa.array(keys), nodes_of, _fixed(np.tile(rows, (tables, 1)))], names=["key", "node", "code"])

    return nodes.select("node", "code").mapInArrow(run, "key long, node long, code binary")


def _linked(codes: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs (a, b) link: the pivot table discards, XOR and population count verify."""
    near = (np.abs(table[a] - table[b]).max(axis=1) <= radius).nonzero()[0]
    return near[np.bitwise_count(codes[a[near]] ^ codes[b[near]]).sum(axis=1, dtype=np.int64) <= radius]


def _components(codes: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """The first member of every member's component in one bucket's link graph, by breadth-first search in pivot order."""
    n = len(codes)
    spread = table[:, int(table.astype(np.int64).var(axis=0).argmax())]
    rest = np.argsort(spread, kind="stable")  # members that no search has reached, by distance to the pivot
    reach = spread[rest]
    of, free = np.arange(n), np.ones(n, bool)
    for first in range(n):
        if not free[first]:
            continue
        free[first] = False
        queue = [first]
        while queue and len(rest):
            at = queue.pop()
            lo, hi = np.searchsorted(reach, (spread[at] - radius, spread[at] + radius + 1))
            near = rest[lo:hi][free[rest[lo:hi]]]
            found = near[_linked(codes, table, np.full(len(near), at), near, radius)]
            if len(found):
                of[found] = first
                free[found] = False
                queue.extend(found.tolist())
                keep = free[rest]
                rest, reach = rest[keep], reach[keep]
    return of


def bucket_edges(rows: DataFrame, radius: int, bits: int = 64) -> DataFrame:
    """Edges inside the buckets of ``rows`` (``key``, ``node``, ``code`` of ``pivot_table``) as distinct ``src < dst``.

    They join what links in a bucket, directly or through others; an edge itself need not be a link. Rows are streamed in key
    order; memory holds one Arrow batch and one bucket.
    """
    words = bits // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def solve(keys, nodes, rows):
            edge = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(keys)]))
            sizes = ends - starts
            keep = np.repeat(sizes > 1, sizes)
            out_a, out_b = [], []
            if keep.any():
                keys, nodes, rows = keys[keep], nodes[keep], rows[keep]
                codes = np.ascontiguousarray(rows[:, : 8 * words]).view(np.uint64)
                near = np.ascontiguousarray(rows[:, 8 * words :]).view(np.int16)
                starts = np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1]
                sizes = sizes[sizes > 1]
                small = np.repeat(sizes <= SMALL_RUN, sizes).nonzero()[0]
                for lag in range(1, SMALL_RUN):
                    a = small[:-lag] if lag < len(small) else small[:0]
                    b = small[lag:]
                    same = keys[a] == keys[b]
                    if not same.any():
                        break
                    a, b = a[same], b[same]
                    hit = _linked(codes, near, a, b, radius)
                    out_a.append(nodes[a[hit]])
                    out_b.append(nodes[b[hit]])
                for at, size in zip(starts[sizes > SMALL_RUN].tolist(), sizes[sizes > SMALL_RUN].tolist(), strict=True):
                    part = slice(at, at + size)
                    out_a.append(nodes[part][_components(codes[part], near[part], radius)])
                    out_b.append(nodes[part])
            a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_a, out_b))
            a, b = np.minimum(a, b), np.maximum(a, b)
            differ = a != b
            pairs = np.unique(np.stack((a[differ], b[differ]), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, nodes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            table = _bytes_of(batch.column(2))
            last = int(np.searchsorted(keys, keys[-1]))
            if last or (held and held[0][0][0] != keys[0]):
                head = (keys[:last], nodes[:last], table[:last])
                yield solve(*(np.concatenate(x) for x in zip(*held, head, strict=True)))
                held = []
            held.append(tuple(x[last:].copy() for x in (keys, nodes, table)))
        if held:
            yield solve(*(np.concatenate(x) for x in zip(*held, strict=True)))

    placed = rows.select("key", "node", "code").repartition("key").sortWithinPartitions("key", "node")
    return placed.mapInArrow(run, "src long, dst long").distinct()


def split_hot(rows: DataFrame, nodes: int, keys: int, hot: int) -> DataFrame:
    """Gives buckets of more than about ``hot`` members new keys, one for every pair of member groups.

    ``nodes`` have ``keys`` rows each. Which buckets are hot is estimated from one in 64 of the nodes. That choice moves work
    only: with either keys every pair of a bucket's members meets in some task.
    """
    seen = rows.select("key", "node").where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(64)) == 0).groupBy("key").agg((F.count(F.lit(1)) * 64).alias("_members"))
    large = cut(seen.where(F.col("_members") > hot).select("key", "_members", F.ceil(F.col("_members") / hot).cast("int").alias("_groups")))
    if large.isEmpty():
        return rows
    joined = lookup(rows, large, "key", "_members", nodes * keys)
    mine = F.pmod(F.xxhash64("node", F.lit(6)), F.col("_groups")).cast("int")
    other = F.explode(F.when(F.col("_groups").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("_groups") - 1)))
    wide = joined.withColumn("_mine", mine).withColumn("_other", other)
    key = F.when(F.col("_groups").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("_mine", "_other"), F.greatest("_mine", "_other")))
    return wide.select(key.alias("key"), "node", "code")


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) for every node of ``edges`` (``src``, ``dst`` longs).

    Large star: whoever points to a node points to that node's least neighbour. Small star: a node's lesser neighbours, and the
    node, point to the least of them. Both look up a value that many rows may share, hence ``lookup``.
    """
    both = edges.where(F.col("src") != F.col("dst"))
    edges = cut(both.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
    now, before = state(edges), None
    while now != before and now[0]:
        lows = edges.groupBy("src").agg(F.min("dst").alias("low")).withColumnRenamed("src", "dst")
        degrees = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"))
        met = lookup(edges, degrees.join(lows, "dst", "left"), "dst", "n", now[0])
        down = cut(met.select("src", F.coalesce("low", "dst").alias("dst")))
        least = down.groupBy("src").agg(F.min("dst").alias("low"), F.count(F.lit(1)).alias("n"))
        met = lookup(down, least, "src", "n", now[0])
        small = met.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(least.select("src", F.col("low").alias("dst")))
        edges = cut(small.where("src != dst").distinct())
        now, before = state(edges), now
    lows = edges.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(lows)


def simhash_components(docs: DataFrame, words: int = 4, radius: int = 4, hot: int = HOT_BUCKET) -> DataFrame:
    """``doc_id``, ``fp``, ``component_id`` of every row: documents whose fingerprints link, directly or through others.

    Exact: no linked pair is missed. Nulls: a null text is an empty one (fingerprint zero, which links like any other); a null
    doc_id keeps its row, and a component's id ignores it (null if all are null). Repeated rows each keep a row. Columns other
    than ``doc_id`` and ``text`` are not read; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, words))
    total = prints.count()
    nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("rows")))
    table = pivot_table(nodes.select(F.col("fp").alias("node"), F.array("fp").alias("code")), 64, PIVOTS)
    keys = pigeonhole_keys(F.col("node"), radius, radius + 3)
    rows = table.select(F.explode(keys).alias("key"), "node", "code")
    of = connected_components(bucket_edges(split_hot(rows, nodes.count(), len(list(combinations(range(radius + 3), 3))), hot), radius))
    named = nodes.join(of, nodes["fp"] == of["node"], "left").select("fp", "low", "rows", F.coalesce("component", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = cut(lookup(named, ids, "root", "n", total).select("fp", "component_id", "rows"))
    return lookup(prints, named, "fp", "rows", total).select("doc_id", "fp", "component_id")


def _alike(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of all pairs at Jaccard similarity ``similarity`` or more, by breadth-first search."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(len(ids), bool)
    free, queue, parents, children = np.ones(len(sets), bool), [], [], []
    for first in range(len(sets)):
        if not free[first]:
            continue
        free[first] = False
        queue.append(first)
        while queue and free.any():
            at = queue.pop()
            mine = ids[starts[at] : starts[at] + sizes[at]]
            mark[mine] = True
            common = np.add.reduceat(mark[ids], starts, dtype=np.int64)
            mark[mine] = False
            found = (free & (common / (sizes[at] + sizes - common) >= similarity)).nonzero()[0]
            free[found] = False
            parents.append(np.full(len(found), at))
            children.append(found)
            queue.extend(found.tolist())
        queue.clear()
    empty = np.empty(0, np.int64)
    return nodes[np.concatenate([empty, *parents])], nodes[np.concatenate([empty, *children])]


def alike_edges(docs: DataFrame, members: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """``src < dst`` pairs at exact Jaccard similarity ``similarity`` or more of their sets of shingle hashes.

    ``members`` has ``node`` (a doc_id), ``component`` and ``size`` (of its set). Within a component all pairs are compared and the
    edges of spanning forests kept. Components of more than ``block`` hashes, a member counting as ``block / BLOCK_MEMBERS`` at
    least, are dealt out by pairs of blocks, so a task holds about two blocks of one.
    """

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t, words)).view(np.int64) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(sets, pa.list_(pa.int64()))], names=["node", "component", "blocks", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _alike(np.array(nodes, np.int64), sets, similarity)
            pairs = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1)[a != b], axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["src", "dst"])

        last, nodes, sets = None, [], []
        for batch in batches:
            lists = batch.column(2)
            ends, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for i, (key, node) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if key != last:
                    if len(nodes) > 1:
                        yield solve(nodes, sets)
                    last, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(np.array(values[ends[i] : ends[i + 1]]))
        if len(nodes) > 1:
            yield solve(nodes, sets)

    weight = F.greatest(F.col("size"), F.lit(block // BLOCK_MEMBERS))
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum(weight) / block).cast("int").alias("blocks"))
    placed = lookup(members, sized, "component", "n", members.count()).select("node", "component", "blocks")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    sets = placed.join(texts, "node").select("node", "component", "blocks", "text").mapInArrow(shingled, "node long, component long, blocks int, shingles array<long>")
    mine = F.pmod(F.xxhash64("node", F.lit(8)), F.col("blocks")).cast("int")
    wide = sets.where("size(shingles) > 0").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = wide.select(F.xxhash64("component", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("key"), "node", "shingles")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "src long, dst long").distinct()


#: For near_duplicate_groups: 512 bits; 15 bits in each of 64 tables meet 99 of 100 pairs at similarity 0.8.
WIDE_BITS, TABLES, TABLE_BITS, WIDE_PIVOTS = 512, 64, 15, 4
#: Shingle hashes and members of a block of exact comparison.
BLOCK, BLOCK_MEMBERS = 1 << 20, 512


def wide_radius(similarity: float) -> int:
    """Differing bits up to which a pair is a candidate: what ``similarity`` gives on average, plus three standard errors."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(np.ceil(WIDE_BITS * share + 3 * (WIDE_BITS * share * (1 - share)) ** 0.5))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, hot: int = HOT_BUCKET, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``group_id`` (smallest doc_id of its near-duplicate group) of every row with a doc_id.

    Documents link when the Jaccard similarity of their sets of shingle hashes is ``similarity`` or more; groups are connected
    components. No other pair links. Fingerprints only find candidates: their components at ``wide_radius`` bits, within which all
    pairs are compared exactly. Texts without words equal each other. Nulls: null text is empty; rows without doc_id are left
    out (the stage keeps them all). Repeated rows of one doc_id give one row.
    """
    known = docs.where(F.col("doc_id").isNotNull())
    codes = cut(wide_fingerprints(known, words, WIDE_BITS))
    total = codes.count()
    # Equal digests mean equal sets and hence equal codes; an empty set has size zero.
    nodes = cut(codes.groupBy("digest", "size").agg(F.min(F.struct("doc_id", "code")).alias("least"), F.count(F.lit(1)).alias("rows")).select("digest", "size", "rows", F.col("least.doc_id").alias("node"), "least.code"))
    rows = sampled_rows(cut(pivot_table(nodes, WIDE_BITS, WIDE_PIVOTS)), WIDE_BITS, TABLES, TABLE_BITS)
    near = connected_components(bucket_edges(split_hot(rows, nodes.count(), TABLES, hot), wide_radius(similarity), WIDE_BITS))
    members = cut(near.join(nodes.groupBy("node").agg(F.max("size").alias("size")), "node"))
    edges = alike_edges(known, members, words, similarity, block)
    copied = nodes.where("rows > 1").select(F.xxhash64("digest", "size").alias("same"), "node", "rows")
    same = codes.select(F.xxhash64("digest", "size").alias("same"), "doc_id")
    copies = lookup(same, copied, "same", "rows", total).where(F.col("doc_id") != F.col("node")).select(F.col("node").alias("src"), F.col("doc_id").alias("dst"))
    of = connected_components(edges.union(copies))
    every = codes.select("doc_id").distinct()
    return every.join(of, every["doc_id"] == of["node"], "left").select("doc_id", F.coalesce("component", "doc_id").alias("group_id"))
