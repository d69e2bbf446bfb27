"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Letters are lower-cased and runs of other characters become one blank. Benchmark items are cut into overlapping windows of at
most ``WINDOW`` characters; a window of m characters has an edit budget e. By the q-gram lemma a passage within e edits of it
shares at least m - q + 1 - q * e q-grams with it, all on at most e + 1 neighbouring diagonals. So:

1. every q-gram of a document that some window has is a hit on a diagonal (place in document less place in window);
2. hits are counted in diagonal bands of e + 1 diagonals that overlap by e, so that each passage lies wholly in some band;
3. bands that reach the lemma's bound are kept and verified by banded alignment, which gives the edits and the region.

No passage within budget of a window is missed; what is found is a whole window, so the shortest passage that is sure to be
found in a longer item is ``WINDOW + STEP`` characters of it. Windows of fewer than q characters have no q-gram and are looked
up as they are, between blanks. Equal windows are one window with several items. Hits are counted and candidates verified in
slices of bounded size, so memory does not grow with a text or with how often it repeats itself.

A large benchmark is dealt into blocks; a task builds each block's index once and writes it to the shared folder. Tasks over
documents read one index at a time, and look for its windows in a whole Arrow batch before they read the next; nothing is
broadcast and the driver has the files' names only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_by_arrow, free_name, new_file, open_file, out_dir
from .order_minhash import _mix, _ODD, code_points

Q, RATE, WINDOW, STEP = 10, 0.08, 200, 100
#: Benchmark characters under one index, on average; a task holds one index and one Arrow batch of documents at a time.
BLOCK_CHARS = 2_000_000
#: Hits counted at a time, and candidates verified at a time.
HITS, CANDIDATES = 1_000_000, 4_096
_TABLE_BITS = 22
_BLANK = 32


def _folded(point: int) -> int:
    c = chr(point)
    return ord(c.lower()[0]) if c.isalnum() else _BLANK


class Normal:
    """Normalised code points and where each stood in the text."""

    def __init__(self):
        self.table = np.fromiter(map(_folded, range(0x3000)), np.uint32, 0x3000)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        points = code_points(text or "")
        if not len(points):
            return points, np.empty(0, np.int64)
        low = points < 0x3000
        folded = self.table[np.where(low, points, 0)]
        if not low.all():
            folded[~low] = [_folded(p) for p in points[~low].tolist()]
        blank = folded == _BLANK
        keep = ~blank
        keep[1:] |= ~blank[:-1]
        places = np.flatnonzero(keep)
        if len(places) and folded[places[-1]] == _BLANK:
            places = places[:-1]
        return folded[places], places


def qgrams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of every q-gram: runs of doubling length are joined."""
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    run, length, out, done, rest = points.astype(np.uint64) + np.uint64(1), 1, None, 0, q
    while True:
        if rest & 1:
            part = run[done : done + n]
            out = part.copy() if out is None else (out * _ODD) ^ (part + (out >> np.uint64(23)))
            done += length
        rest >>= 1
        if not rest:
            return _mix(out)
        run = _mix(run[:-length] * _ODD + run[length:])
        length *= 2


def budget(m: int, q: int = Q, rate: float = RATE) -> int:
    """The edits allowed in a window of m characters: a share of it, but so few that the lemma's bound is at least 1."""
    return max(0, min(int(rate * m), (m - q) // q))


class Windows:
    """The windows of a block of benchmark items and an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.normal = Normal()
        self.item: list[list[int]] = []
        points, self.short = [], {}
        seen: dict[bytes, int] = {}
        for item, text in items:
            found, _ = self.normal(text)
            if not len(found):
                continue
            last = max(0, len(found) - WINDOW)
            for at in sorted({*range(0, last, STEP), last}):
                one = found[at : at + WINDOW]
                if len(one) < Q:
                    self.short.setdefault(" " + "".join(map(chr, one.tolist())).strip() + " ", []).append(item)
                    continue
                slot = seen.setdefault(one.tobytes(), len(points))
                if slot == len(points):
                    self.item.append([])
                    points.append(one)
                if item not in self.item[slot][-1:]:
                    self.item[slot].append(item)
        self.points = points
        self.size = np.array([len(p) for p in points], np.int64)
        self.edits = np.array([budget(len(p)) for p in points], np.int64)
        self.bound = self.size - Q + 1 - Q * self.edits
        grams = [qgrams(p) for p in points]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        window = np.repeat(np.arange(len(points)), [len(g) for g in grams])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])
        order = np.argsort(every, kind="stable")
        self.window, self.place = window[order].astype(np.int32), place[order].astype(np.int16)
        self.grams, self.first = np.unique(every[order], return_index=True)
        self.first = np.append(self.first, len(every)).astype(np.int32 if len(every) < 1 << 31 else np.int64)
        self.there = np.zeros(1 << _TABLE_BITS, bool)
        self.there[(self.grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True

    def candidates(self, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, band) of every band whose shared q-grams reach the bound, in slices of the text.

        A band that later hits may still reach is held over to the next slice with its count.
        """
        if not len(self.grams):
            return
        grams = qgrams(points)
        at = np.flatnonzero(self.there[(grams >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
        if not len(at):
            return
        slot = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        same = self.grams[slot] == grams[at]
        at, slot = at[same], slot[same]
        times = self.first[slot + 1] - self.first[slot]
        run = np.cumsum(times, dtype=np.int64) // HITS
        edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(at)]
        key, count = np.empty(0, np.int64), np.empty(0, np.int64)
        for lo, hi in zip(edges, edges[1:]):
            n = times[lo:hi].astype(np.int64)
            entry = np.repeat(self.first[slot[lo:hi]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            window = self.window[entry].astype(np.int64)
            diagonal = np.repeat(at[lo:hi], n) - self.place[entry] + WINDOW  # never negative
            width = self.edits[window] + 1
            band = diagonal // width
            twice = diagonal % width < self.edits[window]  # the part that two bands share
            new = np.concatenate((window << 40 | (band + 1), window[twice] << 40 | band[twice]))
            new, more = np.unique(new, return_counts=True)
            key, where = np.unique(np.concatenate((key, new)), return_inverse=True)
            count = np.bincount(where, np.concatenate((count, more)), len(key)).astype(np.int64)
            window, band = key >> 40, (key & ((1 << 40) - 1)) - 1
            # A later hit at p lies on a diagonal of at least p - (WINDOW - Q) + WINDOW.
            past = band * (self.edits[window] + 1) + 2 * self.edits[window] < (at[hi] + Q if hi < len(at) else np.inf)
            good = past & (count >= self.bound[window])
            if good.any():
                yield window[good], band[good]
            key, count = key[~past], count[~past]

    def verify(self, points: np.ndarray, window: np.ndarray, band: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, edits) in normalised places of the candidates within budget, by banded alignment."""
        out = []
        for size in np.unique(self.size[window]).tolist():
            mine = self.size[window] == size
            w, b = window[mine], band[mine]
            e = int(self.edits[w[0]])
            width = 2 * e + 1
            low = b * (e + 1) - WINDOW
            pattern = np.stack([self.points[i] for i in w.tolist()]).astype(np.int64)
            # A cell holds edits * width + first diagonal, so the least cell names the least edits and where they begin.
            across = np.arange(width)
            step = across * width
            cell = np.tile(across, (len(w), 1))
            for j in range(size):
                place = low[:, None] + j + across
                inside = (place >= 0) & (place < len(points))
                letter = np.where(inside, points[np.clip(place, 0, len(points) - 1)], -1)
                new = cell + width * (letter != pattern[:, j, None])
                new[:, :-1] = np.minimum(new[:, :-1], cell[:, 1:] + width)  # a letter of the window is missing
                cell = np.minimum.accumulate(new - step, axis=1) + step  # letters of the document are extra
            best = cell.argmin(axis=1)
            value = cell[np.arange(len(w)), best]
            edits, first = value // width, value % width
            for k in np.flatnonzero(edits <= e).tolist():
                begin, end = max(0, int(low[k] + first[k])), min(len(points), int(low[k] + size + best[k]))
                out.extend((item, begin, end, int(edits[k])) for item in self.item[int(w[k])])
        return out

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, edits) of every region found, in the text's code points; regions of an item that overlap are one."""
        points, places = self.normal(text)
        regions: dict[int, list[list[int]]] = {}

        def add(found):
            for item, begin, end, edits in found:
                mine = regions.setdefault(item, [])
                mine.append([begin, end, edits])
                if len(mine) > 10_000:
                    mine[:] = _merged(mine)

        for window, band in self.candidates(points) if len(points) >= Q else ():
            for at in range(0, len(window), CANDIDATES):
                add(self.verify(points, window[at : at + CANDIDATES], band[at : at + CANDIDATES]))
        if self.short:
            shown = " " + "".join(map(chr, points.tolist())).strip() + " "
            shift = 1 if len(points) and points[0] != _BLANK else 0
            for word, items in self.short.items():
                at = shown.find(word)
                while at >= 0:
                    add((item, at + 1 - shift, at + len(word) - 1 - shift, 0) for item in items)
                    at = shown.find(word, at + 1)
        return [(item, int(places[a]), int(places[min(z, len(places)) - 1]) + 1, e) for item, mine in sorted(regions.items()) for a, z, e in _merged(mine)]


def _merged(regions: list[list[int]]) -> list[list[int]]:
    """Overlapping regions joined, with the least edits of each."""
    out: list[list[int]] = []
    for begin, end, edits in sorted(regions):
        if out and begin < out[-1][1]:
            out[-1][1:] = max(out[-1][1], end), min(out[-1][2], edits)
        else:
            out.append([begin, end, edits])
    return out


_WINDOWS: dict[str, Windows] = {}


def windows_at(uri: str) -> Windows:
    """A block's index; the last one used is kept from task to task."""
    if uri not in _WINDOWS:
        _WINDOWS.clear()
        with open_file(uri) as f:
            _WINDOWS[uri] = pickle.loads(f.read())
    return _WINDOWS[uri]


def indexed(benchmark: DataFrame, most: int | None = None) -> list[str]:
    """Files of the benchmark's indexes, each of about ``most`` characters of it (``BLOCK_CHARS`` by default), written by a task each.

    Items are dealt out by a hash of id and text. One item is never cut, so an index has at least the longest item's windows.
    """
    spark = benchmark.sparkSession
    rows = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = -(-total // (most or BLOCK_CHARS))
    if not n:
        return []
    folder = out_dir(spark, "leaks")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sorted((item, text) for batch in batches for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        if items:
            uri, out = new_file(folder, ".windows")
            with out:
                out.write(pickle.dumps(Windows(items), protocol=5))
            yield pa.RecordBatch.from_pydict({"path": [uri]})

    dealt = rows.distinct().withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartitionById(n, F.col("_block"))
    return sorted(r["path"] for r in dealt.select("item_id", "text").mapInArrow(build, "path string").collect())


def leaks_in(texts: pa.Array, indexes: list[str], load: Callable[[str], Windows] = windows_at) -> list[list[tuple[int, int, int, int]]]:
    """``Windows.leaks`` of every text under all indexes: each index is loaded once."""
    found: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(texts))]
    for uri in indexes:
        windows = load(uri)
        for mine, text in zip(found, texts, strict=True):
            mine.extend(windows.leaks(text.as_py()))
    return [sorted(mine) for mine in found]


def mark_leaks(docs: DataFrame, benchmark: DataFrame, name: str = "leaks") -> DataFrame:
    """Adds column ``name`` to every row: array of (item_id, begin, end, edits), one entry per region of its whole text that
    holds a passage of a benchmark item.

    ``docs`` needs ``text``; a column ``name`` of its own is replaced. A null text has none, an empty table gives none, repeated
    rows each keep a row. Benchmark rows without item_id or text, and texts without letters or digits, are nothing to look for.
    No shuffle of documents and one pass over them.
    """
    kind = "array<struct<item_id:bigint,begin:bigint,end:bigint,edits:int>>"
    entry = pa.list_(pa.struct([("item_id", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    at = [c for c in docs.columns if c.lower() != name.lower()].index("text")
    fields = ("item_id", "begin", "end", "edits")
    indexes = indexed(benchmark)

    def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
        found = leaks_in(batch.column(at), indexes)
        yield batch, [pa.array([[dict(zip(fields, leak, strict=True)) for leak in mine] for mine in found], entry)]

    return append_by_arrow(docs, {name: kind}, lambda: work)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``begin``, ``end``, ``edits`` of every benchmark passage in every row; clean rows give none."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mark_leaks(rows, benchmark).select("doc_id", "leaks").select("doc_id", F.inline("leaks"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage."""
    name = free_name(docs.columns, "leaks")
    return mark_leaks(docs, benchmark, name).where(F.size(name) == 0).drop(name)
