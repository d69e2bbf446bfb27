"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Text is cut into pre-tokens by a pattern; each is encoded on its own by merging, again and again, the leftmost pair of the
lowest rank. The queue of candidate pairs has one bucket of linked-list positions per rank and three levels of bitmaps over
the ranks: find-first-set from the top level down gives the lowest rank with candidates, whatever the length of the
pre-token. Entries of pairs that a merge has changed stay where they are and are skipped when they come up. A pre-token of n
bytes costs O(n log n) at worst, so a pre-token of a million letters is no problem.

Pre-tokens repeat, so each Python worker encodes the distinct new ones of a batch together, under one queue, and keeps a
bounded table of those it has encoded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import append_by_arrow, quoted

#: The Unicode White_Space characters, for which the pattern's white-space class stands (Python's own has four more).
_SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = re.escape(_SPACES)
#: A run of white space with what follows it up to the next: no pre-token crosses the start of such a run.
CHUNK = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+")
_PAIRS = [c + " " for c in _SPACES]
#: Entries that a worker remembers; above this it begins anew with the next batch.
REMEMBERED = 900_000
#: Pre-tokens of more bytes are encoded each with a queue of its own.
LONGEST = 64
#: So few pre-tokens are not worth a common queue.
FEW = 48
#: Characters of text that are encoded together.
BATCH_CHARS = 3_000_000
#: A vocabulary file is sent to the executors; this bounds it.
VOCABULARY_BYTES = 64 << 20


def batches_of(column: pa.Array, most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Runs of rows (start, count) of about ``most`` bytes of text each."""
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    sizes = np.diff(np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1]) if len(column) else np.empty(0)
    run = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(column)]
    return ((a, b - a) for a, b in zip(edges, edges[1:]) if b > a)


_CLASS = re.compile(r"\\[pP](?:\{[^}]*\}|\w)")


def class_differences(name: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of code points that only this module's pattern library counts to a class, and that only the tokenizer library does.

    The two follow different versions of Unicode. The tokenizer library is asked by having it cut all code points at once.
    """
    import tiktoken

    every = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000)))
    text = every.astype("<u4").tobytes().decode("utf-32-le")
    asked = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    flags = []
    for found in (asked.decode_bytes(asked.encode_ordinary(text)).decode(), "".join(regex.findall(name, text))):
        has = np.zeros(0x110000, bool)
        has[np.frombuffer(found.encode("utf-32-le"), "<u4")] = True
        flags.append(has)

    def ranges(has: np.ndarray) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], has.astype(np.int8), [0]))))
        return [(a, z - 1) for a, z in zip(edges[::2].tolist(), edges[1::2].tolist())]

    return ranges(flags[1] & ~flags[0]), ranges(flags[0] & ~flags[1])


class Pretokens:
    """A pre-token pattern that matches as the tokenizer library does, whatever versions of Unicode the two libraries follow.

    White-space classes are spelled out. Texts with a code point on which the versions differ are cut by a pattern whose classes
    are corrected one by one, all others by the plain one.
    """

    def __init__(self, pattern: str):
        spelled = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"(?!\S)", f"(?![^{WHITE}])").replace(r"\s", f"[{WHITE}]")
        shown = lambda found: "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in found)
        exact, odd = spelled, ""
        for name in sorted(set(_CLASS.findall(pattern))):
            ours, theirs = class_differences(name)
            odd += shown(ours) + shown(theirs)
            held = f"[{name}--[{shown(ours)}]]" if ours else name
            exact = exact.replace(name, f"[{held}||[{shown(theirs)}]]" if theirs else held)
        self.plain = regex.compile(spelled)
        self.exact = regex.compile(exact, regex.V1) if odd else self.plain
        self.odd = re.compile(f"[{odd}]").search if odd else lambda text: None

    def of(self, text: str) -> regex.Pattern:
        """The pattern to cut this text with."""
        return self.exact if not text.isascii() and self.odd(text) else self.plain

    def __call__(self, text: str) -> list[str]:
        return self.of(text).findall(text)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class RankQueue:
    """Positions by rank; ``push`` and ``pop`` (lowest rank, then lowest position) under three levels of 64-bit bitmaps."""

    def __init__(self, ranks: int):
        words = (ranks >> 6) + 1
        self.low, self.mid, self.top = [0] * words, [0] * ((words >> 6) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        w = rank >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[w >> 6] |= 1 << (w & 63)
        self.top |= 1 << (w >> 6)

    def lowest(self) -> int:
        """The lowest rank with a bucket."""
        h = (self.top & -self.top).bit_length() - 1
        mid = self.mid[h]
        w = (h << 6) + (mid & -mid).bit_length() - 1
        low = self.low[w]
        return (w << 6) + (low & -low).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Takes the lowest rank out of the bitmaps."""
        w = rank >> 6
        self.low[w] &= self.low[w] - 1
        if not self.low[w]:
            h = w >> 6
            self.mid[h] &= self.mid[h] - 1
            if not self.mid[h]:
                self.top &= self.top - 1

    def pop(self) -> tuple[int, int]:
        rank = self.lowest()
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.drop(rank)
        return rank, at

    def pop_bucket(self) -> tuple[int, list[int]]:
        """The lowest rank and all its positions, in no order."""
        rank = self.lowest()
        self.drop(rank)
        return rank, self.buckets.pop(rank)

    def fill_empty(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Fills an empty queue, a whole bucket at a time."""
        order = np.argsort(ranks, kind="stable")
        ranks, held = ranks[order], places[order].tolist()
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:] != ranks[:-1]))) if len(ranks) else np.empty(0, np.int64)
        edges = [*starts.tolist(), len(held)]
        for rank, a, b in zip(ranks[starts].tolist(), edges, edges[1:]):
            self.buckets[rank] = held[a:b]
            w = rank >> 6
            self.low[w] |= 1 << (rank & 63)
            self.mid[w >> 6] |= 1 << (w & 63)
            self.top |= 1 << (w >> 6)

    def fill(self, ranks: np.ndarray, places: np.ndarray) -> None:
        """Adds many positions, for use with ``pop_bucket``."""
        buckets, low, mid = self.buckets, self.low, self.mid
        for rank, at in zip(ranks.tolist(), places.tolist()):
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [at]
                w = rank >> 6
                low[w] |= 1 << (rank & 63)
                mid[w >> 6] |= 1 << (w & 63)
                self.top |= 1 << (w >> 6)
            else:
                bucket.append(at)


class BytePairEncoder:
    """Encodes and decodes by a rank table and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.pretokens = Pretokens(pattern)
        self.highest = max(ranks.values(), default=0)
        self.queue = RankQueue(self.highest)
        #: Ids (32-bit little-endian) of pre-tokens, of chunks as they are, and of chunks that follow a blank.
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        #: The remembered chunks with code points on which versions of Unicode differ: hardly ever any.
        self.odd_chunks: set[str] = set()
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_values = np.append(np.fromiter(pairs.values(), np.int64, len(pairs))[order], -1)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        get = self.ranks.get
        whole = get(piece)
        if whole is not None:
            return [whole]
        n, queue = len(piece), self.queue
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank_at = [get(piece[i : i + 2]) for i in range(n - 1)]
        rank_at.append(None)
        push, pop = queue.push, queue.pop
        for i, rank in enumerate(rank_at):
            if rank is not None:
                push(rank, i)
        while queue.top:
            rank, i = pop()
            if rank_at[i] != rank:
                continue  # stale: a merge has changed this pair
            j = after[i]
            parts[i] += parts[j]
            parts[j] = None
            rank_at[j] = None
            k = after[j]
            after[i] = k
            if k < n:
                before[k] = i
                new = get(parts[i] + parts[k])
                if new is not None:
                    push(new, i)
                rank_at[i] = new
            else:
                rank_at[i] = None
            h = before[i]
            if h >= 0:
                new = get(parts[h] + parts[i])
                if new is not None and new != rank_at[h]:
                    push(new, h)
                rank_at[h] = new
        ranks = self.ranks
        return [ranks[p] for p in parts if p is not None]

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of many short pre-tokens under one rank queue.

        The pieces lie end to end in linked lists of their own. A pop takes the lowest rank's bucket and merges the leftmost
        of its positions in every piece at once; what else it holds goes back, as a merge may bring up a lower rank.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        n = len(data)
        if not n:
            return [b"" for _ in pieces]
        piece_of = np.repeat(np.arange(len(pieces)), sizes)
        token = self.byte_ids[data].astype(np.int64)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[sizes > 0] - 1] = -1
        before[(ends - sizes)[sizes > 0]] = -1
        rank_at = np.full(n, -1, np.int64)
        inner = np.flatnonzero(after >= 0)
        rank_at[inner] = self.pair_ranks(token[inner], token[inner + 1])
        queue = RankQueue(self.highest)
        start = np.flatnonzero(rank_at >= 0)
        queue.fill_empty(rank_at[start], start)
        while queue.top:
            rank, at = queue.pop_bucket()
            at = np.array(at)
            at = np.sort(at[rank_at[at] == rank])  # the others are stale
            if not len(at):
                continue
            lead = np.ones(len(at), bool)
            lead[1:] = piece_of[at[1:]] != piece_of[at[:-1]]
            if not lead.all():
                queue.fill(np.full(int((~lead).sum()), rank), at[~lead])
                at = at[lead]
            gone = after[at]
            right, left = after[gone], before[at]
            token[at] = rank
            token[gone] = -1
            after[at] = right
            rank_at[gone] = -1
            rank_at[at] = -1
            has = right >= 0
            i, k = at[has], right[has]
            before[k] = i
            rank_at[i] = self.pair_ranks(token[i], token[k])
            has = left >= 0
            h, j = left[has], at[has]
            rank_at[h] = self.pair_ranks(token[h], token[j])
            new = np.concatenate((i, h))
            ranks = rank_at[new]
            queue.fill(ranks[ranks >= 0], new[ranks >= 0])
        alive = token >= 0
        cuts = (4 * np.concatenate(([0], np.cumsum(alive)))[np.concatenate(([0], ends))]).tolist()
        ids = token[alive].astype("<i4").tobytes()
        return [ids[x:y] for x, y in zip(cuts, cuts[1:])]

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two tokens make together, -1 if none."""
        key = (a << 32) | b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[at] == key, self.pair_values[at], -1)

    def forget(self) -> None:
        """Begins anew if more is remembered than the bound; only between batches."""
        if len(self.known) + len(self.chunks) + len(self.spaced) > REMEMBERED:
            self.known, self.chunks, self.spaced, self.odd_chunks = {}, {}, {}, set()

    def learn(self, words: set[str]) -> None:
        """Encodes those pre-tokens that are not remembered: short ones together, long or few ones each with a queue of its own."""
        new = [w for w in words if w not in self.known]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LONGEST and r not in self.ranks]
        short = short if len(short) > FEW else []
        for i, ids in zip(short, self.merge_many([raw[i] for i in short]), strict=True):
            self.known[new[i]] = ids
        for w, r in zip(new, raw, strict=True):
            if w not in self.known:
                self.known[w] = np.array(self.merge(r), "<i4").tobytes()

    def _remember(self, chunks: dict[str, bytes], new: set[str], lead: str) -> None:
        plain, exact, odd = self.pretokens.plain.findall, self.pretokens.exact.findall, self.pretokens.odd
        found = {c for c in new if not c.isascii() and odd(c)}
        self.odd_chunks |= found
        cut = {c: plain(lead + c) for c in new if c not in found} | {c: exact(lead + c) for c in found}
        self.learn(set(chain.from_iterable(cut.values())))
        known = self.known
        for c, words in cut.items():
            chunks[c] = known[words[0]] if len(words) == 1 else b"".join(map(known.__getitem__, words))

    def cut_many(self, texts: list[str]) -> list[tuple[list[str], list[str]]]:
        """Every text as whole runs of pre-tokens, which are encoded and remembered: chunks as they are, then chunks that follow a blank.

        A cut before a blank that follows no white space is a pre-token boundary, so most texts are cut by ``split`` alone.
        """
        self.forget()
        parts = [t.split(" ") if not any(pair in t for pair in _PAIRS) and t[:1] != " " else None for t in texts]
        cut = [(p[:1], p[1:]) if p else (CHUNK.findall(t), []) for t, p in zip(texts, parts, strict=True)]
        self._remember(self.chunks, set(chain.from_iterable(c for c, _ in cut)) - self.chunks.keys(), "")
        self._remember(self.spaced, set(chain.from_iterable(s for _, s in cut)) - self.spaced.keys(), " ")
        return cut

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids (32-bit little-endian) of every text."""
        cut = self.cut_many(texts)
        chunk, spaced = self.chunks.__getitem__, self.spaced.__getitem__
        return [b"".join(map(chunk, c)) + b"".join(map(spaced, s)) for c, s in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple[int, str], BytePairEncoder] = {}


def encoder_of(vocabulary: bytes, pattern: str) -> BytePairEncoder:
    """This worker's encoder; kept from task to task with what it remembers."""
    key = (hash(vocabulary), pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = BytePairEncoder(read_ranks(vocabulary), pattern)
    return _ENCODERS[key]


def load_vocabulary(spark: SparkSession, path: str):
    """The file as a broadcast variable; one above ``VOCABULARY_BYTES`` is refused, so what is broadcast is bounded."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoded(docs: DataFrame, path: str | None, pattern: str | None, text: str, decoded: bool) -> DataFrame:
    default = default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]
    vocabulary = load_vocabulary(docs.sparkSession, path)
    added = {"ids": "array<int>"} | ({"decoded": "binary"} if decoded else {})
    at = [c for c in docs.columns if c.lower() not in added].index(text)
    docs = docs.withColumn(text, F.col(quoted(text)).cast("string"))

    def make():
        encoder = encoder_of(vocabulary.value, pattern)

        def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for start, count in batches_of(batch.column(at)):
                part = batch.slice(start, count)
                found = encoder.encode_many([t or "" for t in part.column(at).to_pylist()])
                ends = np.cumsum([0, *map(len, found)]) // 4
                flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(found))])
                own = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
                if decoded:
                    own.append(pa.array([encoder.decode(np.frombuffer(ids, "<i4").tolist()) for ids in found], pa.binary()))
                yield part, own

        return work

    return append_by_arrow(docs, added, make)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array<int>) to every row: its whole text encoded, each match of the pattern on its own.

    A null text is empty and gives an empty array. A column ``ids`` of ``docs`` is replaced; repeated rows each keep a row; an
    empty table gives an empty result.
    """
    return _encoded(docs, path, pattern, text, decoded=False)


def encode_and_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """``encode``, and ``decoded`` (binary), the bytes that ``decode`` gives for ``ids``, in one pass."""
    return _encoded(docs, path, pattern, text, decoded=True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of ``ids``. Null ids give no bytes; an id outside the vocabulary is an error.

    A column ``decoded`` of ``encoded`` is replaced.
    """
    default = default_vocabulary()
    vocabulary, pattern = load_vocabulary(encoded.sparkSession, path or default[0]), default[1]
    at = [c for c in encoded.columns if c.lower() != "decoded"].index("ids")

    def make():
        encoder = encoder_of(vocabulary.value, pattern)

        def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                yield part, [pa.array([encoder.decode(ids or ()) for ids in part.column(at).to_pylist()], pa.binary())]

        return work

    return append_by_arrow(encoded, {"decoded": "binary"}, make)
