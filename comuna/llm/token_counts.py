"""Edit-aware token counts.

A document's pre-tokens lie under a segment tree: a leaf holds a short run of them, every node the sums of characters and
tokens below it. Leaves are built from whole runs of pre-tokens whose counts the worker remembers; a leaf's own pre-tokens are
worked out when an edit first reaches it. An edit re-splits and re-encodes only from just before the first touched character
until the new pre-token boundaries meet the old ones again; then the sums on the paths from the touched leaves to the root are
brought up to date.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

#: Runs of pre-tokens per leaf when a tree is built, and pre-tokens of a leaf that edits have touched, at most.
LEAF, FULL = 16, 512
#: Characters of text whose new pre-tokens are encoded together.
BATCH_CHARS = 2_000_000
#: How far beyond its end a pre-token's match may look: the longest contraction less one, with some to spare.
LOOKAHEAD = 4


class TokenTree:
    """Token counts of one document under edits."""

    def __init__(self, text: str, encoder: bpe.BytePairEncoder, cut: tuple[list[str], list[str]] | None = None):
        """cut: the text's runs of pre-tokens as ``encoder.cut_many`` gives them, if they are at hand."""
        self.encoder, self.text = encoder, text
        plain, spaced = encoder.cut_many([text])[0] if cut is None else cut
        odd = encoder.odd_chunks and not (encoder.odd_chunks.isdisjoint(plain) and encoder.odd_chunks.isdisjoint(spaced))
        #: What cuts the text: once a code point came on which versions of Unicode differ, the exact pattern.
        self.matcher = encoder.pretokens.exact if odd else encoder.pretokens.plain
        sums = np.empty((len(plain) + len(spaced), 2), np.int64)
        for runs, known, lead, at in ((plain, encoder.chunks, 0, slice(0, len(plain))), (spaced, encoder.spaced, 1, slice(len(plain), None))):
            sums[at, 0] = np.fromiter(map(len, runs), np.int64, len(runs)) + lead
            sums[at, 1] = np.fromiter(map(len, map(known.__getitem__, runs)), np.int64, len(runs)) >> 2
        self._build(np.add.reduceat(sums, np.arange(0, len(sums), LEAF)) if len(sums) else np.zeros((1, 2), np.int64))
        #: Sizes and counts of every leaf's pre-tokens; None where no edit has come yet.
        self.leaves: list[tuple[list[int], list[int]] | None] = [None] * max(1, -(-len(sums) // LEAF))

    def _build(self, sums: np.ndarray) -> None:
        level = np.zeros((1 << (len(sums) - 1).bit_length(), 2), np.int64)
        level[: len(sums)] = sums
        self.levels = [level]
        while len(level) > 1:
            level = level[0::2] + level[1::2]
            self.levels.append(level)

    def _counts(self, words: list[str]) -> list[int]:
        known = self.encoder.known
        try:
            return [len(known[w]) >> 2 for w in words]
        except KeyError:
            self.encoder.learn(set(words))
            return [len(known[w]) >> 2 for w in words]

    def _leaf(self, leaf: int, begin: int, text: str) -> tuple[list[int], list[int]]:
        """Sizes and counts of the pre-tokens of a leaf that begins at ``begin`` of ``text``, which the tree describes."""
        if self.leaves[leaf] is None:
            words = self.matcher.findall(text[begin : begin + int(self.levels[0][leaf, 0])])
            self.leaves[leaf] = list(map(len, words)), self._counts(words)
        return self.leaves[leaf]

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    def _locate(self, position: int) -> tuple[int, int]:
        """The leaf that holds the character at ``position`` (the last, if none does) and its first character."""
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            left = int(level[node, 0])
            if position >= begin + left and level[node + 1, 0]:
                begin += left
                node += 1
        return node, begin

    def _update(self, first: int, last: int) -> None:
        for leaf in range(first, last + 1):
            self.levels[0][leaf] = sum(self.leaves[leaf][0]), sum(self.leaves[leaf][1])
        for depth in range(1, len(self.levels)):
            first, last = first >> 1, last >> 1
            below = self.levels[depth - 1][2 * first : 2 * last + 2]
            self.levels[depth][first : last + 1] = below[0::2] + below[1::2]

    def _replace(self, first: int, last: int, sizes: list[int], counts: list[int]) -> None:
        """Puts these pre-tokens in the place of leaves ``first`` to ``last``."""
        share = -(-len(sizes) // (last - first + 1))
        if share <= FULL:
            for i in range(first, last + 1):
                lo = (i - first) * share
                self.leaves[i] = sizes[lo : lo + share], counts[lo : lo + share]
            return self._update(first, last)
        # Too many for these leaves: new leaves, and new sums above them.
        cut = range(0, len(sizes), FULL // 4)
        fresh = [(sizes[i : i + FULL // 4], counts[i : i + FULL // 4]) for i in cut]
        sums, n = self.levels[0], len(self.leaves)
        self._build(np.concatenate((sums[:first], [(sum(s), sum(c)) for s, c in fresh], sums[last + 1 : n])))
        self.leaves[first : last + 1] = fresh

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Replaces ``length`` characters at ``start``; returns how many characters were encoded again.

        A start or an end outside the text is moved to the text's nearest end.
        """
        old = self.text
        if self.matcher is not self.encoder.pretokens.exact:
            self.matcher = self.encoder.pretokens.of(replacement)
        start = min(max(start, 0), len(old))
        end = min(start + max(length, 0), len(old))
        self.text = text = old[:start] + replacement + old[end:]
        shift = len(text) - len(old)
        touched = max(0, start - LOOKAHEAD)
        first, begin = self._locate(touched)
        head, place = self._leaf(first, begin, old), 0
        while place + 1 < len(head[0]) and begin + head[0][place] <= touched:
            begin += head[0][place]
            place += 1
        leaf, at, boundary = first, place, begin  # the old boundary that is looked at, by leaf and place
        tail = head
        words: list[str] = []
        position = begin
        for match in self.matcher.finditer(text, begin):
            # A boundary past the edit that is an old one, moved: from here on nothing changes.
            while boundary + shift < position or boundary < end:
                if at < len(tail[0]):
                    boundary += tail[0][at]
                    at += 1
                elif leaf + 1 < len(self.leaves):
                    leaf, at = leaf + 1, 0
                    tail = self._leaf(leaf, boundary, old)
                else:
                    break
            if position >= start + len(replacement) and boundary >= end and boundary + shift == position:
                break
            words.append(match[0])
            position = match.end()
        else:
            while leaf + 1 < len(self.leaves):  # all that is left has been split anew
                leaf += 1
                self.leaves[leaf] = self.leaves[leaf] or ([], [])
            tail, at = ([], []), 0
        sizes = head[0][:place] + list(map(len, words)) + tail[0][at:]
        counts = head[1][:place] + self._counts(words) + tail[1][at:]
        self._replace(first, leaf, sizes, counts)
        return position - begin


def count_edits(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``edited_tokens``, ``edited_chars``, ``encoded_again`` of every row.

    ``docs`` has ``doc_id``, ``text`` and ``edits``: array of (start, length, text) in code points, applied one after the
    other, each to what the one before left. Null texts are empty; null edits, or null parts of one, change nothing (a null
    replacement is empty). ``encoded_again`` counts the characters that the edits had encoded. Repeated rows each give a row;
    other columns are not read.
    """
    default = bpe.default_vocabulary()
    path, pattern = path or default[0], pattern or default[1]
    vocabulary = bpe.load_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder_of(vocabulary.value, pattern)
        for batch in batches:
            for start, count in bpe.batches_of(batch.column(1), BATCH_CHARS):
                ids, texts, edits = (c.to_pylist() for c in batch.slice(start, count).columns)
                cut = encoder.cut_many([t or "" for t in texts])
                rows = []
                for t, runs, changes in zip(texts, cut, edits, strict=True):
                    tree, again = TokenTree(t or "", encoder, runs), 0
                    before = tree.tokens
                    for e in changes or ():
                        if e is not None and e["start"] is not None and e["length"] is not None:
                            again += tree.edit(e["start"], e["length"], e["text"] or "")
                    rows.append((before, tree.tokens, len(tree.text), again))
                columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, columns)], names=["doc_id", "n_tokens", "edited_tokens", "edited_chars", "encoded_again"])

    rows = docs.selectExpr("cast(doc_id AS long) doc_id", "cast(text AS string) text", "cast(edits AS array<struct<start:int,length:int,text:string>>) edits")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, edited_tokens long, edited_chars long, encoded_again long")
