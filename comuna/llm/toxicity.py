"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding maps every character to one letter or a blank: accents go, look-alikes of other scripts and digits or signs that
stand for letters become these letters, all else is blank. Folding keeps positions, and lexicon and text are folded alike.

The lexicon holds word beginnings (stems, so that inflected forms count) with their log-odds among labelled documents. Which
stems enter is decided by an exact test at a level that allows for the number of candidates. A stem inside an exception
phrase does not count. A document's features are its weight and its weight per word; a logistic fit turns them into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_by_arrow, cut
from .learning import fit_logistic, labelled_sample, remainder

#: Labelled documents that the lexicon is learnt from, at most.
LABELLED = 20_000
#: Lengths of stems, and toxic documents (near copies counted once) that a stem must have to be tested.
SHORTEST, LONGEST, SUPPORT = 4, 10, 3
#: Chance that some stem enters by luck.
LEVEL = 0.01
#: Least log-odds of a stem.
LEAST = 2.5
#: Near copies: the share of runs of three words that two texts have in common, estimated from so many least hashes of them.
ALIKE, RUNS = 0.4, 32

#: Digits and signs that stand for letters (l is written i, as 1 may be either).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i"}
#: Letters of other scripts by the Latin letter they look like.
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ь": "b",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "γ": "y",
    "ı": "i", "ł": "i", "ø": "o", "đ": "d", "ħ": "h", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʀ": "r", "ʟ": "i", "ⅼ": "i", "ⅰ": "i",
}
#: Harmless phrases around words that insults use.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "loser bracket", "pond scum", "scum of the pond", "sore loser rule", "class clown award")


class _Fold(dict):
    """A ``str.translate`` table that works out characters as they come up."""

    def __missing__(self, point: int) -> str:
        c = unicodedata.normalize("NFKD", chr(point))[:1].lower()[:1]
        c = LOOK_ALIKES.get(c, c)
        c = SUBSTITUTES.get(c, c)
        self[point] = out = c if c.isalpha() else " "
        return out


FOLD = _Fold()


#: Signs that stand for letters do so only before another letter or digit; at a word's end they are punctuation.
_ENDING = re.compile(r"[!|@$]+(?!\w)")


def fold(text: str) -> str:
    """One letter or blank for every character."""
    if "!" in text or "|" in text or "$" in text or "@" in text:
        text = _ENDING.sub(lambda m: " " * len(m[0]), text)
    return text.translate(FOLD)


def stems_of(text: str) -> set[str]:
    """The beginnings of all words of a text, folded."""
    return {w[:n] for w in set(fold(text).split()) for n in range(SHORTEST, min(LONGEST, len(w)) + 1)}


@dataclass
class Lexicon:
    """Weights by folded stem, folded exception phrases, and the fitted score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    score: tuple[float, float, float] = (0.0, 0.0, -30.0)


class Matcher:
    """The automaton of a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon
        self.automaton = ahocorasick.Automaton()
        for stem, weight in lexicon.weights.items():
            self.automaton.add_word(" " + stem, (len(stem), weight))
        for phrase in lexicon.exceptions:
            folded = fold(phrase)
            self.automaton.add_word(f" {folded} ", (len(folded) + 1, None))
        self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """(start, end, weight) of every counted stem in the text, and the number of words."""
        folded = f" {fold(text or '')} "
        found, free = [], []
        for end, (length, weight) in self.automaton.iter(folded):
            (free if weight is None else found).append((end - length, end, weight))
        if free:
            # A stem lies in one word and a phrase holds whole words, so phrases that overlap can be joined.
            starts, ends = [], []
            for a, b, _ in sorted(free):
                if ends and a <= ends[-1]:
                    ends[-1] = max(ends[-1], b)
                else:
                    starts.append(a)
                    ends.append(b)
            inside = lambda f: (i := bisect_right(starts, f[0])) and f[1] <= ends[i - 1]
            found = [f for f in found if not inside(f)]
        return found, len(folded.split())

    def features(self, text: str | None) -> tuple[float, float]:
        found, words = self.hits(text)
        total = sum(w for _, _, w in found)
        return math.log1p(total), math.log1p(100 * total / max(1, words))


def tested_stems(counts: DataFrame, toxic: int, clean: int, candidates: int) -> DataFrame:
    """``stem``, ``toxic``, ``weight`` of the stems that pass the test.

    ``counts`` has ``stem``, ``toxic`` and ``clean``: documents with it, near copies counted once. A stem passes if its log-odds are
    at least ``LEAST`` and Chernoff's bound on the chance of so many toxic documents among those that have it is under ``LEVEL``,
    shared out among all ``candidates``.
    """
    chance, level = toxic / (toxic + clean), math.log(LEVEL / max(1, candidates))
    n = F.col("toxic") + F.col("clean")
    share = F.col("toxic") / n
    rest = F.when(F.col("clean") == 0, 0.0).otherwise((1 - share) * F.log((1 - share) / (1 - chance)))
    tail = F.when(share <= chance, 0.0).otherwise(-n * (share * F.log(share / chance) + rest))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    return counts.where((weight >= LEAST) & (tail < level)).select("stem", "toxic", weight.alias("weight"))


def choose_stems(good: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of those stems that stay. good: toxic documents and weight of the stems that passed the test.

    Of a stem and a longer one the longer stays if it has nearly all of the shorter one's toxic documents, else the shorter.
    """
    out: dict[str, float] = {}
    for stem in sorted(good, key=lambda s: (-len(s), s)):
        up = next((stem[:n] for n in range(len(stem) - 1, SHORTEST - 1, -1) if stem[:n] in good and good[stem[:n]][1] > good[stem][1] - 0.7), None)
        if up is None or good[stem][0] >= 0.95 * good[up][0]:
            out[stem] = good[stem][1]
    for stem in sorted(out, key=len, reverse=True):  # a longer stem that stayed stands for its beginnings
        for n in range(SHORTEST, len(stem)):
            if stem[:n] in out and good[stem][0] >= 0.95 * good[stem[:n]][0]:
                del out[stem[:n]]
    return {s: w for s, w in out.items() if not any(s[:n] in out for n in range(SHORTEST, len(s)))}


def copy_sketch(text: str) -> list[int]:
    """The ``RUNS`` least hashes of the runs of three words, or that of the whole if it is shorter."""
    words = fold(text).split()
    runs = {" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))}
    return sorted(xxhash.xxh64_intdigest(r) >> 1 for r in runs)[:RUNS]


def copy_groups(sketches: list[tuple[int, list[int]]]) -> dict[int, int]:
    """The first near copy (itself, if there is none before) of every document, in order. sketches: key and sketch of each."""
    of: dict[int, int] = {}
    firsts: dict[int, list[int]] = {}
    kept: dict[int, set[int]] = {}
    for key, sketch in sketches:
        mine = set(sketch)
        met = Counter(other for h in sketch for other in firsts.get(h, ()))
        for other, shared in met.most_common():
            if shared < ALIKE * min(len(mine), len(kept[other])):
                break
            least = sorted(mine | kept[other])[:RUNS]
            if sum(h in mine and h in kept[other] for h in least) >= ALIKE * len(least):
                of[key] = other
                break
        if key not in of:
            of[key], kept[key] = key, mine
            for h in sketch:
                firsts.setdefault(h, []).append(key)
    return of


def _with_groups(sample: DataFrame) -> tuple[DataFrame, int, int]:
    """The bounded sample with ``copies`` (null where a document has no near copy of its label), and how many differ: toxic, clean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = pa.array([copy_sketch(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sketches], names=["doc_id", "label", "sketch"])

    rows = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, sketch array<long>").collect()
    pairs, sizes = [], []
    for side in (True, False):
        of = copy_groups(sorted((r["doc_id"], r["sketch"]) for r in rows if (r["label"] == 1) == side))
        members = Counter(of.values())
        pairs += [(key, group) for key, group in of.items() if members[group] > 1]
        sizes.append(len(members))
    groups = sample.sparkSession.createDataFrame(pairs, "doc_id long, copies long")
    return sample.join(F.broadcast(groups), "doc_id", "left"), *sizes


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, most: int = LABELLED, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Learns from rows of ``labels`` (``doc_id``, ``toxic``) whose crc32 remainder is not ``held_out``.

    Null doc_ids and labels teach nothing; without toxic and clean documents to compare the lexicon is empty. Stems are counted
    and tested in the cluster; the driver receives those that pass.
    """
    sample = labelled_sample(docs, labels, "toxic", remainder(F.col("doc_id"), divisor) != held_out, most)
    grouped, toxic, clean = _with_groups(sample)
    if not toxic or not clean:
        return Lexicon({}, exceptions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[str, int, int | None]] = Counter()

        def counted_so_far() -> pa.RecordBatch:
            stems, sides, groups = zip(*counts, strict=True) if counts else ((), (), ())
            columns = [pa.array(stems, pa.string()), pa.array(sides, pa.int32()), pa.array(groups, pa.int64()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["stem", "label", "copies", "n"])

        for batch in batches:
            for text, label, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.update((s, int(label == 1), copies) for s in stems_of(text))
                if len(counts) > 500_000:
                    yield counted_so_far()
                    counts.clear()
        yield counted_so_far()

    # A group of near copies counts once for a stem, however many of them have it.
    each = grouped.select("text", "label", "copies").mapInArrow(run, "stem string, label int, copies long, n long").groupBy("stem", "label", "copies").agg(F.sum("n").alias("n"))
    side = lambda value: F.sum(F.when(F.col("label") == value, F.when(F.col("copies").isNull(), F.col("n")).otherwise(1)).otherwise(0))
    counts = cut(each.groupBy("stem").agg(side(1).alias("toxic"), side(0).alias("clean")).where(F.col("toxic") >= SUPPORT))
    good = {r["stem"]: (r["toxic"], r["weight"]) for r in tested_stems(counts, toxic, clean, counts.count()).collect()}
    lexicon = Lexicon(choose_stems(good), exceptions)
    if lexicon.weights:
        rows = features(sample, lexicon).toPandas()
        fitted = fit_logistic(rows[["weight", "density"]].to_numpy(), (rows["label"] == 1).to_numpy(float), ridge=0.1)
        lexicon.score = tuple(float(w) for w in fitted)
    return lexicon


def features(sample: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``label``, ``weight`` and ``density`` of every row of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            found = np.array([matcher.features(t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["label", "weight", "density"])

    return sample.select("label", "text").mapInArrow(run, "label int, weight double, density double")


def with_score(docs: DataFrame, lexicon: Lexicon, name: str = "toxic_score") -> DataFrame:
    """Adds column ``name``, the score (0 to 1) of the whole ``text`` of every row; a column of that name is replaced."""
    at = [c for c in docs.columns if c.lower() != name.lower()].index("text")
    a, b, c = lexicon.score

    def make():
        matcher = Matcher(lexicon)

        def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = np.array([matcher.features(t) for t in part.column(at).to_pylist()]).reshape(-1, 2)
                yield part, [pa.array(1 / (1 + np.exp(-(found @ (a, b) + c))))]

        return work

    return append_by_arrow(docs, {name: "double"}, make)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) of every row.

    A null text is empty and an empty text matches nothing; rows without doc_id and repeated rows each keep a row; other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, lexicon, "score").select("doc_id", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
