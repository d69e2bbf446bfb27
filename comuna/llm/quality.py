"""Document quality by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else is unlabelled web text. The class prior is estimated from
how a first classifier's scores fall among positives and unlabelled texts. The model, a layer of rectified units on features
of the text's shape, then minimises the non-negative unbiased risk with the logistic loss,

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

so its output is the chance of being good. Negative labels are never used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_by_arrow, cut
from .learning import labelled_sample, remainder, share_of

#: Positives and unlabelled documents that the model is fitted on, at most.
POSITIVES, UNLABELLED = 8_000, 16_000
#: Character classes: lower, upper, other letter, digit, blank, line break, and the signs that stand alone.
_SIGNS = ".,!?*#$%&|<>{}@-_"
_CLASSES = 7 + len(_SIGNS)
_STATS = 14


def _class_of(point: int) -> int:
    c = chr(point)
    if c in _SIGNS:
        return 7 + _SIGNS.index(c)
    if c == "\n":
        return 5
    if c.isspace():
        return 4
    kind = unicodedata.category(c)
    return {"Ll": 0, "Lu": 1, "Lt": 1}.get(kind, 2 if kind[0] == "L" else 3 if kind[0] == "N" else 6)


class Shapes:
    """Features of a text's shape: counts of neighbouring character classes and shares of repeated words and lines."""

    SIZE = _CLASSES * _CLASSES + _STATS

    def __init__(self):
        self.table = np.fromiter((_class_of(i) for i in range(0x3000)), np.uint8, 0x3000)

    def __call__(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.SIZE, np.float32)
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        n = len(points)
        if not n:
            return out
        kinds = self.table[np.minimum(points, 0x2FFF)].astype(np.int64)
        if n > 1:
            pairs = np.bincount(kinds[:-1] * _CLASSES + kinds[1:], minlength=_CLASSES * _CLASSES)
            out[: _CLASSES * _CLASSES] = np.sqrt(pairs / (n - 1))
        words = text.split()
        lines = [x for x in text.split("\n") if x]
        counts = np.bincount(kinds, minlength=_CLASSES) / n
        lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
        distinct = set(words)
        out[_CLASSES * _CLASSES :] = (
            np.log1p(n) / 10, len(words) / n, lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100,
            len(distinct) / max(1, len(words)), len(distinct) / max(1, len(words)) ** 0.7 / 4, len(set(lines)) / max(1, len(lines)), len(lines) / max(1, len(words)),
            counts[:3].sum(), counts[1], counts[3], counts[6:].sum(), float(n < 200),
        )
        return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    prior: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.maximum(z @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _train(p: np.ndarray, u: np.ndarray, prior: float | None, units: int = 24, epochs: int = 40, batch: int = 512, rate: float = 0.003, seed: int = 7) -> Model:
    """Adam on the non-negative risk, or on plain positives against unlabelled where no prior is given."""
    rng = np.random.default_rng(seed)
    both = np.concatenate((p, u))
    mean, scale = both.mean(axis=0), both.std(axis=0) + 0.02
    z = lambda x: np.clip((x - mean) / scale, -6, 6).astype(np.float32)
    p, u = z(p), z(u)
    w = [rng.normal(0, (2 / p.shape[1]) ** 0.5, (p.shape[1], units)).astype(np.float32), np.zeros(units, np.float32), rng.normal(0, units**-0.5, units).astype(np.float32), np.zeros(1, np.float32)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    sigmoid = lambda f: 1 / (1 + np.exp(-np.clip(f, -30, 30)))
    softplus = lambda f: np.logaddexp(0, f)
    for _ in range(epochs):
        order_u = rng.permutation(len(u))
        order_p = rng.permutation(len(p))
        for at in range(0, len(u), batch):
            xu = u[order_u[at : at + batch]]
            xp = p[order_p[(at * len(p) // len(u) + np.arange(batch)) % len(p)]]
            x = np.concatenate((xp, xu))
            h = x @ w[0] + w[1]
            a = np.maximum(h, 0)
            f = a @ w[2] + w[3][0]
            fp, fu = f[: len(xp)], f[len(xp) :]
            if prior is None:
                gp, gu = (sigmoid(fp) - 1) / len(xp), sigmoid(fu) / len(xu)
            elif softplus(fu).mean() - prior * softplus(fp).mean() >= 0:
                gp, gu = prior * (sigmoid(fp) - 1) / len(xp) - prior * sigmoid(fp) / len(xp), sigmoid(fu) / len(xu)
            else:  # the negative part has gone below zero: climb back
                gp, gu = prior * sigmoid(fp) / len(xp), -sigmoid(fu) / len(xu)
            g = np.concatenate((gp, gu)).astype(np.float32)
            ga = np.outer(g, w[2]) * (h > 0)
            grads = [x.T @ ga + 1e-4 * w[0], ga.sum(axis=0), a.T @ g + 1e-4 * w[2], np.array([g.sum()], np.float32)]
            t += 1
            for i, gi in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gi
                v[i] = 0.999 * v[i] + 0.001 * gi * gi
                w[i] -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, w[0], w[1], w[2], float(w[3][0]), prior or 0.5)


#: Thresholds at which positives and unlabelled texts are compared, by quantiles of the positives' scores.
QUANTILES = np.linspace(0.0, 0.95, 96)


def estimate_prior(p: np.ndarray, cuts: np.ndarray, above: np.ndarray, total: int) -> float:
    """Share of positives among ``total`` unlabelled texts, ``above[i]`` of which score ``cuts[i]`` or more, as the ``p`` of
    held-back positives do.

    Above a threshold c the unlabelled texts hold prior * P(p >= c) positives and maybe others, so their ratio bounds the prior
    from above at every c; the least bound, with an allowance for chance, is the estimate.
    """
    best, slack = 1.0, (np.sqrt(1 / len(p)) + np.sqrt(1 / total)) * 0.5
    for c, n in zip(cuts, above, strict=True):
        qp = (p >= c).mean()
        if qp > 0.02:
            best = min(best, (n / total + slack) / qp)
    return float(np.clip(best, 0.05, 0.98))


def prior_over(docs: DataFrame, first: Model, p: np.ndarray) -> float:
    """``estimate_prior`` with every text of ``docs`` as unlabelled: the cluster counts, the driver receives one row of counts."""
    cuts = np.quantile(p, QUANTILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, above, total = Shapes(), np.zeros(len(cuts), np.int64), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                x = np.stack([shape(t) for t in batch.column(0).slice(at, 512).to_pylist()])
                margins = np.sort(first.margin(x))
                above += len(margins) - np.searchsorted(margins, cuts)
                total += len(margins)
        counts = np.append(above, total)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], names=["i", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(cuts) + 1, np.int64)
    for r in rows:
        counts[r["i"]] = r["n"]
    return estimate_prior(p, cuts, counts[:-1], max(1, int(counts[-1])))


def fit(p: np.ndarray, u: np.ndarray, docs: DataFrame) -> Model:
    """The model from features of trusted positives and of a sample of unlabelled texts, and the prior over all of ``docs``."""
    held = np.arange(len(p)) % 3 == 0
    first = _train(p[~held], u, None, epochs=15)
    return _train(p, u, prior_over(docs, first, first.margin(p[held])))


def shapes(docs: DataFrame) -> DataFrame:
    """``shape``: the features of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = Shapes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([shape(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float32()))], names=["shape"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "shape array<float>")


def _matrix(rows: DataFrame) -> np.ndarray:
    column = rows.toArrow().column("shape").combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float32).reshape(-1, Shapes.SIZE)


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Learns from good rows of ``labels`` (``doc_id``, ``quality``) whose crc32 remainder is not ``held_out``, and from
    ``docs`` without labels. Both are samples of about so many rows at most, and the driver receives their features; the class
    prior is over all of ``docs``. None: fewer than three positives, or no documents.

    The unlabelled sample goes by doc_id and text, and rows that agree in both count once, so rows without doc_id or with one
    doc_id are sampled like others. Null texts are empty, null labels teach nothing.
    """
    good = labels.where("quality = 1")
    p = _matrix(shapes(labelled_sample(docs, good, "quality", remainder(F.col("doc_id"), divisor) != held_out, positives)))
    if len(p) < 3:
        return None
    part = min(1.0, unlabelled / max(1, docs.count()))
    digest = F.xxhash64("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(share_of(digest) < part)
    u = _matrix(shapes(cut(rows.groupBy(digest.alias("digest")).agg(F.min("text").alias("text")))))
    return fit(p, u, docs) if len(u) else None


def with_score(docs: DataFrame, model: Model | None, name: str = "quality_score") -> DataFrame:
    """Adds column ``name``, the score (0 to 1) of the whole ``text`` of every row; a column of that name is replaced."""
    at = [c for c in docs.columns if c.lower() != name.lower()].index("text")

    def make():
        shape = Shapes()

        def work(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[pa.Array]]]:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = np.stack([shape(t) for t in part.column(at).to_pylist()])
                yield part, [pa.array(model.score(x).astype(np.float64) if model else np.full(len(x), 0.5))]

        return work

    return append_by_arrow(docs, {name: "double"}, make)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) of every row.

    A null text is empty; an empty text has the model's score for no features. Without a model every score is 0.5. Rows
    without doc_id and repeated rows each keep a row; other columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(rows, model, "score").select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
