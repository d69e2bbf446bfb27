"""What the two classifiers share: who may be learnt from, bounded samples, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal doc_id, modulo ``divisor``; null for a null doc_id."""
    return F.crc32(doc_id.cast("long").cast("string")) % divisor


def share_of(key: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) of a key."""
    return F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1 << 30)) / float(1 << 30)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int) -> DataFrame:
    """``doc_id``, ``text``, ``label`` of about ``most`` labelled documents (all, if there are fewer), one row per doc_id.

    Null doc_ids and null labels are left out; of several labels of one document the largest counts, of several texts the
    least. The result is a checkpoint.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_learn)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    part = min(1.0, most / max(1, rows.count()))
    rows = rows.where(share_of(F.col("doc_id")) < part).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # At most about ``most`` narrow rows, whatever the size of the input: small enough to broadcast.
    found = texts.join(F.broadcast(rows), "doc_id")
    return cut(found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label")))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
