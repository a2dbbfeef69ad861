"""Bounded training samples of labelled documents, and calibration of scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of each label, at most, that a classifier is fitted on: those with the lowest hashes.
TRAIN_DOCS = 3_000


def training_documents(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, label, text) of up to ``limit`` labelled documents of each label, 0 and 1.

    ``learn`` says, over doc_id, which labels may be learned from; no others are read. A doc_id with several
    labels counts as its highest; null ids, labels and texts are left out. Documents that share a doc_id are all
    taken. The ids are chosen before texts are read, so no more than two times ``limit`` are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.filter(F.col("label") == k).orderBy(*by_hash).limit(limit) for k in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").select("doc_id", "label", "text")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def calibrated(scores: np.ndarray, labels: np.ndarray, share: float | None = None, rounds: int = 60) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * score + b) fits the labels: logistic regression by Newton steps.

    Labels are drawn a little towards the middle, which keeps ``a`` finite when the classes part cleanly.
    ``share``: the part of label 1 to calibrate for, if the sample has another.
    """
    ones = labels.sum()
    zeros = len(labels) - ones
    target = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    centre, scale = scores.mean(), scores.std() + 1e-9
    x = np.stack([(scores - centre) / scale, np.ones(len(scores))], 1)
    w = np.zeros(2)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w -= np.clip(np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * w), -4, 4)
    a = w[0] / scale
    b = w[1] - a * centre
    if share is not None and 0 < share < 1 and ones and zeros:
        b += np.log(share / (1 - share)) - np.log(ones / zeros)
    return float(a), float(b)
