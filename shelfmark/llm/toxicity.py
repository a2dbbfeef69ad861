"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams, so misspellings that were never seen share most of their
vectors with words that were. A window of eight words averages their vectors, one that is shorter counts as filled up
with zeros, and a word that repeats at once counts once; both the vectors and the softmax over their averages are trained
together. A text is as toxic as its most toxic window.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import n_words, uniform
from .labelled import calibrated, sigmoid, training_documents

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
WINDOW = 8
DIMENSIONS = 8
#: Windows, about, that are fitted at most: a part of all that the sample has, by hash.
TRAIN_WINDOWS = 150_000
#: Buckets seen in fewer training windows than this stay at zero: they would learn single windows by heart.
LEAST_SEEN = 12
STEPS, BATCH, RATE, DECAY = 1_000, 1024, 0.15, 1e-4
#: Words whose values a task remembers; beyond it starts anew.
REMEMBERED = 250_000

_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’„…–—¡¿"


_K = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def subwords(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words' subwords, number of them for each word).

    A word's subwords are its character n-grams and it as a whole, in lower case, without marks around
    it, its edges marked. All words are hashed together, as one array of code points.
    """
    cores = [f"<{w.lower().strip(_EDGES)}>" for w in words]
    points = np.frombuffer("".join(cores).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sizes = np.array([len(c) for c in cores], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(cores)), sizes)
    left = sizes[owner] - (np.arange(len(points)) - starts[owner])  # characters up to the word's end
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), _K))
    whole = np.add.reduceat(points * powers[sizes[owner] - left], starts) if len(cores) else points
    owners, hashes = [np.arange(len(cores))], [_bucket(whole * _K + np.uint64(1))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * _K + points[at + k]
        owners.append(owner[at])
        hashes.append(_bucket(h))
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(hashes)[order], np.bincount(owners, minlength=len(cores))


@dataclass
class Model:
    """``value``: what each bucket adds to the log-odds of toxicity; ``slope``, ``shift``: the calibration."""

    value: np.ndarray
    bias: float
    slope: float
    shift: float


class _Scorer:
    """The log-odds of texts' most toxic windows."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias, self.known = value, bias, {}

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            flat, counts = subwords(part)
            values = np.add.reduceat(self.value[flat].astype(np.float64), np.cumsum(counts) - counts) / counts
            self.known.update(zip(part, values.tolist()))

    def hardest(self, texts: Iterable[str | None]) -> np.ndarray:
        """One number for each text; a text without words has one empty window."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        split = [(t or "").split() for t in texts]
        new = sorted(set().union(*split) - self.known.keys())
        if new:
            self._learn(new)
        out = np.full(len(split), self.bias)
        for n, words in enumerate(split):
            if words:
                words = [w for w, _ in groupby(words)]
                each = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
                out[n] += (np.add.reduceat(each, np.arange(0, len(each), WINDOW)) / WINDOW).max()
        return out


def _measured(batches: Iterator[pa.RecordBatch], place: int, scorer: _Scorer) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            yield batch, scorer.hardest(t.as_py() for t in batch.column(place))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            split = [w for w, _ in groupby(text.as_py().split())]
            rows += [(doc_id, label, at, " ".join(split[at : at + WINDOW])) for at in range(0, len(split), WINDOW)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.string()))], names=["doc_id", "label", "at", "words"]
            )


def fit(windows: Iterable[str], labels: np.ndarray, seed: int = 11) -> tuple[np.ndarray, float]:
    """(value of each bucket, bias), from windows (words parted by blanks) and their texts' labels.

    Vectors and softmax are trained jointly with AdaGrad steps over batches of windows.
    """
    vocabulary: dict[str, int] = {}
    flat_words, counts = array("i"), array("i")
    for words in windows:
        split = words.split()
        flat_words.extend(vocabulary.setdefault(w, len(vocabulary)) for w in split)
        counts.append(len(split))
    words, counts = np.frombuffer(flat_words, np.int32), np.frombuffer(counts, np.int32)
    first_word = np.cumsum(counts) - counts
    times, seen, known, parts = np.bincount(words, minlength=len(vocabulary)), np.zeros(BUCKETS), list(vocabulary), []
    del vocabulary
    for at in range(0, len(known), 20_000):
        grams, n = subwords(known[at : at + 20_000])
        seen += np.bincount(grams, np.repeat(times[at : at + len(n)], n), BUCKETS)
        parts.append((grams, n))
    flat, sizes = np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts])
    first_gram, learned = np.cumsum(sizes) - sizes, seen >= LEAST_SEEN

    def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """All places of runs that begin at ``starts``, one run after the other."""
        return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())

    draw = np.random.default_rng(seed)
    vectors = (draw.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)) * learned[:, None]).astype(np.float32)
    out, bias = draw.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    g_vectors, g_out, g_bias = np.full(BUCKETS, 1e-6), 1e-6, 1e-6
    balance = len(labels) / (2 * np.maximum(1, np.bincount(labels, minlength=2)))
    step = 0
    while step < STEPS:
        order = draw.permutation(len(counts))
        for at in range(0, len(order), BATCH):
            step += 1
            batch = order[at : at + BATCH]
            n = counts[batch]
            own, inverse = np.unique(words[runs(first_word[batch], n)], return_inverse=True)
            grams, share = flat[runs(first_gram[own], sizes[own])], sizes[own]
            word_starts, starts = np.cumsum(share) - share, np.cumsum(n) - n
            word = np.add.reduceat(vectors[grams], word_starts) / share[:, None]
            hidden = np.add.reduceat(word[inverse], starts) / WINDOW
            scores = hidden @ out + bias
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[batch]
            p[np.arange(len(batch)), y] -= 1
            p *= (balance[y] / len(batch))[:, None]
            d_out, d_bias = hidden.T @ p + DECAY * out, p.sum(0)
            each = np.repeat((p @ out.T) / WINDOW, n, axis=0)
            d_word = np.stack([np.bincount(inverse, each[:, k], len(own)) for k in range(DIMENSIONS)], 1) / share[:, None]
            spread = np.repeat(d_word, share, axis=0)
            d_vectors = np.stack([np.bincount(grams, spread[:, k], BUCKETS) for k in range(DIMENSIONS)], 1)
            touched = np.flatnonzero(learned & (d_vectors != 0).any(1))
            d = d_vectors[touched] + DECAY / len(order) * vectors[touched]
            g_vectors[touched] += (d**2).mean(1)
            g_out += (d_out**2).mean()
            g_bias += (d_bias**2).mean()
            vectors[touched] -= RATE * d / np.sqrt(g_vectors[touched])[:, None]
            out -= RATE * d_out / np.sqrt(g_out)
            bias -= RATE * d_bias / np.sqrt(g_bias)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", train_windows: int = TRAIN_WINDOWS) -> Model:
    """A model of ``label``, learned from labels that ``learn`` allows.

    Fits on a sample that is bounded by parameters: documents of each label, and windows of them. Without
    texts of both labels all scores are 0.5 or, with one label only, near it.
    """
    sample = cut_lineage(training_documents(docs, labels, label, learn))
    total = sample.agg(F.sum(F.ceil(n_words(F.col("text")) / WINDOW))).first()[0] or 0
    cut = sample.mapInArrow(_windows, "doc_id long, label int, at int, words string")
    rows = cut.filter(uniform(F.col("doc_id"), F.col("at")) * F.lit(float(max(1, total))) < train_windows).toPandas()
    rows = rows.sort_values(["doc_id", "at", "words", "label"])
    marks = rows["label"].to_numpy(np.int64)
    if len(np.unique(marks)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), 0.0, 0.0, 0.0)
    value, bias = fit(rows.pop("words"), marks)
    del rows
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(value)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, z in _measured(batches, 2, _Scorer(sent.value, bias)):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(z)], names=["label", "z"])

    measured = sample.mapInArrow(measure, "label int, z double").toPandas().sort_values(["z", "label"])
    slope, shift = calibrated(measured["z"].to_numpy(), measured["label"].to_numpy())
    return Model(value, bias, slope, shift)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and ``column``, the probability that the text is toxic; a column of that name is replaced.

    Whole texts are scored. Null and empty texts are scored as one empty window. Nothing is shuffled;
    no column but the text is looked at.
    """
    others = docs.drop(column)
    place, sent = others.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)
    schema = others.select("*", F.lit(0.0).cast("double").alias(column)).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch, z in _measured(batches, place, _Scorer(m.value, m.bias)):
            scores = pa.array(sigmoid(m.slope * z + m.shift))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return others.mapInArrow(measure, schema)
