"""Quality classifier by gated attention over passages (multiple-instance learning).

A document is a bag of passages. Each passage is encoded from measures of its words and the shapes they
have; the attention learns from documents' labels which passages tell. A document is judged by its attention-weighted
passage representation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import calibrated, sigmoid, training_documents

PASSAGE = 48
SHAPES = 48
HIDDEN, ATTENTION = 16, 8
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.01, 1e-4

_SYMBOLS = set("#*$%&|<>{}[]@^~_=+\\/")
_RUN = re.compile(r"(.)\1+")
#: Measures of a word, in this order: characters, capitals, digits, symbols, !?, other marks, all capitals, bare mark.
MEASURES = 8
FEATURES = MEASURES + 4 + SHAPES


def _shape(word: str) -> int:
    """The number of a word's shape: kinds of characters, runs as one, marks as they are."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return xxhash.xxh32_intdigest(_RUN.sub(r"\1", kinds).encode("utf-8", "surrogatepass")) % SHAPES


class _Measured(dict):
    """Rows of a growing table by word."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[float]] = []
        self.shapes: list[int] = []

    def __missing__(self, word: str) -> int:
        letters = sum(c.isalpha() for c in word)
        capitals, digits = sum(c.isupper() for c in word), sum(c.isdigit() for c in word)
        symbols, calls = sum(c in _SYMBOLS for c in word), sum(c in "!?" for c in word)
        marks = len(word) - letters - digits - symbols - calls
        self.rows.append([len(word) / 10, capitals, digits, symbols, calls, marks, letters > 1 and capitals == letters, letters + digits == 0])
        self.shapes.append(_shape(word))
        self[word] = n = len(self)
        return n

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.rows, np.float32).reshape(-1, MEASURES), np.array(self.shapes, np.int64)

    def trim(self) -> None:
        if len(self) > 300_000:
            self.clear()
            self.rows.clear()
            self.shapes.clear()


def passages(texts: Sequence[str | None], measured: _Measured) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text); a text without words has one empty passage."""
    measured.trim()
    ids = []
    for text in texts:
        split = (text or "").split()
        ids.append(np.fromiter(map(measured.__getitem__, split), np.int64, len(split)))
    rows, shapes = measured.table()
    counts = np.array([max(1, -(-len(i) // PASSAGE)) for i in ids], np.int64)
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    begin = 0
    for words, n in zip(ids, counts):
        if len(words):
            at = np.arange(0, len(words), PASSAGE)
            size = np.diff(np.append(at, len(words)))[:, None]
            part = out[begin : begin + n]
            part[:, :MEASURES] = np.add.reduceat(rows[words], at) / size
            owner = np.arange(len(words)) // PASSAGE
            same = np.append(False, words[1:] == words[:-1])
            part[:, MEASURES] = np.bincount(owner, same, n) / size[:, 0]
            pairs = np.unique(owner * (len(rows) + 1) + words) // (len(rows) + 1)
            part[:, MEASURES + 1] = np.bincount(pairs, minlength=n) / size[:, 0]
            part[:, MEASURES + 2] = size[:, 0] / PASSAGE
            part[:, MEASURES + 3] = np.log1p(len(words)) / 10
            histogram = np.bincount(owner * SHAPES + shapes[words], minlength=n * SHAPES).reshape(n, SHAPES)
            part[:, MEASURES + 4 :] = histogram / size
        begin += n
    return out, counts


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    slope: float
    shift: float


def _forward(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
    """All values of one pass; ``attention`` sums to 1 over each document's passages."""
    starts = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(counts)), counts)
    h = np.tanh(x @ w["encode"] + w["encode0"])
    t, g = np.tanh(h @ w["tanh"]), sigmoid(h @ w["gate"])
    e = (t * g) @ w["attend"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    attention = e / np.add.reduceat(e, starts)[owner]
    bag = np.add.reduceat(h * attention[:, None], starts)
    return {"owner": owner, "starts": starts, "h": h, "t": t, "g": g, "attention": attention, "bag": bag, "z": bag @ w["judge"] + w["judge0"]}


def gradients(w: dict[str, np.ndarray], x: np.ndarray, counts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log-loss of documents' labels."""
    f = _forward(w, x, counts)
    dz = (sigmoid(f["z"]) - y) * weight / len(y)
    d_bag = dz[:, None] * w["judge"]
    own = d_bag[f["owner"]]
    d_attention = (own * f["h"]).sum(1)
    mean = np.add.reduceat(d_attention * f["attention"], f["starts"])[f["owner"]]
    de = f["attention"] * (d_attention - mean)
    dt = de[:, None] * w["attend"] * f["g"] * (1 - f["t"] ** 2)
    dg = de[:, None] * w["attend"] * f["t"] * f["g"] * (1 - f["g"])
    dh = own * f["attention"][:, None] + dt @ w["tanh"].T + dg @ w["gate"].T
    dx = dh * (1 - f["h"] ** 2)
    return {
        "encode": x.T @ dx, "encode0": dx.sum(0), "tanh": f["h"].T @ dt, "gate": f["h"].T @ dg,
        "attend": (f["t"] * f["g"]).T @ de, "judge": f["bag"].T @ dz, "judge0": dz.sum(keepdims=True),
    }


def initial(features: int, seed: int = 5) -> dict[str, np.ndarray]:
    draw = np.random.default_rng(seed)
    of = lambda *shape: draw.normal(0, shape[0] ** -0.5, shape)
    return {
        "encode": of(features, HIDDEN), "encode0": np.zeros(HIDDEN), "tanh": of(HIDDEN, ATTENTION), "gate": of(HIDDEN, ATTENTION),
        "attend": of(ATTENTION), "judge": of(HIDDEN), "judge0": np.zeros(1),
    }


def fit(x: np.ndarray, counts: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights by Adam steps over batches of documents, both labels weighing the same."""
    w = initial(x.shape[1], seed)
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    starts = np.cumsum(counts) - counts
    balance = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))
    draw, step = np.random.default_rng(seed), 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(y))
        for at in range(0, len(order), BATCH):
            batch, step = order[at : at + BATCH], step + 1
            n = counts[batch]
            first = np.cumsum(n) - n
            rows = np.repeat(starts[batch] - first, n) + np.arange(n.sum())
            for k, d in gradients(w, x[rows], n, y[batch], balance[y[batch]]).items():
                d = d + DECAY * w[k]
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                w[k] -= RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return w


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    measured = _Measured()
    for batch in batches:
        x, counts = passages(batch.column(2).to_pylist(), measured)
        rows, begin = [], 0
        for n in counts:
            rows.append(x[begin : begin + n].tobytes())
            begin += n
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], names=["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """A model of ``label``, learned from labels that ``learn`` allows, on a sample bounded by parameters.

    Without texts of both labels all scores are 0.5.
    """
    sample = training_documents(docs, labels, label, learn)
    share = labels.filter(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    rows = sample.mapInArrow(_encoded, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "label", "x"])
    y = rows["label"].to_numpy(np.int64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), initial(FEATURES), 0.0, 0.0)
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for b in rows["x"]]
    counts = np.array([len(b) for b in bags])
    x = np.concatenate(bags)
    centre, scale = x.mean(0), x.std(0) + 1e-3
    x = np.clip((x - centre) / scale, -8, 8)
    weights = fit(x, counts, y)
    z = _forward(weights, x, counts)["z"]
    return Model(centre, scale, weights, *calibrated(z, y, share))


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` and ``column``, the probability that the text is of label 1; a column of that name is replaced.

    All passages of whole texts are encoded. Null and empty texts have one passage without words. Nothing is
    shuffled; no column but the text is looked at.
    """
    others = docs.drop(column)
    place, sent = others.columns.index("text"), docs.sparkSession.sparkContext.broadcast(model)
    schema = others.select("*", F.lit(0.0).cast("double").alias(column)).schema

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, measured = sent.value, _Measured()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x, counts = passages(batch.column(place).to_pylist(), measured)
                z = _forward(m.weights, np.clip((x - m.centre) / m.scale, -8, 8), counts)["z"]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(m.slope * z + m.shift))], names=[*batch.schema.names, column])

    return others.mapInArrow(measure, schema)
