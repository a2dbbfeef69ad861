"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

The model predicts a symbol from the one before it: its context vector, through a matrix, meets the
symbols' target vectors. Symbols are the most frequent tokens, and classes for all others: the last letter
and whether marks follow it. Within a class, tokens have add-half unigram probabilities. All corpus statistics
are of all training texts: token counts, counts of symbol pairs, sizes of classes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import words

#: Most frequent tokens that are symbols of their own, and those whose counts every task holds, at most.
SYMBOLS = 512
HELD = 200_000
#: The end of a text as a token; no word has a blank.
END = " "
CLASSES = 54
DIMENSIONS, NOISE, STEPS, RATE, DECAY = 24, 10, 400, 0.03, 1e-6

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MARKS = ".,;:!?"


def token_counts(texts: DataFrame) -> DataFrame:
    """(token, n) over all rows of ``texts`` (text), ends of texts included."""
    tokens = F.concat(words(F.translate(F.col("text"), _UPPER, _LOWER)), F.array(F.lit(END)))
    return texts.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def class_of(token: Column) -> Column:
    """A token's class: its last letter before any marks, 26 if that is no letter of a to z, and 27 more if there are marks."""
    core = F.rtrim(token, F.lit(_MARKS))
    letter = F.ascii(F.right(core, F.lit(1)))
    return (
        F.when(letter.between(97, 122), letter - 97).otherwise(26) + F.when(F.length(core) < F.length(token), 27).otherwise(0)
    ).cast("int")


def class_of_bytes(token: bytes) -> int:
    core = token.rstrip(b".,;:!?")
    last = core[-1] if core else 0
    return (last - 97 if 97 <= last <= 122 else 26) + 27 * (len(core) < len(token))


@dataclass
class Vocabulary:
    """``place`` of held tokens; by place, their count and symbol. Places below ``symbols`` are symbols themselves."""

    place: dict[bytes, int]
    count: np.ndarray
    symbol: np.ndarray
    symbols: int
    total: int
    distinct: int
    least: int

    @property
    def size(self) -> int:
        return self.symbols + CLASSES


def hold(counts: DataFrame, held: int = HELD, symbols: int = SYMBOLS) -> Vocabulary:
    """The most frequent tokens: all that are seen ``least`` times, the least number that keeps them within ``held``.

    The ``symbols`` most frequent ones are held in any case, also where so many tokens are equally frequent that the
    others are not.
    """
    steps = counts.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("low"), F.sum("n").alias("n")
    ).orderBy(F.desc("step")).collect()
    total, distinct = sum(r["n"] for r in steps), sum(r["k"] for r in steps)
    least, sum_ = (steps[0]["low"] + 1 if steps else 1), 0
    for r in steps:  # a few hundred, whatever the corpus
        sum_ += r["k"]
        if sum_ > held:
            break
        least = r["low"]
    first = counts.orderBy(F.desc("n"), "token").limit(symbols)
    rows = counts.filter(F.col("n") >= least).unionAll(first).distinct().toPandas().sort_values(["n", "token"], ascending=[False, True])
    tokens = [t.encode("utf-8", "surrogatepass") for t in rows["token"]]
    own = min(symbols, len(tokens))
    symbol = np.array([k if k < own else own + class_of_bytes(t) for k, t in enumerate(tokens)], np.int64)
    return Vocabulary({t: k for k, t in enumerate(tokens)}, rows["n"].to_numpy(np.int64), symbol, own, total, distinct, least)


def _symbols_of(text: bytes, v: Vocabulary) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(tokens, places or -1, symbols) of a text, its end included."""
    tokens = text.lower().split()
    tokens.append(b" ")
    get = v.place.get
    places = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
    symbols = v.symbol[places] if len(v.symbol) else np.zeros(len(tokens), np.int64)
    for k in np.flatnonzero(places < 0):
        symbols[k] = v.symbols + class_of_bytes(tokens[k])
    return tokens, places, symbols


def _end(v: Vocabulary) -> int:
    """The symbol of a text's end, which also stands before its first token."""
    place = v.place.get(b" ", -1)
    return int(v.symbol[place]) if place >= 0 else v.symbols + class_of_bytes(b" ")


def pair_counts(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each symbol follows each other, over all rows of ``texts`` (text)."""
    sent, size = texts.sparkSession.sparkContext.broadcast(vocabulary), vocabulary.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        pairs, end = np.zeros(size * size, np.int64), _end(v)
        for batch in batches:
            codes = []
            for text in batch.column(0).cast(pa.binary()):
                _, _, s = _symbols_of(text.as_py() or b"", v)
                codes.append(np.append(end, s[:-1]) * size + s)
            if codes:
                pairs += np.bincount(np.concatenate(codes), minlength=size * size)
        full = np.flatnonzero(pairs)
        for at in range(0, len(full), 100_000):
            part = full[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(pairs[part])], names=["pair", "n"])

    rows = texts.select("text").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size * size)
    out[rows["pair"]] = rows["n"]
    return out.reshape(size, size)


def train(pairs: np.ndarray, steps: int = STEPS, seed: int = 3) -> np.ndarray:
    """log10 probabilities, context by symbol, of a log-bilinear model of ``pairs``.

    Noise-contrastive estimation: pairs that occur are told from pairs with NOISE times as many symbols drawn from
    their unigram distribution. As all pairs are counted, the expectation over both is taken instead of draws.
    Adam steps on all parameters; at the end batched products give every context's normalised distribution.
    """
    size = len(pairs)
    n = pairs.sum() or 1.0
    unigram = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * size)
    draw = np.random.default_rng(seed)
    w = {
        "context": draw.normal(0, 0.1, (size, DIMENSIONS)), "matrix": np.eye(DIMENSIONS), "target": draw.normal(0, 0.1, (size, DIMENSIONS)),
        "bias": np.log(unigram),
    }
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    real, noise = pairs / n, NOISE * (pairs.sum(1, keepdims=True) / n) * unigram
    # contexts weigh by the square root of their count, so that rare ones are learned in as many steps
    level = 1 / np.sqrt(np.maximum(pairs.sum(1, keepdims=True) / n, 1e-6))
    real, noise = real * level, noise * level
    offset = np.log(NOISE * unigram)
    for step in range(1, steps + 1):
        predicted = w["context"] @ w["matrix"]
        delta = predicted @ w["target"].T + w["bias"] - offset
        chance = 1 / (1 + np.exp(-np.clip(delta, -40, 40)))
        g = noise * chance - real * (1 - chance)
        d_predicted = g @ w["target"]
        d = {"context": d_predicted @ w["matrix"].T, "matrix": w["context"].T @ d_predicted, "target": g.T @ predicted, "bias": g.sum(0)}
        rate = RATE * (1 - (step - 1) / steps)
        for k in w:
            d[k] = d[k] + DECAY * w[k] * (k != "bias")
            m[k] += 0.1 * (d[k] - m[k])
            v[k] += 0.01 * (d[k] ** 2 - v[k])
            w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-10)
    scores = w["context"] @ w["matrix"] @ w["target"].T + w["bias"]
    scores -= scores.max(1, keepdims=True)
    return (scores - np.log(np.exp(scores).sum(1, keepdims=True))) / np.log(10)


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    ``learn``, over doc_id, says which rows are learned from. Null texts are empty, with one token, their end. Equal
    rows are scored each; null doc_ids stay null; other columns are not read. Without training rows all tokens are unknown.

    Counts of the held tokens are known to every task; what a text has of others is joined with their counts.
    """
    spark = docs.sparkSession
    texts = docs.filter(learn).select(F.coalesce("text", F.lit("")).alias("text"))
    counts = cut_lineage(token_counts(texts))
    vocabulary = hold(counts)
    sizes = counts.withColumn("class", class_of(F.col("token"))).groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()
    class_n, class_k = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in sizes:
        class_n[r["class"]], class_k[r["class"]] = r["n"], r["k"]
    for token, place in vocabulary.place.items():  # symbols of their own are in no class
        if place < vocabulary.symbols:
            c = class_of_bytes(token)
            class_n[c] -= vocabulary.count[place]
            class_k[c] -= 1
    room = np.log10(class_n + 0.5 * (class_k + 1))
    whole = np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    log_count = np.log10(vocabulary.count + 0.5)
    inside = np.where(np.arange(len(log_count)) < vocabulary.symbols, 0.0, log_count - room[np.maximum(vocabulary.symbol - vocabulary.symbols, 0) % CLASSES])
    table = train(pair_counts(texts, vocabulary))
    sent = spark.sparkContext.broadcast((vocabulary, table, log_count - whole, inside))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text with what is known of it, and one for each different token of it that is not held."""
        v, logs, base, within = sent.value
        end = _end(v)
        for batch in batches:
            out: list[tuple] = []
            for row, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                tokens, places, s = _symbols_of(text.as_py() or b"", v)
                held = places[places >= 0]
                known = float(logs[np.append(end, s[:-1]), s].sum())
                out.append((row, doc_id, f" {row}", 0, len(tokens), len(held), float(base[held].sum()), known + float(within[held].sum())))
                rest = Counter(tokens[k] for k in np.flatnonzero(places < 0))
                out += [(row, None, t.decode("utf-8", "surrogatepass"), n, 0, 0, 0.0, 0.0) for t, n in rest.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)], names=_NAMES)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        measure, "row long, doc_id long, token string, times long, n_tokens long, n_known long, base double, score double"
    )
    rare = counts.filter(F.col("n") < vocabulary.least)
    joined = rows.join(rare, "token", "left")
    log_n = F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))
    rooms = F.element_at(F.array(*[F.lit(float(x)) for x in room]), class_of(F.col("token")) + 1)
    return joined.select(
        "row", "doc_id", "n_tokens",
        (F.col("n_known") + F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("times") * (log_n - F.lit(float(whole)))).alias("base"),
        (F.col("score") + F.col("times") * (log_n - rooms)).alias("score"),
    ).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"),
    ).drop("row")


_NAMES = ["row", "doc_id", "token", "times", "n_tokens", "n_known", "base", "score"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
