"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles; two texts are linked if their sets' Jaccard similarity is 0.8 or
more. Equal texts are one class. Classes that share a band of MinHash values are brought together;
within such a neighbourhood each two of them are compared a few MinHash values at a time and dropped as soon as
it is improbable that they reach the threshold. The rest are verified on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, written
from .common import checked_broadcast, unused
from .components import components

SHINGLE_WORDS = 5
THRESHOLD = Fraction(4, 5)
#: Bands of rows: two sets at the threshold share no band with probability (1 - 0.8**5)**32, 3e-6.
BANDS, ROWS = 32, 5
#: MinHash values that are compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 32, 1e-6
#: Members of a neighbourhood that meet in one task, with as many others.
BLOCK = 128
#: Rows, at most, of a key list that is broadcast; longer ones are joined by a shuffle.
KEYS = 1_000_000

_K = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 16


class _Words(dict):
    """64-bit hashes by word."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, hashes: dict) -> np.ndarray:
    """A 64-bit hash of each run of five words; a text of fewer words is one shingle, one of none has none."""
    split = text.split()
    n = len(split)
    if not n:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(hashes.__getitem__, split), np.uint64, n)
    size = min(n, SHINGLE_WORDS)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = h * _K + ids[k : n - size + 1 + k]
    return _mixed(h)


@lru_cache
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20240607)
    a = draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    return a, draw.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row of BANDS * ROWS for each set; sets are not empty."""
    a, b = _permutations()
    out = np.empty((len(sets), len(a)), np.uint32)
    begin = 0
    while begin < len(sets):  # so many sets at a time that their hashes stay in the cache
        end, total = begin, 0
        while end < len(sets) and (end == begin or total + len(sets[end]) <= _CHUNK):
            total += len(sets[end])
            end += 1
        x = (np.concatenate(sets[begin:end]) >> np.uint64(32)).astype(np.uint32)
        at = np.cumsum([0, *[len(s) for s in sets[begin : end - 1]]])
        for k in range(len(a)):
            out[begin:end, k] = np.minimum.reduceat(x * a[k] + b[k], at)
        begin = end
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, other for each band number."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        h = _mixed(h * _K + parts[:, :, k])
    return h.view(np.int64)


@lru_cache
def least_matches(n: int, threshold: Fraction = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest of ``n`` equal MinHash values at which the threshold is not yet improbable.

    With a uniform prior, after m matches of n the similarity has the distribution Beta(m+1, n-m+1). It
    reaches t with the probability that of n + 1 draws with chance t no more than m succeed.
    """
    t, total = float(threshold), 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def _rows_of(texts: pa.Array) -> Iterator[bytes]:
    for text in texts.cast(pa.binary()):
        yield text.as_py() or b""


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, key, text) to (row, doc_id, key, bands); no bands for texts without words."""
    hashes = _Words()
    for batch in batches:
        sets = [shingles(t, hashes) for t in _rows_of(batch.column(3))]
        full = [n for n, s in enumerate(sets) if len(s)]
        offsets = np.zeros(len(sets) + 1, np.int32)
        offsets[1:][full] = BANDS
        keys = band_keys(minhashes([sets[n] for n in full])).ravel() if full else np.empty(0, np.int64)
        bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(keys))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], bands], names=["row", "doc_id", "key", "bands"])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, copies, label, blocks, block, text) with the text replaced by its MinHash values and its set."""
    hashes = _Words()
    for batch in batches:
        sets = [np.unique(shingles(t, hashes)) for t in _rows_of(batch.column(5))]
        if not sets:
            continue
        signatures = minhashes(sets)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:5], pa.array([s.tobytes() for s in signatures], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
            names=["cid", "copies", "label", "blocks", "block", "signature", "shingles"],
        )


def linked_pairs(signatures: np.ndarray, sets: list[np.ndarray], others: int) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those j linked to it) for pairs i < j; with ``others`` above 0, only for i < others <= j.

    Each step compares STEP more MinHash values of the j that are left and drops those with too few
    matches so far; the sets of what stays are intersected.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    known, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(known), bool)
    for i in range(others or n - 1):
        js = np.arange(others or i + 1, n)
        small, large = np.minimum(sizes[i], sizes[js]), np.maximum(sizes[i], sizes[js])
        js = js[small * THRESHOLD.denominator >= large * THRESHOLD.numerator]
        matches = np.zeros(len(js), np.int64)
        for at in range(0, signatures.shape[1], STEP):
            if not len(js):
                break
            end = min(at + STEP, signatures.shape[1])
            matches += np.count_nonzero(signatures[js, at:end] == signatures[i, at:end], axis=1)
            alive = matches >= least_matches(end)
            js, matches = js[alive], matches[alive]
        if not len(js):
            continue
        own = flat[starts[i] : starts[i + 1]]
        mark[own] = True
        common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j + 1]]]) for j in js])
        mark[own] = False
        union = sizes[i] + sizes[js] - common
        js = js[common * THRESHOLD.denominator >= union * THRESHOLD.numerator]
        if len(js):
            yield i, js


def _compared(group: pa.Table) -> pa.Table:
    """(cid, root, links, copies) of each class with links, from the members of one or two blocks.

    ``links`` counts the classes linked here, ``copies`` their documents; ``root`` is a class of the same component.
    """
    left, right = group.column("left")[0].as_py(), group.column("right")[0].as_py()
    group = group.sort_by([("block", "ascending" if left <= right else "descending"), ("cid", "ascending")])
    blocks = group.column("block").to_numpy()
    others = int((blocks == left).sum()) if left != right else 0
    cid, weight = group.column("cid").to_numpy(), group.column("copies").to_numpy()
    links, copies, label = np.zeros(len(cid), np.int64), np.zeros(len(cid), np.int64), np.arange(len(cid))
    if len(cid) > 1 and others < len(cid):
        signatures = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(cid), -1)
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        for i, js in linked_pairs(signatures, sets, others):
            links[i] += len(js)
            copies[i] += weight[js].sum()
            links[js] += 1
            copies[js] += weight[i]
            joined = np.unique(label[np.append(js, i)])
            if len(joined) > 1:
                label[np.isin(label, joined)] = joined[0]
    full = links > 0
    return pa.table({"cid": cid[full], "root": cid[label][full], "links": links[full], "copies": copies[full]})


def linked(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, links, text_links, first) for each row of ``docs``.

    ``class_id`` is the least doc_id that links lead to, over any number of steps. ``text_links`` counts the different
    texts linked to the row's, ``links`` all other rows linked to it, equal texts included. ``first`` is
    true for one row of each class, that of the least doc_id.

    Equal texts are one class, also empty ones. A text of under five words has one shingle, all its words; one
    without words is linked to equal texts only. A null text is linked to nothing, not even another.
    Repeated rows are equal texts. Null doc_ids come before others as ``first`` and leave a null
    class_id. Extra columns are not read.

    Copies are aggregated before they meet. A neighbourhood of any size is compared in blocks of BLOCK classes,
    two at a time; a task gives a row for each class, not for each pair.

    Rows are numbered once and written with their numbers, so that no later reading can number them otherwise.
    """
    return _linked(written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), "numbered")).drop("row")


def _linked(rows: DataFrame) -> DataFrame:
    """``linked`` for stored rows (row, doc_id, text), with their numbers."""
    keyed = rows.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary"))))
    banded = keyed.filter(F.col("text").isNotNull()).select("row", "doc_id", "key", "text").mapInArrow(
        _banded, "row long, doc_id long, key binary, bands array<long>"
    )
    classes = cut_lineage(
        banded.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "row")).alias("least"), F.first("bands").alias("bands"))
        .withColumn("cid", F.monotonically_increasing_id())
    )

    # neighbourhoods: classes that bands bring together, over any number of steps
    shared = classes.select("cid", F.explode("bands").alias("band"))
    buckets = shared.groupBy("band").agg(F.min("cid").alias("least"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    near = cut_lineage(components(shared.join(buckets, "band").select(F.col("cid").alias("a"), F.col("least").alias("b"))))
    sized = near.join(near.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "label")
    members = cut_lineage(
        sized.withColumnRenamed("node", "cid").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        .join(classes.select("cid", "key", "copies", F.col("least.row").alias("row")), "cid").drop("key")
    )

    # each member's set, from the class's least row; then every two blocks of a neighbourhood meet
    texts = rows.join(checked_broadcast(members, KEYS), "row")
    signed = texts.select("cid", "copies", "label", "blocks", "block", "text").mapInArrow(
        _signed, "cid long, copies long, label long, blocks int, block int, signature binary, shingles binary"
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meeting = signed.withColumn("_other", other).withColumns({"left": F.least("block", "_other"), "right": F.greatest("block", "_other")})
    found = cut_lineage(
        meeting.select("cid", "copies", "label", "block", "left", "right", "signature", "shingles").groupBy("label", "left", "right")
        .applyInArrow(_compared, "cid long, root long, links long, copies long")
    )

    counts = found.groupBy("cid").agg(F.sum("links").alias("text_links"), F.sum("copies").alias("linked"))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "cid")
    placed = classes.select("cid", "key", "copies", "least").join(counts, "cid", "left").join(roots, "cid", "left")
    placed = cut_lineage(placed.withColumn("label", F.coalesce("label", "cid")).drop("cid"))
    firsts = placed.groupBy("label").agg(F.min("least").alias("first"))
    placed = placed.join(firsts, "label").select("key", "copies", "text_links", "linked", "first")
    return keyed.select("row", "doc_id", "key").join(placed, "key", "left").select(
        "row", "doc_id",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        (F.coalesce("linked", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("links"),
        F.coalesce("text_links", F.lit(0)).alias("text_links"),
        F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("first"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the first of their class (see ``linked``), with all their columns."""
    row = unused("row", docs)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = _linked(numbered.select(F.col(row).alias("row"), "doc_id", "text"))
    gone = cut_lineage(found.filter(~F.col("first")).select(F.col("row").alias(row)))
    return numbered.join(checked_broadcast(gone, KEYS), row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
