"""Whitening of embeddings from exact integer cross-products, gathered by bit slices.

Entries become integers, floor(64 c) counted from an origin. A task takes some rows, shifts each dimension by its
least value, and packs each bit of a dimension across the rows into 64-bit words. The cross-product of two dimensions
is then the sum over pairs of their bit planes of the ones that both have, counted word by word and weighted by the
planes' powers of two: whole numbers, so that sums do not depend on how rows are dealt out. Sums of the tasks meet in
one aggregation by matrix entry. The driver holds the matrix, never rows; it centres it in whole numbers before the
eigenvectors are worked out.

Vectors that are null or hold null or non-finite entries are left out, and so are those with an entry of 2^34 or more
either side of zero (no exact sum is kept for them) and those whose length is not the most frequent one (of equally
frequent ones the longest). Repeated rows and null keys count like others. An empty table gives an empty result, as
do vectors of no entry. A component without variance (constant dimensions, one row) whitens to 0.0; the identity
error then says 1.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

SCALE = 64
#: What is added to scaled entries, so that usual ones are positive; sums are kept without it.
ORIGIN = 1_000_000
#: Entries from here on are not kept.
LARGEST = float(1 << 34)
#: Rows that are packed together.
PACKED = 4_096
#: An eigenvalue of less than this part of the greatest is one of rounding.
NO_VARIANCE = 1e-13
LONG = 1 << 63
#: The column of vectors as kept_vectors gives them.
VECTOR = "_vector"


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite and below LARGEST."""
    # NaN is greater than any number
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < LARGEST)), F.lit(False))


def kept_vectors(vectors: DataFrame, column: str = "embedding", keep: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """(VECTOR array<double>, kept columns) of the rows that count, and their dimensions; 0 if there are none."""
    found = vectors.select(vectors[column].cast("array<double>").alias(VECTOR), *[vectors[c] for c in keep]).filter(usable(F.col(VECTOR)))
    lengths = found.groupBy(F.size(VECTOR).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = lengths["size"] if lengths else 0
    return found.filter(F.size(VECTOR) == size), size


def fixed(lists: pa.Array, size: int) -> np.ndarray:
    """The scaled entries of vectors as whole numbers: a row for each vector."""
    return np.floor(SCALE * lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)).astype(np.int64)


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of non-negative numbers, a row for each dimension: words of 64 rows' bits, and the dimension and power of each plane."""
    bits = [int(v).bit_length() for v in values.max(axis=1)]
    dimension = np.repeat(np.arange(len(bits)), bits)
    power = np.concatenate([np.arange(b) for b in bits]).astype(np.int64) if bits else np.empty(0, np.int64)
    bytes_ = -(-values.shape[1] // 64) * 8
    planes = np.zeros((len(power), bytes_), np.uint8)
    for k, (d, b) in enumerate(zip(dimension, power)):
        packed = np.packbits(((values[d] >> b) & 1).astype(np.uint8))
        planes[k, : len(packed)] = packed
    return planes.view(np.uint64), dimension, power


def cross_products(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each dimension, and of each product of two, as Python's whole numbers."""
    count, size = rows.shape
    low = rows.min(axis=0)
    planes, dimension, power = bit_planes((rows - low).T)
    both = np.zeros((len(planes),) * 2, np.int64)
    for k in range(len(planes)):
        both[k, k:] = both[k:, k] = np.bitwise_count(planes[k] & planes[k:]).sum(axis=1, dtype=np.int64)
    small = len(power) == 0 or 2 * int(power.max()) + 2 + count.bit_length() + 2 * size.bit_length() < 62
    kind = np.int64 if small else object
    weight = np.array([1 << int(p) for p in power], kind)
    sums, products = np.zeros(size, object), np.zeros((size, size), object)
    if len(planes):
        present, first = np.unique(dimension, return_index=True)
        ones = np.diagonal(both).astype(kind)
        sums[present] = np.add.reduceat(ones * weight, first).astype(object)
        weighted = both.astype(kind) * weight[:, None] * weight[None, :]
        products[np.ix_(present, present)] = np.add.reduceat(np.add.reduceat(weighted, first, axis=0), first, axis=1).astype(object)
    low = low.astype(object)
    products = products + np.outer(low, sums) + np.outer(sums, low) + count * np.outer(low, low)
    return sums + count * low, products


@dataclass(frozen=True)
class Whitening:
    """What is known of a list of vectors: all that is needed to whiten any."""

    size: int
    n: int
    sums: tuple[int, ...]  # of entries without ORIGIN
    directions: np.ndarray  # a column for each component, of unit length
    eigenvalues: np.ndarray
    trace: float

    def scaled(self) -> np.ndarray:
        """The matrix that whitens centred rows."""
        greatest = self.eigenvalues.max(initial=0.0)
        lives = self.eigenvalues > max(greatest * NO_VARIANCE, 0.0)
        return np.where(lives, self.directions / np.sqrt(np.where(lives, self.eigenvalues, 1.0)), 0.0)

    def explained(self) -> list[float]:
        return [float(max(e, 0.0) / self.trace) if self.trace > 0 else 0.0 for e in self.eigenvalues]

    def deviations(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S of each entry as doubles, and the sum of its squares over each row, exact."""
        sums = np.array(self.sums, object)
        largest = self.n * int(np.abs(rows).max(initial=0)) + max(map(abs, self.sums), default=0)
        if largest < LONG // 2:
            exact = self.n * rows - sums.astype(np.int64)
            if len(self.sums) * int(np.abs(exact).max(initial=0)) ** 2 < LONG:
                return exact.astype(np.float64), (exact * exact).sum(axis=1)
            exact = exact.astype(object)
        else:
            exact = self.n * rows.astype(object) - sums
        return exact.astype(np.float64), (exact * exact).sum(axis=1)


def fit(vectors: DataFrame, size: int, components: int) -> Whitening:
    """The whitening of all rows of ``vectors`` (as kept_vectors gives them)."""
    upper = np.triu_indices(size)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, products = 0, np.zeros(size, object), np.zeros((size, size), object)
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                rows = fixed(batch.column(0).slice(at, PACKED), size)
                some, more = cross_products(rows)
                count, sums, products = count + len(rows), sums + some, products + more
        if count:
            whole = [Decimal(int(v)) for v in (count, *sums, *products[upper])]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(whole)), pa.int32()), pa.array(whole, pa.decimal128(38, 0))], names=["entry", "part"])

    parts = vectors.select(VECTOR).mapInArrow(gather, "entry int, part decimal(38,0)")
    # as many rows as the matrix has entries
    total = {r["entry"]: int(r["total"]) for r in parts.groupBy("entry").agg(F.sum("part").cast("decimal(38,0)").alias("total")).collect()}
    n = total.get(0, 0)
    if not n:
        return Whitening(size, 0, (0,) * size, np.zeros((size, 0)), np.zeros(0), 0.0)
    sums = [total[1 + k] for k in range(size)]
    centred = np.zeros((size, size))
    trace = 0
    for k, (a, b) in enumerate(zip(*upper)):
        whole = n * total[1 + size + k] - sums[a] * sums[b]
        centred[a, b] = centred[b, a] = whole / (n * n)  # of whole numbers: rounded once
        trace += whole if a == b else 0
    values, directions = np.linalg.eigh(centred)
    falling = np.argsort(-values, kind="stable")[:components]
    directions = directions[:, falling]
    signs = np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(directions.shape[1])])
    return Whitening(size, n, tuple(sums), directions * signs, values[falling], trace / (n * n))


def whiten(vectors: DataFrame, known: Whitening, keep: Sequence[str]) -> DataFrame:
    """The kept columns, ``deviation`` (null beyond a long) and ``whitened``, an entry for each component."""
    held = vectors.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        matrix, components = model.scaled(), len(model.eigenvalues)
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                rows = batch.slice(at, PACKED)
                centred, deviation = model.deviations(fixed(rows.column(0), model.size))
                whitened = (centred / model.n) @ matrix
                offsets = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * components)
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[1:],
                        pa.array([int(v) if v < LONG else None for v in deviation], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(whitened.ravel())),
                    ],
                    names=[*keep, "deviation", "whitened"],
                )

    added = [StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))]
    schema = StructType([*(vectors.schema[c] for c in keep), *added])
    return vectors.select(VECTOR, *keep).mapInArrow(run, schema)


def identity_error(vectors: DataFrame, known: Whitening) -> float:
    """The largest entry, either side of zero, of the covariance of the whitened rows less the identity; measured over all rows."""
    size = len(known.eigenvalues)
    if not known.n or not size:
        return 0.0
    held = vectors.sparkSession.sparkContext.broadcast(known)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        matrix, moments = model.scaled(), np.zeros((size + 1, size))
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                centred, _ = model.deviations(fixed(batch.column(0).slice(at, PACKED), model.size))
                whitened = (centred / model.n) @ matrix
                moments[0] += whitened.sum(axis=0)
                moments[1:] += whitened.T @ whitened
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(moments.size, dtype=np.int32)), pa.array(moments.ravel())], names=["entry", "part"])

    parts = vectors.select(VECTOR).mapInArrow(gather, "entry int, part double")
    moments = np.zeros((size + 1) * size)
    for r in parts.groupBy("entry").agg(F.sum("part").alias("total")).collect():
        moments[r["entry"]] = r["total"] / known.n
    moments = moments.reshape(size + 1, size)
    # the mean is one of rounding, as rows were centred before they were multiplied
    return float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(size)).max())

