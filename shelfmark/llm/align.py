"""Alignment of two tokenizers' ids over the same bytes.

Both cut a text into tokens that cover its bytes; where tokens of both end together, a group of tokens ends, and its
last two tokens are linked. An array gives, for each id of the first vocabulary, the id of the second with the same
bytes. A group of one token each that the array foretells is exact: such links are counted in vectors as long as the
vocabulary, one a task. Only links of the other groups become (pair, count) rows that are shuffled.

Texts that are null or empty, and texts that the tokens of either side do not give back byte for byte, have no tokens
and no groups. Texts of any length are taken whole; repeated rows count each time; an empty table gives none. Columns
that are not kept cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..session import written
from .piece_codec import ChunkTable, PieceModel, int_lists, parts_of

#: How the byte-level vocabulary parts a text before merges.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A pair of ids is one number: the first shifted by this, and the second.
SHIFT = 24
#: Pairs that are sent to every task at once; more are taken in several rounds over the stored links.
PAIRS_AT_ONCE = 2_000_000


@dataclass(frozen=True)
class ByteModel:
    """A byte-level vocabulary whose ids are in the order of its merges: the bytes of each id."""

    tokens: tuple[bytes, ...]


def _byte_alphabet() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: printable ones as they are, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def read_byte_model(path: str) -> ByteModel:
    """The vocabulary of a byte-level file, read by the driver; special tokens are left out.

    Ids have to follow the order of merges, as the lowest pair of ranks is joined first; else ValueError.
    """
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    vocabulary, special = found["model"]["vocab"], {t["content"] for t in found["added_tokens"] if t["special"]}
    by_id = sorted((i, t) for t, i in vocabulary.items() if t not in special)
    made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in found["model"]["merges"]]
    if [i for i, _ in by_id] != list(range(len(by_id))) or [t for _, t in by_id[-len(made):]] != made:
        raise ValueError(f"{path}: ids are not in the order of merges")
    alphabet = _byte_alphabet()
    return ByteModel(tuple(bytes(alphabet[c] for c in t) for _, t in by_id))


def same_bytes(first: Sequence[bytes], second: Sequence[bytes]) -> np.ndarray:
    """For each id of ``first``, the id of ``second`` with the same bytes, the greatest of several; -1: none."""
    ids = {b: k for k, b in enumerate(second) if b}
    return np.array([ids.get(b, -1) for b in first], np.int64)


class Aligner:
    """Cuts texts by both vocabularies, and what the cuts have in common."""

    def __init__(self, first: ByteModel, second: PieceModel):
        import tiktoken

        ranks = {b: i for i, b in enumerate(first.tokens)}
        self.first = tiktoken.Encoding("first", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.second = ChunkTable(second)
        second_bytes = second.id_bytes()
        self.second_bytes = second_bytes
        self.lengths = np.array([len(b) for b in first.tokens]), np.array([len(b) for b in second_bytes])
        self.same = same_bytes(first.tokens, second_bytes)
        self.names = np.array([str(i) for i in range(max(map(len, self.lengths)))], object)
        self.exact_names = np.array([f"{a}|{b}" for a, b in enumerate(self.same)], object)

    def tokens(self, text: str | None, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of both sides, the second's given; none where either does not give the text back."""
        if text:
            a, whole = self.first.encode_to_numpy(" " + text).astype(np.int64), (" " + text).encode()
            if self.first.decode_bytes(a.tolist()) == whole and b"".join(map(self.second_bytes.__getitem__, b.tolist())) == whole:
                return a, b.astype(np.int64)
        return np.empty(0, np.int64), np.empty(0, np.int64)

    def align(self, texts: Sequence[str | None]) -> list[tuple[int, int, str, np.ndarray, np.ndarray]]:
        """For each text: its tokens of both sides, its groups as text, its exact links' first ids, its other links as pairs."""
        cut = [self.tokens(t, b) for t, b in zip(texts, self.second.ids(texts))]
        a, b = (np.concatenate([c[k] for c in cut]) for k in (0, 1))
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        at = np.searchsorted(ends_a, ends_b)  # texts end on both sides, so there is always such a place
        last_b = np.flatnonzero(ends_a[at] == ends_b) if len(a) else np.empty(0, np.int64)
        last_a = at[last_b]
        from_a, from_b = (np.concatenate([[0], last[:-1] + 1]).astype(np.int64)[: len(last)] for last in (last_a, last_b))
        link_a, link_b = a[last_a], b[last_b]
        exact = (from_a == last_a) & (from_b == last_b) & (self.same[link_a] == link_b)
        # lists, as slices of them are joined far faster than slices of arrays
        names, name_a, name_b = self.exact_names[link_a].tolist(), self.names[a].tolist(), self.names[b].tolist()
        others = np.flatnonzero(~exact)
        ranges = np.stack([others, from_a[others], last_a[others] + 1, from_b[others], last_b[others] + 1], axis=1).tolist()
        for k, a0, a1, b0, b1 in ranges:
            names[k] = ",".join(name_a[a0:a1]) + "|" + ",".join(name_b[b0:b1])
        pairs = (link_a << SHIFT) | link_b
        stops = np.searchsorted(last_a, np.cumsum([len(c[0]) for c in cut]))  # groups that end before a text does
        found, start = [], 0
        for (ids_a, ids_b), stop in zip(cut, stops.tolist()):
            mine = exact[start:stop]
            found.append((len(ids_a), len(ids_b), ";".join(names[start:stop]), link_a[start:stop][mine], pairs[start:stop][~mine]))
            start = stop
        return found


def align(docs: DataFrame, first: ByteModel, second: PieceModel, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns to keep and, of each whole text: n_a, n_b, groups, exact, other.

    ``groups`` is like ``a1,a2|b1;a3|b2,b3``: first and second ids of a group, in order. ``exact`` has the first id of each
    link of an exact group, ``other`` the pairs of the other links (first id, shifted by SHIFT, and second id).
    Nothing is shuffled.
    """
    models = docs.sparkSession.sparkContext.broadcast((first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*models.value)
        for batch in batches:
            for rows, texts in parts_of(batch, "text"):
                n_a, n_b, groups, exact, other = zip(*aligner.align(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[1:], pa.array(n_a, pa.int64()), pa.array(n_b, pa.int64()), pa.array(groups, pa.string()),
                        int_lists([e.astype(np.int32) for e in exact], pa.int32()), int_lists(other, pa.int64()),
                    ],
                    names=[*keep, "n_a", "n_b", "groups", "exact", "other"],
                )

    schema = StructType(
        [
            *(docs.schema[c] for c in keep), StructField("n_a", LongType()), StructField("n_b", LongType()), StructField("groups", StringType()),
            StructField("exact", ArrayType(IntegerType())), StructField("other", ArrayType(LongType())),
        ]
    )
    return docs.select(docs[text].alias("text"), *[docs[c] for c in keep]).mapInArrow(run, schema)


@dataclass(frozen=True)
class LinkCounts:
    """How often ids are linked over a whole corpus."""

    exact: np.ndarray  # links of exact groups by first id
    highest: np.ndarray  # the highest count of any pair by second id
    same: np.ndarray
    other: DataFrame  # (pair, links) of the other groups
    n_other: int


def exact_counts(aligned: DataFrame, size: int) -> np.ndarray:
    """The links of exact groups by first id: a vector in each task, whose entries are added up."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        ids = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(counts[ids])], names=["id", "links"])

    total = np.zeros(size, np.int64)
    # as many rows as the vocabulary has ids
    for r in aligned.select("exact").mapInArrow(gather, "id int, links long").groupBy("id").agg(F.sum("links").alias("links")).collect():
        total[r["id"]] = r["links"]
    return total


def count_links(aligned: DataFrame, first: ByteModel, second: PieceModel) -> LinkCounts:
    """Counts over all links of a stored table as ``align`` gives it (without ``groups``)."""
    second_bytes = second.id_bytes()
    same, exact = same_bytes(first.tokens, second_bytes), exact_counts(aligned, len(first.tokens))
    other = written(aligned.select(F.explode("other").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("links")), "pair_links")
    highest = np.zeros(len(second_bytes), np.int64)
    linked = np.flatnonzero(exact)
    np.maximum.at(highest, same[linked], exact[linked])
    of_second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    # as many rows as the second vocabulary has ids
    for r in other.groupBy(of_second.alias("id")).agg(F.max("links").alias("links")).collect():
        highest[r["id"]] = max(highest[r["id"]], r["links"])
    return LinkCounts(exact, highest, same, other, other.count())


def _scored(aligned: DataFrame, counts: LinkCounts, at_once: int) -> DataFrame:
    """``aligned`` with n_best and count_sum, a block of pairs after the other."""
    spark = aligned.sparkSession
    blocks = max(1, -(-counts.n_other // at_once))
    scored = aligned.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for block in range(blocks):
        some = counts.other.filter(F.pmod(F.xxhash64("pair"), F.lit(blocks)) == block).toArrow()
        pairs, links = (some.column(c).to_numpy() for c in ("pair", "links"))
        order = np.argsort(pairs)
        vectors = (counts.exact, counts.exact == counts.highest[counts.same]) if block == 0 else None
        pairs, links = pairs[order], links[order]
        best = links == counts.highest[pairs & ((1 << SHIFT) - 1)]
        scored = _score_block(spark, scored, pairs, links, best, vectors)
        if block < blocks - 1:
            scored = written(scored, "scored_links")
    return scored


def _score_block(spark: SparkSession, scored: DataFrame, pairs: np.ndarray, links: np.ndarray, best: np.ndarray, vectors) -> DataFrame:
    held = spark.sparkContext.broadcast((pairs, links, best, vectors))

    def sums(lists: pa.Array, values: np.ndarray) -> np.ndarray:
        """The sum of the values of each list's entries."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return total[ends[1:]] - total[ends[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, links, best, vectors = held.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            other, n_best, count_sum = columns["other"], columns["n_best"].to_numpy().copy(), columns["count_sum"].to_numpy().copy()
            if len(pairs):
                entries = other.flatten().to_numpy()
                at = np.minimum(np.searchsorted(pairs, entries), len(pairs) - 1)
                known = pairs[at] == entries
                n_best += sums(other, known & best[at])
                count_sum += sums(other, np.where(known, links[at], 0))
            if vectors is not None:
                ids = columns["exact"].flatten().to_numpy()
                n_best += sums(columns["exact"], vectors[1][ids])
                count_sum += sums(columns["exact"], vectors[0][ids])
            columns |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return scored.mapInArrow(run, scored.schema)


def score_links(aligned: DataFrame, counts: LinkCounts, at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """``aligned`` with n_groups, n_links, n_best and count_sum.

    ``n_best``: links whose pair is linked as often as any pair of its second id; ``count_sum``: the counts of a row's links.
    Pairs are sent to the tasks ``at_once`` at a time, so what is broadcast is bounded; with more, the stored links are
    read again for each block of pairs.
    """
    n_links: Column = (F.size("exact") + F.size("other")).cast("long")
    return _scored(aligned, counts, at_once).withColumns({"n_groups": n_links, "n_links": n_links})
