"""Text search: distinct texts, character grams, routed and multi-field search."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, like_literal
from ..session import shared_folder, written

GRAM = 3
#: Bits of a character's number; those of a gram fit a long.
_BITS = 21
#: Grams of texts from which a block's lists are made.
LISTED = 2_000_000
#: Found texts, as keys, that are sent to all tasks; more are joined.
SENT = 1_000_000


def distinct_texts(*sources: tuple[str, DataFrame]) -> DataFrame:
    """One row per distinct text of (label, table with ``text``), with how often each source holds it."""
    both = reduce(DataFrame.unionByName, [d.select(F.lit(label).alias("_source"), "text") for label, d in sources])
    counts = [F.count(F.when(F.col("_source") == label, 1)).alias(f"n_{label}") for label, _ in sources]
    return both.filter(F.col("text").isNotNull()).groupBy("text").agg(*counts).withColumn("text_id", F.md5(F.col("text").cast("binary")))


def _codes(text: bytes) -> np.ndarray:
    """The distinct grams of a text as sorted numbers, ``_BITS`` a character, A-Z in lower case."""
    points = np.frombuffer(text.lower().decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.int64)
    count = max(len(points) - GRAM + 1, 0)
    codes = np.zeros(count, np.int64)
    for k in range(GRAM):
        codes = (codes << _BITS) | points[k : k + count]
    return np.unique(codes)


def _strings(codes: np.ndarray) -> list[str]:
    points = np.stack([(codes >> _BITS * k) & ((1 << _BITS) - 1) for k in reversed(range(GRAM))], axis=1)
    joined = points.astype("<u4").tobytes().decode("utf-32-le")
    return [joined[i : i + GRAM] for i in range(0, len(joined), GRAM)]


def _inverted(keys: pa.Array, codes: list[np.ndarray]) -> pa.RecordBatch:
    """(gram, keys of the texts that have it) of a few texts."""
    every = np.concatenate(codes)
    order = np.argsort(every, kind="stable")
    every, who = every[order], np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
    starts = np.flatnonzero(np.diff(every, prepend=-1))
    offsets = pa.array(np.append(starts, len(every)), pa.int32())
    lists = pa.ListArray.from_arrays(offsets, keys.take(pa.array(who)))
    return pa.RecordBatch.from_arrays([pa.array(_strings(every[starts]), pa.string()), lists], ["gram", "keys"])


def _gram_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, first, codes, size = batch.column(0), 0, [], 0
        for place, text in enumerate(batch.column(1), 1):
            codes.append(_codes(text.as_py()))
            size += len(codes[-1])
            if size and (size >= LISTED or place == batch.num_rows):
                yield _inverted(keys.slice(first, place - first), codes)
                first, codes, size = place, [], 0


def gram_lists(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(gram, keys): the texts that have a gram, A-Z in lower case, as lists of a block of texts each; a text is in one list of each of its grams.

    A gram is in as many rows as there are blocks that have it, and no list is longer than a block.
    """
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.col(text).cast("binary").alias("_text"))
    # dealt by key, as a file of few row groups is else cut by as few tasks
    return rows.repartition(key).mapInArrow(_gram_lists, f"gram string, keys array<{texts.schema[key].dataType.simpleString()}>")


def postings(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(gram, key) of every text."""
    return gram_lists(texts, key, text).select("gram", F.explode("keys").alias(key))


def ascii_lowered(term: str) -> str:
    """A term as the texts are compared: A-Z in lower case, other letters as they are."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in term)


def holds_all(text: Column, terms: list[str]) -> Column:
    """Whether a text holds all terms, ASCII case aside; a text holds no terms at all in any case, unless it is null."""
    return reduce(lambda a, b: a & b, [like_literal(text, t) for t in terms], text.isNotNull())


def term_grams(terms: list[str]) -> list[str]:
    """The distinct grams of all terms; none where a term has too few characters, as then grams find nothing."""
    if not terms or min(map(len, terms)) < GRAM:
        return []
    return sorted({ascii_lowered(t)[i : i + GRAM] for t in terms for i in range(len(t) - GRAM + 1)})


def search(texts: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """Texts that hold all terms, ASCII case aside, by a scan; all that are not null for no terms."""
    return texts.filter(holds_all(F.col(text), terms))


@dataclass(frozen=True)
class Postings:
    """Stored postings: (bucket, gram, keys), a folder for each bucket of grams, ordered by gram inside."""

    path: str
    key: str
    buckets: int

    def hits(self, spark: SparkSession, wanted: list[str]) -> DataFrame:
        """(key, _n) of texts that have all the ``_n`` grams; only the buckets of these are read, and in them only their rows."""
        stored = spark.read.parquet(self.path)
        asked = spark.createDataFrame([(g,) for g in wanted], "gram string").select(gram_bucket(F.col("gram"), self.buckets)).distinct()
        numbers = [r[0] for r in asked.collect()]  # as many as the terms have grams
        rows = stored.filter(F.col("bucket").isin(numbers) & F.col("gram").isin(wanted)).select(F.explode("keys").alias(self.key))
        return rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(wanted))

    def search(self, texts: DataFrame, terms: list[str], text: str = "text") -> DataFrame:
        """What ``search`` gives, by grams where all terms have enough characters: their texts are found and then verified."""
        wanted = term_grams(terms)
        if not wanted:
            return search(texts, self.key, terms, text)
        hits = written(self.hits(texts.sparkSession, wanted), "hits")
        found = texts.join(F.broadcast(hits) if hits.count() <= SENT else hits, self.key)
        # asked of both sides, as Spark would else verify all texts ahead of the join
        return found.filter(F.when(F.col("_n") > 0, holds_all(F.col(text), terms))).select(*texts.columns)


def gram_bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def store_postings(texts: DataFrame, key: str, text: str = "text", buckets: int = 64) -> Postings:
    """Cut all texts into grams once and store these; each key is one text's.

    A gram that a third of all texts have is in one bucket, but its lists are dealt to files by their keys as well.
    """
    path = f"{shared_folder(texts.sparkSession)}/postings/{uuid.uuid4().hex}"
    rows = gram_lists(texts, key, text).withColumn("bucket", gram_bucket(F.col("gram"), buckets))
    spread = rows.repartition("bucket", F.pmod(F.xxhash64("keys"), F.lit(4)))
    spread.sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(path)
    return Postings(path, key, buckets)


def any_field(targets: DataFrame, key: str, hits: list[DataFrame]) -> DataFrame:
    """Targets whose key is among any of the hits (each a table with that key): a union, not an OR of lookups."""
    found = reduce(DataFrame.unionByName, [h.select(key) for h in hits]).distinct()
    return targets.join(found, key, "left_semi")


#: The parts of a resource's stored listing that are searched: its title, lists of names, and names and paths of files.
SNAPSHOT = (
    "share_snapshot struct<status string, share_title string, names array<string>, search_names array<string>, root_names array<string>, "
    "files array<struct<name string, path string>>>, extra string"
)


def snapshot_texts(metadata: Column) -> Column:
    """The searchable texts of a resource's metadata (JSON): its remark, and the listing where that was read without error.

    Other keys and deeper paths are not searched. What is no JSON, or not of this shape, has no texts.
    """
    none = F.array().cast("array<string>")

    def of(m: Column) -> Column:
        s = m["share_snapshot"]
        lists = [F.coalesce(s[n], none) for n in ("names", "search_names", "root_names")]
        files = F.flatten(F.transform(F.coalesce(s["files"], F.array().cast("array<struct<name:string,path:string>>")), lambda f: F.array(f["name"], f["path"])))
        listed = F.when(s["status"] == "ok", F.concat(F.array(s["share_title"]), *lists, files)).otherwise(none)
        return F.filter(F.concat(F.array(m["extra"]), F.coalesce(listed, none)), lambda t: t.isNotNull())

    return F.coalesce(let(F.from_json(metadata, SNAPSHOT), of), none)


def snapshot_holds(metadata: Column, term: str) -> Column:
    """Whether any searchable text of the metadata holds the term, ASCII case aside."""
    return F.exists(snapshot_texts(metadata), lambda t: like_literal(t, term))
