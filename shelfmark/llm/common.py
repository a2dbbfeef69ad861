"""What the training-data operators share: words, fold rules, numbering of copies, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\f\r"

#: Rows that a side may have to be sent whole to every executor, and that a driver may hold.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; a null key counts as the text of no characters."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def uniform(*key: Column) -> Column:
    """A hash of the key in the open interval (0, 1)."""
    return (F.pmod(F.xxhash64(*key), F.lit(1 << 53)) + F.lit(0.5)) / F.lit(float(1 << 53))


def one_per_copy(df: DataFrame, count: str, copy: str, chunk: int = 65_536) -> DataFrame:
    """A row for each of ``count`` equal rows, numbered from 0 in ``copy``.

    Rows with more than ``chunk`` copies are first dealt out in chunks, so that no task makes all
    copies of one row and no array is longer than a chunk.
    """
    last = F.col(count) - 1
    dealt = df.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / chunk))))
    return dealt.withColumn(
        copy,
        F.explode(F.sequence(F.col("_chunk") * chunk, F.least(last, F.col("_chunk") * chunk + chunk - 1))),
    ).drop("_chunk")


def checked_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` hinted for broadcast if it is counted to have no more than ``rows`` rows, else as it is.

    ``df`` is to be materialised (a checkpoint), as counting reads it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with as many underscores before it as make it no column of the tables."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
