"""Keyed building blocks that hold up when one key owns a third of the rows.

Latest-per-key and top-1 are aggregates (partial on the map side) rather than windows; top-k
uses a rank filter, which Spark prunes to k rows per key before the shuffle; lists come in
parts of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST_PART = 1_000


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: ``columns`` of the row with the largest ``order`` tuple."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key: ``columns`` of the row with the smallest ``order`` tuple."""
    best = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """At most ``k`` rows per key in ``order``; the order must end in a unique column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def leader_gap(df: DataFrame, keys: list[str], score: str, tiebreak: list[Column]) -> DataFrame:
    """Per key the best and second score and their gap, from two rows per key."""
    top = top_per_key(df, keys, [F.desc(score), *tiebreak], 2)
    best = F.max(F.when(F.col("rank") == 1, F.col(score)))
    second = F.max(F.when(F.col("rank") == 2, F.col(score)))
    return top.groupBy(*keys).agg(
        best.alias("leader"), second.alias("runner_up"), F.round(best - second, 4).alias("gap")
    )


def distinct_values(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Sorted distinct values per key; duplicates go before anything is collected."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.lit(1))
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list(value)).alias(out))
    )


def list_in_parts(df: DataFrame, key: str, value: str, out: str, part_size: int = LIST_PART) -> DataFrame:
    """All values per key as sorted lists (``key``, ``part``, ``out``) of ``part_size`` values, the last one shorter.

    Keys of any number of values have the same form; no list is longer than a part and nothing is dropped.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(value)) - 1
    return (
        df.filter(F.col(value).isNotNull()).withColumn("part", F.floor(place / part_size).cast("int"))
        .groupBy(key, "part").agg(F.sort_array(F.collect_list(value)).alias(out))
    )


def runs(df: DataFrame, keys: list[str], number: str) -> DataFrame:
    """Gaps and islands: (keys, first, last) of every run of consecutive distinct numbers."""
    distinct = df.filter(F.col(number).isNotNull()).select(*keys, number).distinct()
    island = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return (
        distinct.withColumn("_island", island)
        .groupBy(*keys, "_island")
        .agg(F.min(number).alias("first"), F.max(number).alias("last"))
        .drop("_island")
    )


def ordered_distinct(df: DataFrame, keys: list[str], value_key: str, order: list[Column], columns: list[str]) -> DataFrame:
    """First row per (keys, value_key) in ``order``, so that later repeats vanish."""
    return first_per_key(df, [*keys, value_key], order, columns)
