"""Sharding by rendezvous hashing: each record goes to the shard with its highest weighted score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import one_per_copy, uniform

#: Slots are numbered within this many cells at most, over all shards.
CELLS = 65_536


def shard_of(key: Sequence[Column], weights: Sequence[float]) -> Column:
    """The shard whose score weight / -ln(hash(key, shard)) is highest.

    A shard's score depends on the key and the shard alone. A shard that is added takes just the
    records for which it scores highest; one that is removed gives away just its own.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive, one for each shard")
    shards = F.array(*[F.struct(F.lit(i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    scores = F.transform(
        shards, lambda s: F.struct((s["weight"] / -F.ln(uniform(*key, s["shard"]))).alias("score"), s["shard"].alias("shard"))
    )
    return F.array_max(scores)["shard"]


def assign_shards(df: DataFrame, key: Sequence[str], weights: Sequence[float], column: str = "shard") -> DataFrame:
    """``df`` with the shard of each row. Nothing is shuffled.

    Rows of one key share a shard, also those whose key is null. A column named ``column`` is
    replaced; other columns stay.
    """
    return df.withColumn(column, shard_of([F.col(f"`{k}`") for k in key], weights))


def number_slots(df: DataFrame, shard: str, n_shards: int, slot: str = "slot") -> DataFrame:
    """Rows of ``df`` with gapless numbers from 0 within each shard.

    The order follows a hash of the whole row, ties its values; equal rows get numbers next to
    each other. They are counted before the shuffle and dealt out again after it, and a shard is
    numbered in many cells whose counts are added up, so no task holds a shard or a hot key.
    """
    columns = df.columns
    cells = max(1, CELLS // n_shards)
    counted = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    counted = cut_lineage(counted.withColumn("_cell", F.pmod(F.xxhash64(*columns), F.lit(cells)).cast("int")))
    ahead = W.partitionBy(shard).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        counted.groupBy(shard, "_cell").agg(F.sum("_n").alias("_n"))
        .select(shard, "_cell", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    )
    inside = W.partitionBy(shard, "_cell").orderBy(*columns).rowsBetween(W.unboundedPreceding, -1)
    placed = (
        counted.withColumn("_before", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
        .join(F.broadcast(starts), [shard, "_cell"])  # no more than CELLS rows
    )
    return one_per_copy(placed, "_n", "_copy").select(
        *columns, (F.col("_start") + F.col("_before") + F.col("_copy")).cast("long").alias(slot)
    )
