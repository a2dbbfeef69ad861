"""Mixing sources to target weights: Sainte-Lague apportionment of words, or of blocks of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import checked_broadcast, n_words, one_per_copy, unused

#: Words of a block. Where the least target is of fewer than BLOCKS_EACH such blocks, blocks are smaller, down to one word.
BLOCK_WORDS, BLOCKS_EACH = 64, 64
SHARD_WORDS = 1 << 18
MAX_SHARDS = 1 << 16
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MAX_REPEATS, SEED = 1.5, 2, 7


def _level(df: DataFrame, group: Sequence[str], weight: str, most: str, total: str, out: str) -> DataFrame:
    """``df`` with the level at which the lower of ``most`` and level times weight adds up to ``total`` in each group; 0 for no total."""
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    order = [F.col(most) / F.col(weight), *[F.col(c) for c in df.columns if c not in (*group, weight, most, total)]]
    before = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    left = F.col(total) - F.coalesce(F.sum(most).over(before), F.lit(0))
    levels = df.withColumn("_each", left / (F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0))))
    levels = levels.withColumn("_place", F.row_number().over(whole.orderBy(*order)))
    # the first party in this order that the level leaves under its most sets the level of all after it
    free = F.when(F.col(most) > F.col("_each") * F.col(weight), F.struct("_place", F.col("_each").alias("level")))
    found = F.coalesce(F.min(free).over(whole)["level"], F.max(F.col(most) / F.col(weight)).over(whole))
    return levels.withColumn(out, F.greatest(found, F.lit(0.0))).drop("_each", "_place")


def sainte_lague(df: DataFrame, party: Sequence[str], group: Sequence[str], weight: str, seats: str, quota: str, most: str | None = None) -> DataFrame:
    """``df`` (a row for each party of each group) with the seats that highest quotients give it, and ``next_seat``.

    Seat k of a party has the quotient weight / (2k + 1); a group's ``seats`` highest win, ties by ``party``. With
    ``most`` a party that has so many seats is out, and its further quotients do not count. ``next_seat`` is true for the
    party that the seat after the last would go to. Parties without weight get none and no row.

    A level that is surely too low gives each party seats it holds in any case, one that is surely high enough the last
    it can get; only those in between are ranked, about two for each party on the whole, however many seats there are.
    """
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    best = whole.orderBy(F.desc("_quotient"), *party)
    columns = df.columns
    cap = F.lit(1 << 53) if most is None else F.col(most)
    slim = df.filter(F.col(weight) > 0).select(*party, *group, F.col(weight).cast("double").alias("_weight"), cap.cast("long").alias("_most"), F.col(seats).cast("long").alias("_seats"))
    slim = slim.withColumn("_n", F.count(F.lit(1)).over(whole)).withColumn("_room", F.sum(F.col("_most").cast("double")).over(whole))
    slim = slim.withColumn("_seats", F.least(F.col("_seats"), F.col("_room").cast("long")))
    slim = slim.withColumn("_low", F.greatest(F.lit(0.0), F.col("_seats") - F.col("_n") / 2)).withColumn("_high", F.least(F.col("_room"), F.col("_seats") + 1 + F.col("_n") / 2))
    keys = [*party, *group]
    slim = _level(slim.select(*keys, "_weight", "_most", "_seats", "_low", "_high"), group, "_weight", "_most", "_low", "_under")
    slim = _level(slim.select(*keys, "_weight", "_most", "_seats", "_under", "_high"), group, "_weight", "_most", "_high", "_over")
    held = F.greatest(F.lit(0), F.least("_most", F.floor(F.col("_under") * F.col("_weight") * (1 - 1e-12) + 0.5 - 1e-9)))
    last = F.least(F.col("_most"), F.floor(F.col("_over") * F.col("_weight") * (1 + 1e-12) + 0.5 + 1e-9) + 1)
    ranked = (
        slim.withColumn("_safe", held.cast("long")).withColumn("_end", last.cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_safe").over(whole))
        .withColumn("_seat", F.explode_outer(F.when(F.col("_end") > F.col("_safe"), F.sequence(F.col("_safe"), F.col("_end") - 1))))
        .withColumn("_quotient", F.col("_weight") / (2 * F.col("_seat") + 1))
        .withColumn("_rank", F.when(F.col("_seat").isNotNull(), F.row_number().over(best)))
    )
    won = ranked.groupBy(*keys, "_safe").agg(
        F.count(F.when(F.col("_rank") <= F.col("_left"), 1)).alias("_won"), F.coalesce(F.bool_or(F.col("_rank") == F.col("_left") + 1), F.lit(False)).alias("next_seat")
    ).select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("_safe") + F.col("_won")).alias(quota), "next_seat")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(won, same).select(*columns, quota, "next_seat")


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: the sizes' ``share``, split by weight.

    Weights go round by the sources' code points, null last. Targets stop at ``most`` times their
    source's size; what is above goes to the others by weight, until none is above: all targets are
    the lower of that cap and a common level times the weight. The table has a row for each
    source, the only one here that is ordered as a whole.
    """
    everything = W.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").asc_nulls_last())
    weighed = (
        sources.withColumn("_i", (F.row_number().over(by_name) - 1).cast("int"))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_i", F.lit(len(weights))) + 1))
        .withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    )
    by_room = everything.orderBy(F.col("_cap") / F.col("weight"), "_i").rowsBetween(W.unboundedPreceding, -1)
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(by_room), F.lit(0.0))
    levels = weighed.withColumn("_level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(by_room), F.lit(0.0))))
    # the first source in this order that the level leaves under its cap sets the level of all after it
    free = F.when(F.col("_cap") > F.col("_level") * F.col("weight"), F.struct(F.col("_cap") / F.col("weight"), "_i", "_level"))
    return levels.withColumn("_level", F.min(free).over(everything)["_level"]).select(
        "source", "source_size", "weight",
        F.coalesce(F.least("_cap", F.col("_level") * F.col("weight")), "_cap").alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MAX_REPEATS,
    seed: int = SEED,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(source, doc_id, size, source_size, target, taken) for each row of documents.

    Sizes are words; null and empty texts have none and are taken 0 words of. All words that are to be taken are cut into
    blocks of one size, ``block_words`` or fewer (see BLOCKS_EACH), and these go to the sources by highest quotients of
    their targets. A source that has all its words ``most`` times is out; its last block may be a part of one. What is
    left over of the last block goes to the source that the next one would go to.

    A source's documents are dealt to shards of about ``shard_words`` words (65,536 shards at most, so that both a shard
    and a source's list of shards stay small), and its blocks go to them in the same way, by their sizes. A shard lays its
    documents end to end in an order that the seed decides, ``most`` times over; its quota is that many first blocks of
    it, so that few documents are taken in part, and ``taken`` is what they cover of a document. Equal rows (source, doc_id,
    size) are counted before they meet in a task and told apart at the end. Null sources are a source, null doc_ids a
    key. The tables of sources are ordered as a whole, those of documents by shard.
    """
    slim = docs.select("source", "doc_id", n_words(F.col("text")).alias("size"))
    slim = cut_lineage(slim.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = source_targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most)
    everything = W.partitionBy(F.lit(0))
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    sources = cut_lineage(
        sources.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(least / BLOCKS_EACH))).cast("long"))
        .withColumn("_all", F.floor(F.sum("target").over(everything) + 1e-6).cast("long"))
        .withColumn("_most", F.ceil(F.lit(most) * F.col("source_size") / F.col("block")).cast("long"))
        .withColumn("_seats", F.floor(F.col("_all") / F.col("block")).cast("long"))
        .withColumn("source_no", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())))
    )
    seated = sainte_lague(sources, ["source_no"], [], "target", "_seats", "blocks", "_most")
    words = F.least(F.lit(most) * F.col("source_size"), F.col("blocks") * F.col("block") + F.when(F.col("next_seat"), F.col("_all") % F.col("block")).otherwise(0))
    seated = seated.select("source_no", words.alias("words"))
    shards = F.least(F.lit(MAX_SHARDS), F.ceil(F.col("source_size") / shard_words)).cast("int")
    sources = cut_lineage(
        sources.join(seated, "source_no", "left")
        .select("source", "source_no", "source_size", "target", "block", F.coalesce("words", F.lit(0)).cast("long").alias("words"), F.greatest(shards, F.lit(1)).alias("shards"))
    )
    known = checked_broadcast(sources.withColumnRenamed("source", "_source"))
    dealt = slim.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source").withColumn(
        "cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("shards")).cast("int")
    )
    cell = W.partitionBy("source_no", "cell")
    laid = dealt.withColumn("_order", F.xxhash64(F.lit(seed + 1), "doc_id", "size")).withColumn(
        "_start",
        F.coalesce(F.sum(F.col("size") * F.col("n")).over(cell.orderBy("_order", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    )
    cells = dealt.groupBy("source_no", "cell", "block", "words").agg(F.sum(F.col("size") * F.col("n")).alias("cell_size"))
    cells = cells.withColumn("_seats", F.floor(F.col("words") / F.col("block")).cast("long")).withColumn("_most", F.ceil(F.lit(most) * F.col("cell_size") / F.col("block")).cast("long"))
    quotas = sainte_lague(cells, ["cell"], ["source_no"], "cell_size", "_seats", "quota", "_most")
    quota = F.least(F.lit(most) * F.col("cell_size"), F.col("quota") * F.col("block") + F.when(F.col("next_seat"), F.col("words") % F.col("block")).otherwise(0))
    quotas = quotas.select("source_no", "cell", "cell_size", quota.cast("long").alias("_words"))
    joined = one_per_copy(laid.join(quotas, ["source_no", "cell"], "left"), "n", "_copy")
    at = F.col("_start") + F.col("_copy") * F.col("size")
    passes = [
        F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce("_words", F.lit(0)) - at - F.lit(k) * F.coalesce("cell_size", F.lit(0))))
        for k in range(most)
    ]
    return joined.select("source", "doc_id", "size", "source_size", "target", sum(passes[1:], passes[0]).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix as documents: each row as often as the nearest whole number of times it is taken.

    Rows of one (source, doc_id, size) share out what they are taken together, in the order of a hash of all their
    columns; of rows that are equal in all columns it does not matter which. Columns are those of ``docs``.
    """
    taken = (
        mix(docs, **settings).filter(F.col("taken") > 0)
        .select("source", "doc_id", "size", F.round(F.col("taken") / F.col("size")).cast("int").alias("_times"))
        .groupBy("source", "doc_id", "size").agg(F.sum("_times").alias("_times"), F.count(F.lit(1)).alias("_rows")).filter(F.col("_times") > 0)
    )
    size, times, rows, copy = (unused(name, docs) for name in ("words", "times", "rows", "copy"))
    key = [unused(name, docs) for name in ("of_source", "of_doc", "of_size")]
    named = cut_lineage(taken.select(F.col("source").alias(key[0]), F.col("doc_id").alias(key[1]), F.col("size").alias(key[2]), F.col("_times").alias(times), F.col("_rows").alias(rows)))
    sized = docs.withColumn(size, n_words(F.col("text")))
    same = F.col("source").eqNullSafe(F.col(key[0])) & F.col("doc_id").eqNullSafe(F.col(key[1])) & (F.col(size) == F.col(key[2]))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = sized.join(named.filter(F.col(rows) == 1), same).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns)
    # rows that share a key: equal ones are counted, and stand as often as their places in the order give them
    row, n = F.struct(*columns), F.count(F.lit(1))
    shared = sized.join(named.filter(F.col(rows) > 1), same).select(*key, times, rows, row.alias("row"), F.xxhash64(*columns).alias("hash"))
    counted = shared.groupBy(*key, times, rows, "hash").agg(F.first("row").alias("row"), n.alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy("hash").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each, more = F.floor(F.col(times) / F.col(rows)), F.col(times) % F.col(rows)
    placed = counted.withColumn("stands", (F.col("n") * each + F.greatest(F.lit(0), F.least(F.col("n"), more - before))).cast("long")).filter("stands > 0")
    return single.unionAll(one_per_copy(placed, "stands", "copy").select("row.*"))
