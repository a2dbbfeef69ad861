"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _towards_least(pairs: DataFrame) -> DataFrame:
    """``pairs`` (node, near) and ``least`` of what is near the node and the node itself.

    The least is aggregated, and written, before it is joined back: the join then reads two plain shuffles, and splits
    a node with very many neighbours like any skewed key.
    """
    least = cut_lineage(pairs.groupBy("node").agg(F.min("near").alias("_least")))
    return pairs.join(least, "node").withColumn("least", F.least("_least", "node")).drop("_least")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: longs): the label is the least node of its component.

    Null ends and edges from a node to itself are left out. Each round hangs every node's larger
    neighbours, then its smaller ones, on its least neighbour; it ends when nothing changes.
    """
    now = cut_lineage(
        edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near")).filter("node <> near").distinct()
    )
    state = None
    for _ in range(MAX_ROUNDS):
        both = now.unionAll(now.select(F.col("near").alias("node"), F.col("node").alias("near")))
        large = _towards_least(both).filter("near > node").select(F.col("near").alias("node"), F.col("least").alias("near")).filter("node <> near").distinct()
        small = _towards_least(large)
        now = cut_lineage(
            small.select(F.col("near").alias("node"), F.col("least").alias("near"))
            .unionAll(small.select("node", F.col("least").alias("near"))).filter("node <> near").distinct()
        )
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "near").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError("the components did not settle")
    return now.select("node", F.col("near").alias("label")).unionAll(now.select(F.col("near").alias("node"), F.col("near").alias("label")).distinct())
