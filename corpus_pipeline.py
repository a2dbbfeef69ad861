"""A training corpus out of raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet
and read again. Null and empty texts pass through: they are not toxic, leak nothing and have no words to be
mixed, so the mix leaves them out. Repeated rows count as copies, of which one stays. An empty table gives an empty result. Extra
columns go through to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import decontaminate, jaccard, mix, shard, toxicity
from shelfmark.llm.common import fold, table
from shelfmark.session import written

TOXIC_FROM = 0.5
SHARDS = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a probability of toxicity below TOXIC_FROM."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score(docs, model, "_toxicity")
    return scored.filter(F.col("_toxicity") < TOXIC_FROM).select(*[f"`{c}`" for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-equal texts, that of the least doc_id."""
    return jaccard.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, up to its error budget."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a row stands as often as the mix takes the document."""
    return mix.mixed_documents(docs)


def assign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard, which doc_id decides."""
    return shard.assign_shards(docs, ["doc_id"], [1.0] * SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", keep_one_of_each),
    ("benchmark_decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", assign),
]

#: No SQL: toxicity is a trained model, and near copies and edit distances need code. Tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
