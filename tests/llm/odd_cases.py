"""Made documents and words, for the tests of this folder."""

import re

from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Columns of documents, and some that clash with what operators add.
SCHEMA = StructType(
    [
        StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
        StructField("source", StringType()), StructField("n_chars", LongType()), StructField("score", StringType()),
        StructField("shard", StringType()), StructField("label", StringType()), StructField("row", StringType()), StructField("n", StringType()),
    ]
)
SYLLABLES = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi", "pe", "du", "zo", "fa"]


def word(draw) -> str:
    return "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 4)))


def prose(draw, n) -> str:
    return " ".join(word(draw) + ("." if draw.random() < 0.1 else "") for _ in range(n))


def rows(texts, sources=("a", "b", None)):
    return [(k, t, "en", sources[k % len(sources)], None if t is None else len(t), "x", "y", "z", "r", "m") for k, t in enumerate(texts)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
