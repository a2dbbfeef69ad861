"""URL filters: explicit rules first, then logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

FEATURES = 1 << 12
GRAM = 3
#: No more labelled URLs than this are fitted, those with the lowest hashes.
TRAIN_URLS = 4_096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str  # fits this host and its subdomains
    path: str  # fits paths that start so

    @property
    def name(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What is after the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def deciding_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct of its name and verdict; null where none does.

    Rules are configuration, compiled into one expression; equal lengths go by the rules' names.
    """
    fit: Column = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the last one tried wins
        inside = (host == rule.host) | F.endswith(host, F.lit("." + rule.host))
        named = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        fit = F.when(inside & F.startswith(path, F.lit(rule.path)), named).otherwise(fit)
    return fit


def grams(host: Column, path: Column, n: int = GRAM) -> Column:
    """Character n-grams of host and path, marked by the part they are from; the parts' ends count as characters.

    Digits count as one another, so that a page's number is no feature.
    """

    def of(part: Column, mark: str) -> Column:
        def cut(chars: Column) -> Column:
            starts = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(starts, lambda i: F.concat(F.lit(mark), *[F.element_at(chars, i + k) for k in range(n)]))

        return let(F.split(F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]", "0"), F.lit("$")), ""), cut)

    return F.array_distinct(F.concat(of(host, "h"), of(path, "p")))


def _hashed(df: DataFrame, features: int) -> DataFrame:
    tf = HashingTF(binary=True, numFeatures=features, inputCol="_grams", outputCol="_features")
    return tf.transform(df.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))


def train(labelled: DataFrame, features: int = FEATURES, limit: int = TRAIN_URLS) -> LogisticRegressionModel | float:
    """A model of ``blocked`` (0.0 or 1.0) from a table (url, blocked).

    Fits on the ``limit`` URLs with the lowest hashes, each once. If all labels agree, or there are none,
    the answer is that label (0.0 for none) and there is nothing to fit.
    """
    rows = (
        labelled.filter(F.col("url").isNotNull()).groupBy("url").agg(F.max("blocked").alias("blocked"))
        .orderBy(F.xxhash64("url"), "url").limit(limit)
        .select(url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"), "blocked")
    )
    rows = _hashed(rows, features).select("_features", "blocked").cache()
    try:
        kinds = [r[0] for r in rows.select("blocked").distinct().collect()]
        if len(kinds) < 2:
            return float(kinds[0]) if kinds else 0.0
        return LogisticRegression(featuresCol="_features", labelCol="blocked", regParam=0.01, maxIter=50).fit(rows)
    finally:
        rows.unpersist()


def judge(pages: DataFrame, rules: Sequence[Rule], model: LogisticRegressionModel | float, features: int = FEATURES) -> DataFrame:
    """``pages`` (with ``url``) and host, path, rule, verdict, score (probability of block).

    A rule's verdict stands; the model decides the others. Null urls and those without ``://``
    have an empty host and path, fit no rule that names a host, and are scored like any other.
    Columns of ``pages`` with the added names are replaced.
    """
    # the page goes along as one column, so that no name of its own meets those the model adds
    page = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    judged = pages.select(page.alias("_page"), url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"))
    if isinstance(model, float):
        judged = judged.withColumn("_score", F.lit(model))
    else:
        judged = model.transform(_hashed(judged, features)).withColumn("_score", F.element_at(vector_to_array("probability"), 2))
    ruled = judged.select("_page", "_host", "_path", "_score", deciding_rule(F.col("_host"), F.col("_path"), rules).alias("_rule"))
    added = {
        "host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule")["name"],
        "verdict": F.coalesce(F.col("_rule")["verdict"], F.when(F.col("_score") >= 0.5, "block").otherwise("allow")), "score": F.col("_score"),
    }
    kept = [F.col("_page").getField(c).alias(c) for c in pages.columns if c not in added]
    return ruled.select(*kept, *[c.alias(name) for name, c in added.items()])
