"""Text lists, delivered messages, web pages; batch summaries, upserts and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import count_where
from ..functions.text import blank_to_null

#: Longest event id and largest message text that intake accepts.
MAX_EVENT_ID = 200
MAX_TEXT_BYTES = 512 * 1024


def read_text_lists(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, line_no, line) of whole text files; a leading byte-order mark is dropped."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return files.select("path", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line_no", "line"))


def envelope_text(*candidates: Column) -> Column:
    """The first candidate that is not blank."""
    return F.coalesce(*[F.when(F.rlike(c, F.lit(r"(?U)\S")), c) for c in candidates])


def accept_messages(envelopes: DataFrame, event_id: str, candidates: list[str]) -> DataFrame:
    """``envelopes`` with ``text`` and ``accepted``: an id of 1 to 200 characters and a text of no more than 512 KiB."""
    text = envelope_text(*[F.col(c) for c in candidates])
    out = envelopes.withColumn("text", F.coalesce(text, F.lit("")))
    return out.withColumn("accepted", F.length(event_id).between(1, MAX_EVENT_ID) & (F.octet_length("text") <= MAX_TEXT_BYTES))


_META = r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)["']"""
_TITLE = r"(?is)<title[^>]*>(.*?)</title>"
_HIDDEN = r"(?is)<(?:script|style|noscript|template)[^>]*>.*?</(?:script|style|noscript|template)>"
_HREF = r"""(?i)<a\s[^>]*?href=["']([^"']*)["']"""


def page_fields(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title (the declared share title first), visible text and links of each page, as native columns."""
    page = F.coalesce(F.col(html), F.lit(""))
    shared, plain = F.regexp_extract(page, _META, 1), F.regexp_extract(page, _TITLE, 1)
    shown = F.regexp_replace(F.regexp_replace(page, _HIDDEN, " "), r"(?s)<[^>]*>", " ")
    return pages.withColumns({
        "title": F.nullif(F.trim(F.coalesce(F.nullif(shared, F.lit("")), plain)), F.lit("")),
        "visible_text": F.trim(F.regexp_replace(shown, r"\s+", " ")),
        "links": F.regexp_extract_all(page, F.lit(_HREF), F.lit(1)),
    })


def batch_summary(contents: DataFrame, batch: str, content: str) -> DataFrame:
    """Per batch: rows, those with new content (the first of equal ones, by batch), repeats, blanks."""
    digests = contents.select(batch, F.sha2(F.col(content), 256).alias("digest"), blank_to_null(F.col(content)).isNull().alias("blank"))
    counted = digests.groupBy(batch, "digest").agg(F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"))
    first = counted.filter(~F.col("blank")).groupBy("digest").agg(F.min(batch).alias("_first"))
    joined = counted.join(first, "digest", "left")
    new = ~F.col("blank") & (F.col("_first") == F.col(batch))
    return joined.groupBy(batch).agg(
        F.sum("n").alias("total"), count_where(new).alias("inserted"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.when(new, 1).otherwise(0))).alias("duplicate"),
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("error"),
    )


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], mode: str = "update") -> DataFrame:
    """``stored`` after ``incoming`` rows of the same columns.

    ``ignore`` keeps what is stored and adds the earliest row of each new key; ``update`` takes the latest incoming row of a
    key; ``replace`` drops stored rows of incoming keys and takes all incoming ones. The order decides, not arrival.
    """
    if mode == "replace":
        return stored.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)
    columns = [c for c in stored.columns if c not in keys]
    pick = F.min_by if mode == "ignore" else F.max_by
    one = incoming.groupBy(*keys).agg(pick(F.struct(*columns), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
    first, second = (stored, one) if mode == "ignore" else (one, stored)
    return first.unionByName(second.join(first.select(*keys), keys, "left_anti"))


def reconcile_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """Rows per labelled table before and after, and the difference."""

    def counts(tables: dict[str, DataFrame], name: str) -> DataFrame:
        each = [t.agg(F.count(F.lit(1)).alias(name)).select(F.lit(label).alias("label"), name) for label, t in sorted(tables.items())]
        return reduce(DataFrame.unionByName, each)

    both = counts(before, "before").join(counts(after, "after"), "label", "full").na.fill(0, ["before", "after"])
    return both.withColumn("change", F.col("after") - F.col("before"))
