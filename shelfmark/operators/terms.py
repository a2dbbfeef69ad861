"""The terms that a work is looked up by: titles of several sources, in order, in two tiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from .keyed import first_per_key, top_per_key
from .matching import title_variants

PRIMARY, FALLBACK = 0, 1
#: Terms of a work that are looked up.
ACTIVE = 4
#: Sources of titles in the order in which they are asked.
SOURCES = ("heading", "title", "filename", "label", "extra", "quoted")
#: Titles that name no work.
UNNAMED = ("", "未命名", "资源", "合集", "电影", "电视剧")


def identity_in_files(works: DataFrame, resources: DataFrame) -> DataFrame:
    """(work_id, from_files): whether file names and labels say what a work is, rather than add an alias.

    So it is for works without a usable title, of a collection, with numbered resources, or whose media files have
    different titles. ``works`` (work_id, title, collection_id), ``resources`` (work_id, file_key, season, episode):
    ``file_key`` is the title key of a media file's name, null for other files.
    """
    each = resources.groupBy("work_id").agg(
        F.bool_or(F.col("season").isNotNull() | F.col("episode").isNotNull()).alias("_numbered"), (F.min("file_key") != F.max("file_key")).alias("_differ")
    )
    told = F.trim(F.coalesce("title", F.lit(""))).isin(*UNNAMED) | F.col("collection_id").isNotNull()
    joined = works.select("work_id", told.alias("_told")).join(each, "work_id", "left")
    return joined.select("work_id", (F.col("_told") | F.coalesce("_numbered", F.lit(False)) | F.coalesce("_differ", F.lit(False))).alias("from_files"))


def term_union(tables: dict[str, DataFrame], from_files: DataFrame) -> DataFrame:
    """(work_id, source, place, title, year, tier) of all term tables (work_id, place, title, year) by source name.

    Headings and titles are primary; names of files, labels and remarks only where files say what a work is; quoted titles
    as headings.
    """
    typed = [
        t.select("work_id", F.lit(name).alias("source"), F.lit(SOURCES.index(name)).alias("source_no"), F.col("place").cast("long").alias("place"), "title", F.col("year").cast("int").alias("year"))
        for name, t in tables.items()
    ]
    rows = reduce(DataFrame.unionByName, typed).filter(F.trim(F.coalesce("title", F.lit(""))) != "")
    joined = rows.join(from_files, "work_id", "left")
    own = F.col("source").isin("heading", "title", "quoted") | F.coalesce("from_files", F.lit(False))
    return joined.withColumn("tier", F.when(own, PRIMARY).otherwise(FALLBACK)).drop("from_files")


def search_terms(terms: DataFrame, active: int = ACTIVE) -> DataFrame:
    """(work_id, ord, title, year, tier, source, use) of each distinct term of a work, in order.

    Titles are taken apart into their variants; of equal ones (case and blanks aside) of one year the first stays, which
    also says its tier. ``use``: ``active`` for the first ``active`` primary terms, of works without any for the first terms
    at all; ``spare`` for those that go on where the active ones find nothing, up to the same number in all; else ``unused``.
    """
    keyed = terms.withColumn("_id", F.struct("work_id", "source_no", "place", "title", "year"))
    variants = title_variants(keyed.select("_id", "title").distinct(), "_id", "title")
    each = variants.join(keyed.select("_id", "tier", "source").distinct(), "_id").select(
        "_id.work_id", "_id.year", "_id.source_no", "_id.place", "ord", "tier", "source", F.col("variant").alias("title"), name_key(F.col("variant")).alias("_key")
    )
    first = first_per_key(each, ["work_id", "_key", "year"], [F.col("source_no"), F.col("place"), F.col("ord")], ["source_no", "place", "ord", "tier", "source", "title"]).withColumnRenamed("ord", "_ord")
    counts = first.groupBy("work_id").agg(F.count(F.when(F.col("tier") == PRIMARY, 1)).alias("_primary"))
    ranked = first.join(counts, "work_id").withColumn("_lead", F.when(F.col("_primary") == 0, 0).otherwise(F.col("tier")))
    order = [F.col("_lead"), F.col("source_no"), F.col("place"), F.col("_ord"), F.col("_key")]
    top = top_per_key(ranked, ["work_id"], order, active, "ord").select("work_id", "_key", "year", "ord")
    on = (F.col("work_id") == F.col("_w")) & (F.col("_key") == F.col("_k")) & F.col("year").eqNullSafe(F.col("_y"))
    kept = ranked.join(top.select(F.col("work_id").alias("_w"), F.col("_key").alias("_k"), F.col("year").alias("_y"), "ord"), on, "left")
    use = F.when(F.col("ord").isNull(), "unused").when(F.col("_lead") == PRIMARY, "active").otherwise("spare")
    return kept.select("work_id", "ord", "title", "year", "tier", "source", use.alias("use"))
