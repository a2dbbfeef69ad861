"""Resource views: groups, presentation, classes, edits, people and collection groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import jsonx, urls
from ..functions.numeric import count_where
from ..functions.text import blank_to_null, extension, redact, stable_code, title_key
from ..functions.times import year_prefix
from .headings import has_collection_marker
from .keyed import top_per_key
from .works import provider_id, recency_filter, tag_filter, value_group, year_filter

UNNAMED = "未命名资源"


def recognition_status(status: Column, catalogue_id: Column) -> Column:
    return (
        F.when((status == "matched") & catalogue_id.isNotNull(), "matched")
        .when(status.isin("review", "not_found", "error"), status)
        .otherwise("unrecognized")
    )


def resource_group(resource_class: Column, recognition: Column) -> Column:
    """Exactly one of seven groups for every resource."""
    return (
        F.when(resource_class == "person", "person")
        .when(resource_class == "collection", "series")
        .when(resource_class.isin("music", "nsfw", "other"), resource_class)
        .when(recognition == "matched", "media")
        .otherwise("unrecognized")
    )


def with_groups(view: DataFrame) -> DataFrame:
    """Add provider, recognition, group, year and update time to the base view."""
    return view.withColumns({
        "provider_id": provider_id(F.col("source_type"), F.col("provider")),
        "recognition_status": recognition_status(F.col("status"), F.col("catalogue_id")),
        "year": F.coalesce("parsed_year", "year", year_prefix(F.col("release_date"))),
        "updated_at": F.coalesce("last_checked_at", "created_at"),
    }).withColumn("resource_group", resource_group(F.col("resource_class"), F.col("recognition_status")))


@dataclass(frozen=True)
class ResourceFilter:
    """Validated parameters of a resource query."""

    group: str = "all"
    resource_class: str = "all"
    provider: str = "all"
    availability: str = "all"
    recognition: str = "all"
    year: str = "all"
    tag: str = ""
    quality: str = "all"
    updated: str = "all"
    sort: str = "updated_desc"
    as_of: str | None = None

    def __post_init__(self):
        allowed = {
            "group": rules.RESOURCE_GROUPS, "resource_class": rules.RESOURCE_CLASSES, "availability": rules.AVAILABILITY,
            "recognition": rules.RECOGNITION_STATUSES, "quality": ("unknown", *rules.QUALITY_GROUPS), "updated": ("7", "30", "90"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in ("all", *values):
                raise ValueError(f"{name}: {getattr(self, name)!r}")
        if self.sort not in RESOURCE_SORTS:
            raise ValueError(f"sort: {self.sort!r}")
        if self.updated != "all" and self.as_of is None:
            raise ValueError("a recency filter needs as_of")
        if self.year not in ("all", "unknown") and not (self.year.isdigit() and 1870 <= int(self.year) <= 2100):
            raise ValueError(f"year: {self.year!r}")

    def apply(self, df: DataFrame) -> DataFrame:
        equal = {
            "resource_group": self.group, "resource_class": self.resource_class, "availability": self.availability,
            "recognition_status": self.recognition, "provider_id": self.provider,
        }
        for column, value in equal.items():
            if value != "all":
                df = df.filter(F.col(column) == value)
        if self.year != "all":
            df = df.filter(year_filter(F.col("year"), self.year))
        if self.quality != "all":
            df = df.filter(value_group(F.col("quality"), self.quality, rules.QUALITY_GROUPS))
        if self.tag:
            df = df.filter(tag_filter(F.col("tags"), self.tag))
        if self.updated != "all":
            df = df.filter(recency_filter(F.col("updated_at"), self.updated, self.as_of))
        return df


RESOURCE_SORTS = {
    "updated_desc": lambda: [F.desc("updated_at"), F.desc("id")],
    "title_asc": lambda: [F.lower("raw_label").asc(), F.desc("id")],
    "checked_desc": lambda: [F.desc_nulls_last("last_checked_at"), F.desc("id")],
    "created_desc": lambda: [F.desc("created_at"), F.desc("id")],
}


def group_summary(view: DataFrame) -> DataFrame:
    """Counts per availability and group over the unfiltered view."""
    return view.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_where(F.col("availability") == a).alias(a) for a in ("available", "pending", "invalid")],
        *[count_where(F.col("resource_group") == g).alias(f"group_{g}") for g in rules.RESOURCE_GROUPS],
    )


def display_title(df_title: Column | None = None) -> Column:
    """Label, file name or work title; a stable code names its work itself."""
    title = F.coalesce(blank_to_null(F.col("raw_label")), blank_to_null(F.col("filename")), blank_to_null(F.col("work_title")), F.lit(UNNAMED))
    return F.when((F.col("resource_class") == "nsfw") & stable_code(F.col("work_title")).isNotNull(), F.col("work_title")).otherwise(title)


def present(view: DataFrame) -> DataFrame:
    """Presentation rows: codes and tokens masked, originals not carried."""
    code = urls.access_code(F.col("url"))
    return view.select(
        "id", "work_id", redact(display_title()).alias("title"), redact(F.col("filename")).alias("filename"),
        "resource_class", "resource_group", "recognition_status", "provider_id", "availability", "year", "quality",
        F.col("file_size").alias("total_size"),
        F.array_join(F.transform(jsonx.string_array(F.col("tags")), redact), ",").alias("tags"),
        urls.masked_url(F.col("url")).alias("url_masked"),
        F.when(code != "", "****").otherwise("").alias("access_code_masked"),
    )


# --- classes ----------------------------------------------------------------------------------
def looks_like_video(filename: Column) -> Column:
    return F.coalesce(extension(filename).isin(*rules.VIDEO_EXTENSIONS), F.lit(False))


def looks_like_audio(filename: Column) -> Column:
    return F.coalesce(extension(filename).isin(*rules.AUDIO_EXTENSIONS), F.lit(False))


def infer_class(kind: Column, title: Column, media_type: Column, filename: Column) -> Column:
    """Class of a resource: declared kind, stable code, music, collection words, then type."""
    t = F.coalesce(title, F.lit(""))
    return (
        F.when(kind == "person", "person")
        .when(kind == "series", "collection")
        .when(stable_code(title).isNotNull() | stable_code(filename).isNotNull(), "nsfw")
        .when(looks_like_audio(filename), "music")
        .when(t.rlike(rules.MUSIC_TITLE), "music")
        .when(~looks_like_video(filename) & t.rlike(rules.MUSIC_FORMAT), "music")
        .when(has_collection_marker(t) | t.rlike(rules.PACK_WORDS), "collection")
        .when(media_type.isin("movie", "tv"), "media")
        .otherwise("other")
    )


def explicit_kind(declared: Column, context: Column) -> Column:
    """Declared kind, else the icon of the first context line; a category line is no collection."""
    line = F.regexp_replace(F.split_part(context, F.lit("\n"), F.lit(1)), "^[﻿ \t]+", "")
    icon = F.regexp_extract(line, r"^([📺🎥🎬👤🗂])", 1)
    return F.coalesce(
        F.when(declared.isin(*rules.KINDS), declared),
        F.when(icon == "👤", "person")
        .when((icon == "🗂") & ~line.rlike(r"^🗂\x{FE0F}?\s*分类\s*[:：]"), "series")
        .when(icon.isin("📺", "🎥", "🎬"), "media"),
    )


def availability_from_snapshot(status: Column, code: Column) -> Column:
    """Stored snapshot to availability; only the two dead codes mean gone."""
    return (
        F.when(status == "ok", "available")
        .when(code.cast("string").isin("4100009", "4100010"), "invalid")
        .when(status.isin("error", "unavailable"), "pending")
        .otherwise("unknown")
    )


def technical_summary(resources: DataFrame) -> DataFrame:
    """Size, media information (masked) and quality tags of each resource, from its metadata; broken metadata has neither."""
    return resources.withColumns({
        "total_size": F.col("file_size"), "media_info": redact(F.get_json_object("metadata", "$.media_info")),
        "quality_tags": jsonx.string_array(F.get_json_object("metadata", "$.quality_tags")),
    })


def file_role(filename: Column) -> Column:
    """primary, artwork, extra, audio, sidecar or none for a missing name."""
    ext = extension(filename)
    lower = F.lower(F.trim(filename))
    return (
        F.when(blank_to_null(filename).isNull(), "none")
        .when(lower.rlike(r"(?:^|[._ \-])(?:trailer|sample|featurette|extras?|behind[._ ]the[._ ]scenes)(?:[._ \-]|$)"), "extra")
        .when(filename.rlike(rules.MEDIA_EXTENSION), "primary")
        .when(ext.isin(*rules.PRIMARY_AUDIO) & ~lower.endswith("theme.mp3"), "primary")
        .when(ext.isin(*rules.AUDIO_EXTENSIONS), "audio")
        .when(ext.isin(*rules.IMAGE_EXTENSIONS) & is_artwork(filename), "artwork")
        .otherwise("sidecar")
    )


def is_artwork(filename: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(filename)), r"\.[^.]*$", "")
    return name.rlike(rules.ARTWORK_STEM) | name.rlike(rules.EPISODE_THUMB)


def metadata_packs(files: DataFrame, titles: DataFrame) -> DataFrame:
    """Works that hold only artwork and metadata files, with the reason.

    ``files`` has (work_id, filename), ``titles`` (work_id, title). A work with any unnamed
    file, video, real audio, other file or non-artwork image is never one. Per-file flags
    aggregate before the shuffle, so the size of a work does not matter.
    """
    name = F.coalesce(F.trim("filename"), F.lit(""))
    ext = extension(F.col("filename"))
    image, nfo = ext.isin(*rules.IMAGE_EXTENSIONS), ext == "nfo"
    theme = (ext == "mp3") & (F.regexp_replace(F.lower(name), r"\.[^.]*$", "") == "theme")
    flags = files.select(
        "work_id",
        (name != "").alias("named"), F.coalesce(image, F.lit(False)).alias("image"), F.coalesce(nfo, F.lit(False)).alias("nfo"),
        F.coalesce(theme, F.lit(False)).alias("theme"),
        F.coalesce(~image | is_artwork(F.col("filename")), F.lit(False)).alias("artwork_ok"),
    )
    per = flags.groupBy("work_id").agg(
        F.bool_and("named").alias("all_named"),
        F.bool_and(F.col("image") | F.col("nfo") | F.col("theme")).alias("only_auxiliary"),
        F.bool_or("theme").alias("any_theme"), F.bool_or("image").alias("any_image"), F.bool_or("nfo").alias("any_nfo"),
        F.bool_and("artwork_ok").alias("images_are_artwork"),
    )
    pack = (
        F.col("all_named") & F.col("only_auxiliary")
        & (~F.col("any_theme") | (F.col("any_image") & F.col("any_nfo")))
        & F.col("images_are_artwork") & ~F.coalesce(F.col("title"), F.lit("")).rlike(rules.IMAGE_CONTENT_TITLE)
    )
    reason = F.when(F.col("any_image"), "artwork").when(F.col("any_nfo"), "nfo").otherwise("auxiliary")
    return per.join(titles, "work_id", "left").select(
        "work_id", pack.alias("is_metadata"), F.when(pack, reason).alias("reason")
    )


# --- edits ------------------------------------------------------------------------------------
MAX_TAGS, MAX_TAG, MAX_NOTES = 20, 40, 2000


def valid_edits(edits: DataFrame) -> DataFrame:
    """Split-ready edits: ``problem`` names the first rule an edit breaks, else null."""
    tags = F.transform("tags", lambda x: F.trim(x))
    return edits.withColumn(
        "problem",
        F.when(F.col("resource_class").isNotNull() & ~F.col("resource_class").isin(*rules.RESOURCE_CLASSES), "class")
        .when(F.size("tags") > MAX_TAGS, "tags")
        .when(F.exists("tags", lambda x: ~F.length(F.trim(x)).between(1, MAX_TAG)), "tag length")
        .when(F.length("notes") > MAX_NOTES, "notes"),
    ).withColumn("tags", F.array_distinct(tags))


def overlay_edits(resources: DataFrame, edits: DataFrame) -> DataFrame:
    """Valid edits over stored values; at most one edit row per resource id."""
    ok = valid_edits(edits).filter(F.col("problem").isNull()).select(
        "id", F.col("resource_class").alias("_class"), F.col("tags").alias("_tags"), F.col("notes").alias("_notes")
    )
    return resources.join(ok, "id", "left").withColumns({
        "resource_class": F.coalesce("_class", "resource_class"),
        "tags": F.coalesce("_tags", "tags"),
        "notes": F.coalesce("_notes", "notes"),
    }).drop("_class", "_tags", "_notes")


# --- groups -----------------------------------------------------------------------------------
def _group_rows(keyed: DataFrame) -> DataFrame:
    """Counts, providers, tags, newest times and size per ``group_key``; of ``_member`` titles the first and last.

    The view is aggregated once, per group, provider and tag list; all else derives from those few rows.
    """
    states = ("available", "pending", "invalid")
    parts = keyed.groupBy("group_key", "provider_id", "tags").agg(
        F.count(F.lit(1)).alias("_n"),
        *[count_where(F.col("availability") == a).alias(a) for a in states],
        F.max("updated_at").alias("updated_at"), F.max("created_at").alias("created_at"), F.sum("file_size").alias("_size"),
        F.min(F.struct("id", "work_title")).alias("_head"),
        F.min("_member").alias("_first"), F.max("_member").alias("_last"), F.max("collection_title").alias("_collection"),
    )
    providers = parts.groupBy("group_key", "provider_id").agg(
        F.sum("_n").alias("_n"), *[F.sum(a).alias(a) for a in states], F.max("updated_at").alias("updated_at"), F.max("created_at").alias("created_at"),
        F.sum("_size").alias("_size"), F.min("_head").alias("_head"),
        F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_collection").alias("_collection"),
    )
    base = providers.groupBy("group_key").agg(
        F.sum("_n").alias("resource_count"), *[F.sum(a).alias(a) for a in states],
        F.max("updated_at").alias("updated_at"), F.max("created_at").alias("created_at"), F.coalesce(F.sum("_size"), F.lit(0)).alias("total_size"),
        F.min("_head")["work_title"].alias("_title"), F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.max("_collection").alias("_collection"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "provider_id", F.col("_n").cast("string")))), ",").alias("providers"),
    ).withColumn("unknown", F.col("resource_count") - F.col("available") - F.col("pending") - F.col("invalid"))
    tags = (
        parts.select("group_key", "tags").distinct().select("group_key", F.explode(jsonx.string_array(F.col("tags"))).alias("tag")).distinct()
        .groupBy("group_key").agg(F.array_join(F.array_sort(F.collect_list(redact(F.col("tag")))), ",").alias("tags"))
    )
    return base.join(tags, "group_key", "left").withColumn("tags", F.coalesce("tags", F.lit("")))


def person_groups(view: DataFrame) -> DataFrame:
    """One row per person: the normalised title is the key, else the work id."""
    key = title_key(F.coalesce(blank_to_null(F.col("work_title")), display_title()))
    keyed = view.filter(F.col("resource_group") == "person").withColumn(
        "group_key", F.when(key != "", key).otherwise(F.concat(F.lit("media-"), F.col("work_id").cast("string")))
    )
    return _group_rows(keyed.withColumn("_member", F.col("work_title"))).withColumnRenamed("_title", "title").drop("_first", "_last", "_collection")


def collection_groups(view: DataFrame) -> DataFrame:
    """One row per collection; its title is the members' single title, else the collection's."""
    fallback = title_key(F.coalesce(blank_to_null(F.col("work_title")), display_title()))
    key = F.when(F.col("collection_id").isNotNull(), F.concat(F.lit("series-"), F.col("collection_id").cast("string"))).otherwise(
        F.concat(F.lit("collection-"), F.when(fallback != "", fallback).otherwise(F.col("work_id").cast("string")))
    )
    keyed = view.filter(F.col("resource_group") == "series").withColumn("group_key", key)
    member = F.nullif(F.trim(F.coalesce(blank_to_null(F.col("work_title")), display_title())), F.lit(""))
    title = redact(
        F.when(F.col("_first") == F.col("_last"), F.col("_first")).otherwise(F.coalesce("_collection", "_first", F.lit("未命名合集")))
    )
    return _group_rows(keyed.withColumn("_member", member)).withColumn("title", title).drop("_title", "_first", "_last", "_collection")


def deliveries(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Every message of a resource key, marked as its delivery or a repeat.

    Inserted links are deliveries; a key without any takes its oldest message. The oldest is
    an aggregate joined back, so a key repeated by a third of all messages is no hot window.
    """
    m = messages.select(F.col("id").alias("message_id"), "received_at")
    rows = links.select("source_key", "message_id", "status").distinct().join(m, "message_id")
    heads = rows.groupBy("source_key").agg(
        F.bool_or(F.col("status") == "inserted").alias("_has"),
        F.min_by("message_id", F.struct("received_at", "message_id")).alias("_oldest"),
    )
    delivered = F.when(F.col("_has"), F.col("status") == "inserted").otherwise(F.col("message_id") == F.col("_oldest"))
    return rows.join(heads, "source_key").select("source_key", "message_id", "status", "received_at", delivered.alias("is_delivery"))


def related_resources(view: DataFrame, k: int = 30) -> DataFrame:
    """Newest ``k`` resources of every matched work (the detail page drops the one shown)."""
    matched = view.filter(F.col("recognition_status") == "matched")
    return top_per_key(matched, ["work_id"], [F.desc("id")], k + 1)
