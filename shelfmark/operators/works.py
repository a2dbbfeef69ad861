"""Works and their resources: facet filters, joins, statistics, ordering, pages."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import jsonx
from ..functions.numeric import count_where
from ..functions.text import like_literal, like_sequence
from ..functions.times import as_ntz, effective_year
from .keyed import latest_per_key, top_per_key

GENRE_FIELDS = "id int, name string"


def provider_id(source_type: Column, provider: Column) -> Column:
    """Hash links are their own provider whatever the carrier says."""
    return F.when(source_type == "ed2k", F.lit("ed2k")).otherwise(provider)


def provider_dimension(df: DataFrame, column: str) -> DataFrame:
    """Add label and can-check flag; unknown providers show their own id."""
    spark = df.sparkSession
    dim = spark.createDataFrame(list(rules.PROVIDERS), "pid string, provider_label string, _can boolean")
    joined = df.join(F.broadcast(dim), F.col(column) == F.col("pid"), "left")  # 8 fixed rows
    return joined.withColumn(
        "provider_label", F.coalesce("provider_label", F.nullif(F.col(column), F.lit("")), F.lit(rules.UNKNOWN_PROVIDER))
    ).withColumn("can_check", F.coalesce("_can", F.lit(False))).drop("pid", "_can")


# --- predicates -------------------------------------------------------------------------------
def value_group(column: Column, selected: str, groups: dict[str, tuple[str, ...]]) -> Column:
    """Alias-set filter after trim and upper; ``unknown`` is null or blank."""
    if selected == "unknown":
        return F.nullif(F.trim(column), F.lit("")).isNull()
    if selected not in groups:
        raise ValueError(f"no such value group: {selected}")
    return F.upper(F.trim(column)).isin(*groups[selected])


def token_in_list(column: Column, token: str, delimiter: str = "+") -> Column:
    """A delimited list holds ``token`` as a whole element."""
    parts = F.split(F.upper(F.replace(column, F.lit(" "))), re.escape(delimiter))
    return F.array_contains(parts, token.upper())


def hdr_filter(column: Column, selected: str) -> Column:
    if selected == "unknown":
        return F.nullif(F.trim(column), F.lit("")).isNull()
    if selected == "hdr":
        return F.contains(F.upper(column), F.lit("HDR"))
    if selected in ("dv", "sdr"):
        return token_in_list(column, selected)
    raise ValueError(f"no such dynamic range: {selected}")


def year_filter(year: Column, selected: str) -> Column:
    """A year, a decade such as ``1990s``, ``earlier`` or ``unknown``."""
    if selected == "unknown":
        return year.isNull()
    if selected == "earlier":
        return year < rules.EARLIER_THAN
    decade = selected.endswith("0s")
    number = selected[:-1] if decade else selected
    if not re.fullmatch(r"[12]\d{3}", number) or not 1870 <= int(number) <= 2100:
        raise ValueError(f"no such year: {selected}")
    return year.between(int(number), int(number) + (9 if decade else 0))


def genre_filter(genres_json: Column, selected: str) -> Column:
    genres = jsonx.object_array(genres_json, GENRE_FIELDS)
    if re.fullmatch(r"[1-9]\d{0,7}", selected):
        return F.exists(genres, lambda g: g["id"] == int(selected))
    if re.fullmatch(r"[一-龥A-Za-z0-9 &]{1,20}", selected):
        return F.exists(genres, lambda g: g["name"] == selected)
    raise ValueError(f"no such genre: {selected}")


def category_filter(genres_json: Column, selected: str) -> Column:
    """Genre set of a category; drama is everything outside the named sets."""
    selected = {"doc": "documentary", "series": "drama"}.get(selected, selected)
    ids = F.transform(jsonx.object_array(genres_json, GENRE_FIELDS), lambda g: g["id"])
    ids = F.filter(ids, lambda i: i.isNotNull())

    def overlap(wanted):
        return F.arrays_overlap(ids, F.array(*[F.lit(i) for i in wanted]))

    if selected == "drama":
        return ~overlap(rules.NOT_DRAMA_GENRES)
    if selected not in rules.CATEGORY_GENRES:
        raise ValueError(f"no such category: {selected}")
    return overlap(rules.CATEGORY_GENRES[selected])


def country_filter(countries_json: Column, selected: str) -> Column:
    """Two-letter code or the western region set, any case."""
    codes = F.transform(jsonx.string_array(countries_json), F.upper)
    if selected.strip().lower() in rules.WESTERN_NAMES:
        return F.arrays_overlap(codes, F.array(*[F.lit(c) for c in rules.WESTERN_COUNTRIES]))
    if not re.fullmatch(r"[A-Za-z]{2}", selected):
        raise ValueError(f"no such country: {selected}")
    return F.array_contains(codes, selected.upper())


def tag_filter(tags_json: Column, tag: str) -> Column:
    return F.array_contains(jsonx.string_array(tags_json), tag)


def recency_filter(updated_at: Column, days: int | str, as_of: str) -> Column:
    if str(days) not in ("7", "30", "90"):
        raise ValueError(f"no such recency: {days}")
    return updated_at >= as_ntz(dt.datetime.fromisoformat(as_of) - dt.timedelta(days=int(days)))


SORTS = {
    "updated_desc": lambda: [F.desc("updated_at"), F.desc("id")],
    "vote_desc": lambda: [F.desc_nulls_last("vote"), F.desc("updated_at"), F.desc("id")],
    "title_asc": lambda: [F.asc("title_key"), F.desc_nulls_last("year"), F.desc("id")],
    "year_desc": lambda: [F.desc_nulls_last("work_year"), F.asc("title_key"), F.desc("id")],
    "year_asc": lambda: [F.asc_nulls_last("work_year"), F.asc("title_key"), F.desc("id")],
    "sources_desc": lambda: [F.desc("matched_source_count"), F.desc("source_count"), F.asc("title_key"), F.desc("id")],
    "confidence_asc": lambda: [F.asc_nulls_last("confidence"), F.asc("title_key"), F.desc("id")],
}


@dataclass(frozen=True)
class WorkFilter:
    """Validated parameters of a catalogue query."""

    query: str = ""
    status: str = "all"
    media_type: str = "all"
    category: str = "all"
    kind: str = "all"
    source_type: str = "all"
    availability: str = "all"
    year: str = "all"
    genre: str = "all"
    country: str = "all"
    quality: str = "all"
    codec: str = "all"
    hdr: str = "all"
    multi_source_only: bool = False
    sort: str = "updated_desc"
    page: int = 1
    page_size: int = 30
    _choices: dict = field(
        default_factory=lambda: {
            "status": ("all", "matched", "pending", "unsearched", "review", "not_found", "error"),
            "media_type": ("all", *rules.MEDIA_TYPES),
            "category": ("all", "anime", "documentary", "doc", "variety", "drama", "series"),
            "kind": ("all", *rules.KINDS),
            "source_type": ("all", *rules.SOURCE_TYPES),
            "availability": ("all", "available", "missing"),
            "quality": ("all", "unknown", *rules.QUALITY_GROUPS),
            "codec": ("all", "unknown", *rules.CODEC_GROUPS),
            "hdr": ("all", "unknown", "dv", "hdr", "sdr"),
            "sort": tuple(SORTS),
        },
        repr=False,
        compare=False,
    )

    def __post_init__(self):
        for name, allowed in self._choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is not one of {allowed}")

    @property
    def size(self) -> int:
        return min(max(self.page_size, 10), 100)

    def work_predicates(self) -> list[Column]:
        """Predicates on the work's own columns; null-safe ones only."""
        out = [~F.col("is_metadata"), F.col("resource_kind") != "series"]
        ordinary = ~F.col("resource_kind").isin("person", "series")
        if self.status == "matched":
            out.append(F.col("status") == "matched")
        elif self.status == "pending":
            out += [F.col("status") != "matched", ordinary, ~F.col("is_bundle")]
        elif self.status == "unsearched":
            out += [F.col("status") == "pending", ordinary]
        elif self.status != "all":
            out += [F.col("status") == self.status, ordinary, ~F.col("is_bundle")]
        if self.media_type != "all":
            out.append(F.col("media_type") == self.media_type)
        if self.category != "all":
            out.append(category_filter(F.col("genres"), self.category))
        if self.kind != "all":
            out.append(F.col("resource_kind") == self.kind)
        if self.year != "all":
            out.append(year_filter(effective_year(F.col("year"), F.col("release_date")), self.year))
        if self.genre != "all":
            out.append(genre_filter(F.col("genres"), self.genre))
        if self.country != "all":
            out.append(country_filter(F.col("countries"), self.country))
        return out

    @property
    def excludes_music_and_adult(self) -> bool:
        return self.status not in ("all", "matched")

    def resource_predicate(self) -> Column | None:
        """One predicate that a single resource must satisfy as a whole."""
        parts = []
        if self.source_type != "all":
            parts.append(F.col("source_type") == self.source_type)
        if self.quality != "all":
            parts.append(value_group(F.col("quality"), self.quality, rules.QUALITY_GROUPS))
        if self.codec != "all":
            parts.append(value_group(F.col("codec"), self.codec, rules.CODEC_GROUPS))
        if self.hdr != "all":
            parts.append(hdr_filter(F.col("hdr"), self.hdr))
        out = None
        for part in parts:
            out = part if out is None else out & part
        return out


def child_summary(resources: DataFrame, matched: Column | None = None) -> DataFrame:
    """Per work, all-children columns beside matched-children columns, in one aggregation."""
    hit = F.lit(True) if matched is None else F.coalesce(matched, F.lit(False))
    numbered = F.when(F.col("episode").isNotNull(), F.struct(F.col("season"), F.col("episode")))
    return resources.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("source_count"),
        count_where(hit).alias("matched_source_count"),
        *[count_where(F.col("source_type") == s).alias(f"count_{s}") for s in rules.SOURCE_TYPES],
        F.array_join(F.sort_array(F.collect_set("quality")), ",").alias("qualities"),
        F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("quality")))), ",").alias("matched_qualities"),
        F.max(F.coalesce("season_end", "season")).alias("max_season"),
        F.count_distinct(numbered).alias("episode_count"),
    )


def text_hits(works: DataFrame, resources: DataFrame, query: str) -> DataFrame:
    """Ids of works found by title, id, year, file name or label; union of hits per field."""
    query = query.strip()
    own = works.filter(
        like_literal(F.col("title"), query)
        | F.coalesce(like_literal(F.col("catalogue_title"), query), F.lit(False))
        | (F.col("catalogue_id").cast("string") == query)
        | (F.col("year").cast("string") == query)
    ).select("id")
    child = resources.filter(
        like_sequence(F.col("filename"), query) | like_literal(F.col("raw_label"), query)
    ).select(F.col("work_id").alias("id"))
    return own.unionByName(child).distinct()


def select_works(works: DataFrame, resources: DataFrame, f: WorkFilter) -> DataFrame:
    """All works that pass the filter, with their child summaries; unordered, unpaged."""
    out = works
    for predicate in f.work_predicates():
        out = out.filter(predicate)
    if f.excludes_music_and_adult:
        bad = resources.filter(F.col("resource_class").isin("music", "nsfw")).select(F.col("work_id").alias("id"))
        out = out.join(bad, "id", "left_anti")
    if f.query.strip():
        out = out.join(text_hits(works, resources, f.query), "id", "left_semi")
    matched = f.resource_predicate()
    if matched is not None:
        out = out.join(resources.filter(matched).select(F.col("work_id").alias("id")), "id", "left_semi")
    if f.availability == "missing":
        out = out.join(resources.select(F.col("work_id").alias("id")), "id", "left_anti")
    how = "inner" if f.availability == "available" or f.multi_source_only else "left"
    summary = child_summary(resources, matched).withColumnRenamed("work_id", "id")
    counts = [c for c in summary.columns if "count" in c]
    out = out.join(summary, "id", how)
    out = out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in counts})
    if f.multi_source_only:
        out = out.filter(F.col("source_count") > 1)
    return out.withColumn("work_year", effective_year(F.col("year"), F.col("release_date")))


def page_of(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page; the order must end in a unique column."""
    return df.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def page_after(df: DataFrame, order: list[Column], past_last_row: Column, size: int) -> DataFrame:
    """Next page by key: ``past_last_row`` says which rows follow the last one shown.

    Unlike an offset its cost does not grow with the page number.
    """
    return df.filter(past_last_row).orderBy(*order).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    """Total and page count (at least one), counted apart from the page itself."""
    return df.agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("bigint")
    )


def list_works(works: DataFrame, resources: DataFrame, candidates: DataFrame, f: WorkFilter) -> DataFrame:
    """One page of works with candidate counts and the best candidate of each; beyond the last page it is the last."""
    selected = select_works(works, resources, f)
    last = page_totals(selected, f.size).first()["pages"] if f.page > 1 else 1
    page = page_of(selected, SORTS[f.sort](), min(f.page, last), f.size)
    return with_candidates(page, candidates)


def with_candidates(page: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate count and leader for the page's works only (a page has at most 100 rows)."""
    keys = F.broadcast(page.select(F.col("id").alias("work_id")))
    mine = candidates.join(keys, "work_id", "left_semi")
    best = mine.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.min_by(F.struct(F.col("catalogue_id").alias("top_catalogue_id"), F.col("score").alias("top_score")),
                 F.struct(-F.col("score"), F.col("id"))).alias("_top"),
    )
    return (
        page.join(best, page.id == best.work_id, "left")
        .drop("work_id")
        .withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)).cast("bigint"))
        .select("*", "_top.*")
        .drop("_top")
    )


# --- joins ------------------------------------------------------------------------------------
def with_resources(works: DataFrame, resources: DataFrame) -> DataFrame:
    r = resources.withColumnRenamed("id", "resource_id")
    return works.join(r, works.id == r.work_id, "left").drop("work_id")


def base_view(resources: DataFrame, works: DataFrame, collections: DataFrame) -> DataFrame:
    """Resource with its work and, where there is one, its collection.

    Works meet collections first: most have none, and that null key is then no key of the many resources.
    """
    w = works.select(
        F.col("id").alias("work_id"), F.col("title").alias("work_title"), F.col("title_key").alias("work_title_key"),
        "status", "catalogue_id", "catalogue_title", "media_type", "resource_kind", "collection_id", "year", "release_date",
    )
    c = collections.select(F.col("id").alias("collection_id"), F.col("title").alias("collection_title"))
    return resources.join(w.join(c, "collection_id", "left"), "work_id")


def has_resource(works: DataFrame, resources: DataFrame) -> DataFrame:
    return works.join(resources.select(F.col("work_id").alias("id")), "id", "left_semi")


def without_classes(works: DataFrame, resources: DataFrame, classes: tuple[str, ...]) -> DataFrame:
    bad = resources.filter(F.col("resource_class").isin(*classes)).select(F.col("work_id").alias("id"))
    return works.join(bad, "id", "left_anti")


def latest_message(links: DataFrame, messages: DataFrame) -> DataFrame:
    """Newest message of every resource key, from one aggregate."""
    m = messages.select(F.col("id").alias("message_id"), "channel_name", "channel_username", "received_at")
    return latest_per_key(
        links.select("source_key", "message_id").join(m, "message_id"),
        ["source_key"],
        [F.col("received_at"), F.col("message_id")],
        ["message_id", "channel_name", "channel_username", "received_at"],
    )


def owned_links(links: DataFrame, resources: DataFrame) -> DataFrame:
    """Owner of a link: its own work, else the work of the resource with its key."""
    r = resources.select("source_key", F.col("work_id").alias("_resource_work"))
    return links.join(r, "source_key", "left").withColumn("owner_id", F.coalesce("work_id", "_resource_work")).drop("_resource_work")


# --- statistics -------------------------------------------------------------------------------
def library_stats(works: DataFrame, resources: DataFrame) -> DataFrame:
    """Conditional counts over works, with child existence as one pre-aggregated join."""
    flags = resources.groupBy(F.col("work_id").alias("id")).agg(
        F.bool_or(F.col("resource_class").isin("music", "nsfw")).alias("_excluded"), F.lit(True).alias("_has")
    )
    w = works.join(flags, "id", "left").withColumns({
        "_excluded": F.coalesce("_excluded", F.lit(False)), "_has": F.coalesce("_has", F.lit(False)),
    })
    base = ~F.col("is_metadata") & ~F.col("resource_kind").isin("person", "series")
    queue = base & ~F.col("_excluded")
    status, kind = F.col("status"), F.col("media_type")
    return w.agg(
        count_where(base).alias("total"),
        count_where(base & (status == "matched")).alias("matched"),
        count_where(queue & (status != "matched") & ~F.col("is_bundle")).alias("pending"),
        count_where(queue & (status == "review")).alias("review"),
        count_where(queue & (status == "not_found") & ~F.col("is_bundle")).alias("not_found"),
        count_where(queue & (status == "pending")).alias("unsearched"),
        count_where(queue & (status == "error")).alias("error"),
        *[count_where(base & (kind == k)).alias(n) for k, n in (("movie", "movies"), ("tv", "tv"), ("unknown", "unknown"))],
        count_where(base & F.col("_has")).alias("with_sources"),
        count_where(base & ~F.col("_has")).alias("without_sources"),
        count_where(F.col("is_metadata") & (F.col("resource_kind") == "media")).alias("metadata"),
    )


def source_stats(resources: DataFrame) -> DataFrame:
    return resources.agg(
        F.count(F.lit(1)).alias("total"),
        *[count_where(F.col("source_type") == s).alias(f"count_{s}") for s in rules.SOURCE_TYPES],
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"),
    )


def provider_breakdown(resources: DataFrame) -> DataFrame:
    return resources.groupBy(provider_id(F.col("source_type"), F.col("provider")).alias("provider_id")).agg(
        F.count(F.lit(1)).alias("n")
    )


def multi_source_works(resources: DataFrame) -> DataFrame:
    return resources.groupBy("work_id").agg(F.count(F.lit(1)).alias("source_count")).filter(F.col("source_count") > 1)


def provider_counts(resources: DataFrame) -> DataFrame:
    """Per work and provider, plus a total row per work whose provider is null."""
    shaped = resources.select("work_id", provider_id(F.col("source_type"), F.col("provider")).alias("provider_id"))
    return (
        shaped.groupingSets([["work_id", "provider_id"], ["work_id"]], "work_id", "provider_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def facet_years(works: DataFrame) -> DataFrame:
    year = effective_year(F.col("year"), F.col("release_date"))
    return works.select(year.alias("year")).filter(F.col("year").isNotNull()).distinct()


def facet_genres(works: DataFrame) -> DataFrame:
    one = F.explode(jsonx.object_array(F.col("genres"), GENRE_FIELDS)).alias("g")
    named = works.select(one).filter(F.col("g.id").isNotNull() & F.col("g.name").isNotNull())
    return named.groupBy(F.col("g.id").alias("genre_id")).agg(F.max("g.name").alias("name"))


def facet_countries(works: DataFrame) -> DataFrame:
    code = F.explode(jsonx.string_array(F.col("countries"))).alias("code")
    return works.select(code).filter(F.col("code").rlike("^[A-Za-z]{2}$")).select(F.upper("code").alias("code")).distinct()


def decades(works: DataFrame) -> DataFrame:
    return facet_years(works).select((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade")).distinct()


def queue_order() -> list[Column]:
    """Pending, error, review, then the rest; oldest id first."""
    rank = F.when(F.col("status") == "pending", 0).when(F.col("status") == "error", 1).when(
        F.col("status") == "review", 2
    ).otherwise(3)
    return [rank.asc(), F.asc("id")]


def match_queue(works: DataFrame, resources: DataFrame, limit: int, collections_only: bool = False) -> DataFrame:
    """Next works to match: unmatched, ordinary, no music or adult child."""
    if not 1 <= limit <= 5000:
        raise ValueError("limit must be 1 to 5000")
    open_ = works.filter(
        (F.col("status") != "matched") & ~F.col("resource_kind").isin("person", "series")
        & ~F.col("is_bundle") & ~F.col("is_metadata")
    )
    if collections_only:
        open_ = open_.filter(F.col("collection_id").isNotNull())
    return without_classes(open_, resources, ("music", "nsfw")).orderBy(*queue_order()).limit(limit)


# --- details ----------------------------------------------------------------------------------
def export_work(works: DataFrame, resources: DataFrame) -> DataFrame:
    """Rows of the export: one per work and resource, works without resources included."""
    return with_resources(works, resources)


def work_summary(works: DataFrame, resources: DataFrame, candidates: DataFrame, links: DataFrame) -> DataFrame:
    """Detail head of every work: child aggregates, candidate count, distinct messages."""
    c = candidates.groupBy(F.col("work_id").alias("id")).agg(
        F.count(F.lit(1)).alias("candidates"), F.max("score").alias("best_score")
    )
    owned = owned_links(links, resources)
    m = owned.filter(F.col("owner_id").isNotNull()).groupBy(F.col("owner_id").alias("id")).agg(
        F.count_distinct("message_id").alias("messages")
    )
    out = works.join(child_summary(resources).withColumnRenamed("work_id", "id"), "id", "left").join(c, "id", "left").join(m, "id", "left")
    counts = ["source_count", "matched_source_count", *[f"count_{s}" for s in rules.SOURCE_TYPES], "episode_count", "candidates", "messages"]
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in counts})


def best_candidates(candidates: DataFrame, k: int = 12) -> DataFrame:
    return top_per_key(candidates, ["work_id"], [F.desc("score"), F.asc("id")], k)


def collection_list(collections: DataFrame, works: DataFrame) -> DataFrame:
    """Members, matched members, year span and one poster (matched first, then id)."""
    year = effective_year(F.col("year"), F.col("release_date"))
    per = works.filter(F.col("collection_id").isNotNull()).groupBy("collection_id").agg(
        F.count(F.lit(1)).alias("members"),
        count_where(F.col("status") == "matched").alias("matched"),
        F.min(year).alias("first_year"), F.max(year).alias("last_year"),
        F.min_by("poster", F.when(F.col("poster").isNotNull(), F.struct(F.col("status") != "matched", F.col("id")))).alias("poster"),
    )
    c = collections.select(F.col("id").alias("collection_id"), "title")
    return c.join(per, "collection_id", "left").withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in ("members", "matched")}
    )


def collection_members(collections: DataFrame, works: DataFrame, resources: DataFrame) -> DataFrame:
    """Members of collections with child count and the first child's label."""
    per = resources.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("source_count"), F.min_by("raw_label", "id").alias("sample_label")
    )
    w = works.filter(F.col("collection_id").isNotNull()).select(
        F.col("id").alias("work_id"), "collection_id", "title", effective_year(F.col("year"), F.col("release_date")).alias("year")
    )
    c = collections.select(F.col("id").alias("collection_id"), F.col("title").alias("collection_title"))
    return c.join(w, "collection_id").join(per, "work_id", "left").withColumn(
        "source_count", F.coalesce("source_count", F.lit(0)).cast("bigint")
    )


