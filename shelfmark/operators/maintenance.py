"""Maintenance of stored works: what speaks for their type, titles that end in an episode, auxiliary packs, classes.

Each job returns a change set; nothing is written here. What speaks for a work is aggregated over its resources before it
is judged, so the size of a work does not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import first_line, title_key
from ..session import written
from .evidence import decisions, scored_candidates
from .fallbacks import applied_links
from .headings import has_collection_marker, split_episode_suffix
from .resources import infer_class

# The greatest number that is an episode, not a date, and the score that a film has to have to make a series one.
LAST_EPISODE = 9_999
LEGACY_SCORE = 0.90


def _said(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def type_evidence(works: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, title, current_type, type, confidence, source, reasons) of each work.

    ``works`` (id, title, media_type, status, resource_kind, is_bundle, is_metadata); ``resources`` (work_id, season,
    season_end, episode, raw_label, filename, context). Matched works have their catalogue's type, works of persons and
    series, bundles and auxiliary packs none. Numbers beyond a first season, and words, speak for a series or a film; both
    is a conflict. A bare first season, an icon or a date for an episode is weak. Audio says nothing. Reasons are distinct and in
    alphabetical order.
    """
    heads = {"_h0": first_line(F.col("context")), "_h1": F.trim(first_line(F.col("raw_label"))), "_h2": F.trim(first_line(F.col("filename")))}
    r = resources.withColumns(heads)
    number = F.col("episode").between(1, LAST_EPISODE)
    told = lambda name, c: F.concat(F.lit(f"{name}:"), c.cast("string"))
    # each head is a column: patterns are not tried in functions of rows
    words = lambda name, pattern, sign: [F.when(F.col(h).rlike(sign) & F.col(h).rlike(pattern), F.concat(F.lit(f"{name}:"), F.trim(F.regexp_extract(h, f"({pattern})", 1)))) for h in heads]
    tv = _said(
        F.when(number, told("episode", F.col("episode"))), F.when(F.col("season_end").isNotNull(), told("season_end", F.col("season_end"))), F.when(F.col("season_end").isNull() & (F.col("season") > 1), told("season", F.col("season"))),
        *words("tv_text", rules.STRONG_TV_TEXT, rules.STRONG_TV_SIGN),
    )
    icon = reduce(lambda a, b: a | b, [F.coalesce(F.col(h).rlike(rules.TYPE_ICON), F.lit(False)) for h in heads])
    weak = _said(
        F.when(F.col("episode").isNotNull() & ~number, told("episode_date", F.col("episode"))), F.when(F.col("season_end").isNull() & (F.col("season") == 1), F.lit("season:1")),
        F.when(icon, F.lit("icon_only")),
    )
    audio = F.when(F.concat_ws(" ", *heads).rlike(rules.AUDIO_FILE_END), F.array(F.lit("audio_file")))
    kinds = {"_tv": tv, "_movie": _said(*words("movie_text", rules.MOVIE_TEXT, "[电剧]")), "_weak": weak, "_audio": audio}
    said = r.select("work_id", *[c.alias(k) for k, c in kinds.items()])
    # the lists of a work are put together as they are; each resource stays one row
    each = said.groupBy("work_id").agg(*[F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.size(k) > 0, F.col(k)))))).alias(k) for k in kinds])
    none = F.array().cast("array<string>")
    known = works.join(each, works.id == each.work_id, "left").withColumns({f"_{k}": F.coalesce(f"_{k}", none) for k in ("tv", "movie", "weak", "audio")})
    has = lambda k: F.size(f"_{k}") > 0

    def verdict(kind, confidence: str, source, reasons) -> Column:
        return F.struct(kind.alias("type"), F.lit(confidence).alias("confidence"), source.alias("source"), reasons.alias("reasons"))

    unknown, word = F.lit("unknown"), lambda w: F.array(F.lit(w))
    numbered = F.exists("_tv", lambda v: v.startswith("episode") | v.startswith("season"))
    drama = F.coalesce(F.col("title").rlike(rules.AUDIO_DRAMA), F.lit(False))
    judged = (
        F.when(F.col("status") == "matched", verdict(F.col("media_type"), "tmdb", F.lit("tmdb"), word("tmdb_match")))
        .when(F.col("resource_kind") != "media", verdict(unknown, "excluded", F.lit("resource_kind"), word("non_media_resource")))
        .when(F.col("is_bundle"), verdict(unknown, "excluded", F.lit("resource_kind"), word("bundle")))
        .when(F.col("is_metadata"), verdict(unknown, "excluded", F.lit("resource_kind"), word("metadata_pack")))
        .when(drama, verdict(unknown, "weak", F.lit("none"), F.concat("_weak", word("audio_drama"))))
        .when(has("audio"), verdict(unknown, "weak", F.lit("none"), F.concat("_weak", "_audio")))
        .when(has("tv") & has("movie"), verdict(unknown, "conflict", F.lit("conflict"), F.concat("_tv", "_movie")))
        .when(has("tv"), verdict(F.lit("tv"), "strong", F.when(numbered, "fields").otherwise("heading"), F.col("_tv")))
        .when(has("movie"), verdict(F.lit("movie"), "strong", F.lit("heading"), F.col("_movie")))
        .when(has("weak"), verdict(unknown, "weak", F.when(F.array_contains("_weak", "icon_only"), "icon").otherwise("season"), F.col("_weak")))
        .otherwise(verdict(unknown, "none", F.lit("none"), none))
    )
    return known.withColumn("_v", judged).select("id", "title", F.col("media_type").alias("current_type"), "_v.*")


def strong_type_changes(evidence: DataFrame, resources: DataFrame) -> dict[str, DataFrame]:
    """``works`` (id, media_type, reasons) whose type strong evidence of one side changes, ``resources`` (id, work_id) whose numbers go.

    Titles of collections, a bare number as a series and a mixed title as a film change nothing. A film's resources lose
    season and episode, which were made up.
    """
    unsafe = F.col("title").rlike(rules.UNSAFE_TYPE_TITLE) | ((F.col("type") == "tv") & F.col("title").rlike(r"^\s*\d{1,4}\s*$")) | ((F.col("type") == "movie") & F.col("title").rlike("[＋+]"))
    changed = evidence.filter((F.col("confidence") == "strong") & (F.col("type") != F.col("current_type")) & ~F.coalesce(unsafe, F.lit(False)))
    changed = written(changed.select("id", "type", "reasons"), "type_changes")  # read for the works and for their resources
    films = changed.filter(F.col("type") == "movie").select(F.col("id").alias("work_id"))
    numbered = F.col("season").isNotNull() | F.col("season_end").isNotNull() | F.col("episode").isNotNull()
    return {"works": changed.select("id", F.col("type").alias("media_type"), "reasons"), "resources": resources.filter(numbered).join(films, "work_id", "left_semi").select("id", "work_id")}


def episode_suffixes(works: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, title, title_key, episode, year) of open works whose title is another series' and an episode behind it.

    The base has to be a matched series' title, or that of a series among the works with such suffixes of it. The year is the
    one of the matched series of that title, if they agree, else that of the only one whose episodes hold this one; null
    if there is none. ``works`` (id, title, media_type, status, year, resource_kind, is_bundle, is_metadata),
    ``resources`` (work_id, episode).
    """
    plain = works.filter(~F.col("is_bundle") & ~F.col("is_metadata") & (F.col("resource_kind") == "media"))
    cut = plain.withColumn("_cut", split_episode_suffix(F.col("title"))).filter(F.col("_cut").isNotNull()).select("id", "media_type", "status", "_cut.base", "_cut.episode")
    series = plain.filter((F.col("media_type") == "tv") & (F.col("status") == "matched"))
    among = cut.filter(F.col("media_type") == "tv").select("base")
    bases = series.select(F.col("title").alias("base")).union(among).distinct()
    years = series.filter(F.col("year").isNotNull()).groupBy(F.col("title").alias("base")).agg(F.min("year").alias("_low"), F.max("year").alias("_high"))
    spans = resources.filter(F.col("episode").isNotNull()).groupBy("work_id").agg(F.min("episode").alias("_first"), F.max("episode").alias("_last"))
    covers = series.filter(F.col("year").isNotNull()).join(spans, series.id == spans.work_id).select(F.col("title").alias("base"), "year", "_first", "_last").distinct()
    open_ = cut.filter((F.col("status") != "matched") & F.col("media_type").isin("tv", "unknown")).join(bases, "base", "left_semi")
    held = open_.join(covers, "base").filter(F.col("episode").between(F.col("_first"), F.col("_last"))).groupBy("id").agg(F.min("year").alias("_a"), F.max("year").alias("_b"))
    joined = open_.join(years, "base", "left").join(held, "id", "left")
    year = F.coalesce(F.when(F.col("_low") == F.col("_high"), F.col("_low")), F.when(F.col("_a") == F.col("_b"), F.col("_a")))
    return joined.select("id", F.col("base").alias("title"), title_key(F.col("base")).alias("title_key"), "episode", year.alias("year"))


def metadata_flag_changes(works: DataFrame, packs: DataFrame) -> DataFrame:
    """(id, is_metadata, reason, reopened) of works whose flag or reason changes.

    ``packs`` (work_id, is_metadata, reason) as ``resources.metadata_packs`` gives them; works without files are none, and
    neither are matched ones, persons and series. A work that was one and is none any more is open again.
    """
    now = packs.select("work_id", F.col("is_metadata").alias("_is"), F.col("reason").alias("_why"))
    joined = works.join(now, works.id == now.work_id, "left")
    is_ = F.coalesce("_is", F.lit(False)) & (F.col("resource_kind") == "media") & (F.col("status") != "matched")
    judged = joined.withColumn("_now", is_).withColumn("_why", F.when(F.col("_now"), F.col("_why")))
    changed = judged.filter((F.col("_now") != F.col("is_metadata")) | ~F.col("_why").eqNullSafe(F.col("metadata_reason")))
    return changed.select("id", F.col("_now").alias("is_metadata"), F.col("_why").alias("reason"), (F.col("is_metadata") & ~F.col("_now") & (F.col("status") != "matched")).alias("reopened"))


def collection_classes(resources: DataFrame, works: DataFrame) -> DataFrame:
    """(id, resource_class) of resources that become a collection's or music, or are a collection's no more.

    Persons keep theirs. Music wins, by the resource's or the work's title; then works that are series, bundles or have a
    collection's title; else the class that the resource itself shows. ``resources`` (id, work_id, resource_class, kind,
    raw_label, filename), ``works`` (id, title, media_type, resource_kind, is_bundle).
    """
    titled = works.withColumns({"_marked": has_collection_marker(F.col("title")), "_sounds": infer_class(F.lit(None).cast("string"), F.col("title"), F.col("media_type"), F.lit(None).cast("string")) == "music"})
    own = titled.select(F.col("id").alias("work_id"), "media_type", F.col("resource_kind").alias("_kind"), "is_bundle", "_marked", "_sounds")
    joined = resources.filter(F.col("resource_class") != "person").join(own, "work_id").withColumn("_kind", F.coalesce("kind", "_kind"))
    joined = joined.withColumn("_shown", infer_class(F.col("_kind"), F.col("raw_label"), F.col("media_type"), F.col("filename")))
    # a declared person or series is no music by the work's title
    of_work = F.col("_sounds") & ~F.coalesce(F.col("_kind").isin("person", "series"), F.lit(False))
    whole = (F.col("_kind") == "series") | F.col("_marked") | F.col("is_bundle")
    target = F.when((F.col("_shown") == "music") | of_work, "music").when(whole, "collection").otherwise(F.col("_shown"))
    return joined.withColumn("_target", target).filter(
        (F.col("_target") != F.col("resource_class")) & (F.col("_target").isin("collection", "music") | (F.col("resource_class") == "collection"))
    ).select("id", F.col("_target").alias("resource_class"))


def legacy_films(works: DataFrame, candidates: DataFrame, evidence: DataFrame, resources: DataFrame) -> dict[str, DataFrame]:
    """``works`` (id, media_type) of open series that are films, ``resources`` (id) whose made-up numbers go.

    The best candidate (by score, then the least id) has to be a film with an exact title that nothing speaks against, and
    nothing strong may speak for a series. ``candidates``: id, work_id, media_type, score, exact, blocked.
    """
    top = candidates.groupBy("work_id").agg(F.max("score").alias("score")).join(candidates, ["work_id", "score"]).groupBy("work_id", "score").agg(
        F.min_by(F.struct(F.col("media_type").alias("kind"), "exact", "blocked"), "id").alias("_c")
    ).filter((F.col("score") >= LEGACY_SCORE) & (F.col("_c.kind") == "movie") & F.col("_c.exact") & ~F.col("_c.blocked"))
    open_ = works.filter((F.col("media_type") == "tv") & (F.col("status") != "matched") & (F.col("resource_kind") == "media") & ~F.col("is_bundle") & ~F.col("is_metadata")).select("id")
    series = evidence.filter((F.col("type") == "tv") & (F.col("confidence") == "strong")).select("id")
    films = open_.join(top.select(F.col("work_id").alias("id")), "id", "left_semi").join(series, "id", "left_anti")
    numbered = F.col("season").isNotNull() | F.col("season_end").isNotNull() | F.col("episode").isNotNull()
    return {"works": films.withColumn("media_type", F.lit("movie")), "resources": resources.filter(numbered).join(films.select(F.col("id").alias("work_id")), "work_id", "left_semi").select("id")}


def rescored(candidates: DataFrame, changed: DataFrame, works: DataFrame, titles: DataFrame, resource_titles: DataFrame) -> DataFrame:
    """Stored candidates of works whose type has changed (``changed``: id), with flags and scores by the works as they are now."""
    again = candidates.join(changed.select(F.col("id").alias("work_id")), "work_id", "left_semi").select(*candidates.columns)
    return scored_candidates(again, works, titles, resource_titles)


def links_from_stored(scored: DataFrame, sequel: Column, works: DataFrame, resources: DataFrame, candidates: DataFrame, catalogue: DataFrame, fields: list[str]) -> dict[str, DataFrame]:
    """The change set of open works whose stored candidates decide: those of ``decisions`` that link, applied (``applied_links``)."""
    chosen = decisions(scored, sequel).filter(F.col("decision") == "link").select("work_id", "catalogue_id", F.col("leader").alias("confidence"))
    kinds = scored.groupBy("work_id", "catalogue_id").agg(F.max_by("media_type", "score").alias("media_type"))
    decided = chosen.join(kinds, ["work_id", "catalogue_id"]).withColumn("method", F.lit("stored_candidates"))
    open_ = works.filter(F.col("catalogue_id").isNull()).select(F.col("id").alias("work_id"))
    return applied_links(decided.join(open_, "work_id", "left_semi"), works, resources, candidates, catalogue, fields)
