"""Channel-style headings to typed attributes, as chained native columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import (
    clean_person_name, cjk_number, cut_at_first, cut_unclosed, drop_icons, first_int, first_line, first_match, is_search_title, let,
    number_or_cjk, or_else, settled, staged, strip_chars, strip_trailing_date,
)
from .extract import labelled_fields

MAX_TOTAL = 2000


def drop_release_group(text: Column) -> Column:
    """Skip a leading release-group bracket; the next bracket, or the rest, is the title."""

    def bare(body: Column) -> Column:
        group = F.regexp_extract(body, r"^[\[【]([^\]】]*)[\]】]", 1)
        rest = F.ltrim(F.regexp_replace(body, r"^[\[【][^\]】]*[\]】]\s*", ""))
        named = F.trim(F.regexp_extract(rest, r"^[\[【]([^\]】]*)(?:[\]】]|$)", 1))
        title = or_else(named, F.trim(F.regexp_replace(rest, r"^[\[【 ]+", "")))
        return F.when(group.rlike(rules.RELEASE_GROUP_WORDS) & (rest != ""), title)

    return let(text, lambda t: F.coalesce(let(F.ltrim(t), bare), t))


def has_collection_marker(text: Column) -> Column:
    """A collection's marker; texts with no sign of any are not looked at further."""
    said = F.coalesce(text, F.lit(""))
    return said.rlike(rules.COLLECTION_HINT) & said.rlike(rules.COLLECTION)


def strip_collection_marker(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rules.STRIP_COLLECTION, ""))


def infer_type(title: Column, extra: Column) -> Column:
    """tv or movie by structure words; both or neither is unknown; synopsis lines are not read."""
    kept = F.regexp_replace(extra, f"(?m){rules.SYNOPSIS_LINE}.*$", "")
    text = F.concat_ws(" ", title, kept)
    tv, movie = text.rlike(rules.TV_TEXT), text.rlike(rules.MOVIE_TEXT)
    return F.when(tv & ~movie, "tv").when(movie & ~tv, "movie").otherwise("unknown")


def technical_tags(df: DataFrame, text: str, out: str, tag_rules=rules.TECHNICAL_TAGS) -> DataFrame:
    """``df`` with the ordered distinct technical labels found in a text, column by column: each text is tested for all at once first."""

    def tag(label, pattern):
        shown = F.concat(F.lit(label), F.regexp_extract(text, pattern, 1)) if label in rules.TAGS_WITH_CHANNELS else F.lit(label)
        return F.when(F.col(text).rlike(pattern), shown)

    any_of = "|".join(f"(?:{pattern})" for _, pattern in tag_rules)
    none = F.array().cast("array<string>")
    found = F.when(F.col(text).rlike(any_of), F.array_compact(F.array(*[tag(*rule) for rule in tag_rules])))
    df = df.withColumn(out, F.array_distinct(F.coalesce(found, none)))
    for implied, by in rules.TAG_IMPLIED_BY.items():
        df = df.withColumn(out, F.when(F.array_contains(out, by), F.array_remove(out, implied)).otherwise(F.col(out)))
    return df


def hdr_tags(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(label)) for label, p in rules.HDR_TAGS]))
    return F.nullif(F.array_join(found, " + "), F.lit(""))


def audio_label(text: Column) -> Column:
    kind = F.upper(F.regexp_extract(text, rules.AUDIO, 1))
    major, minor = F.regexp_extract(text, rules.AUDIO, 2), F.regexp_extract(text, rules.AUDIO, 3)
    label = F.concat(
        F.when(kind == "TRUEHD", "TrueHD").otherwise(kind), major,
        F.when((major != "") & (minor != ""), F.concat(F.lit("."), minor)).otherwise(""),
        F.when(F.regexp_extract(text, rules.AUDIO, 4) != "", ".Atmos").otherwise(""),
    )
    return F.when(kind != "", label)


def codec_label(text: Column) -> Column:
    return F.replace(F.upper(first_match(text, rules.CODEC)), F.lit("_"), F.lit("."))


def quality_label(text: Column, tags: Column) -> Column:
    """Stated resolution, else what the carrier implies."""
    out = F.upper(first_match(text, rules.QUALITY))
    for quality, carriers in rules.QUALITY_FROM_TAGS:
        out = F.coalesce(out, F.when(F.arrays_overlap(tags, F.array(*[F.lit(c) for c in carriers])), F.lit(quality)))
    return out


_CUTS = (
    rules.EPISODE, rules.QUALITY, rules.TECHNICAL, rules.NOISE, rules.SEASON_TOTAL, rules.SEASON_SPAN, rules.SEASON_SINGLE, rules.SEASON_CN,
    rules.EPISODE_SPAN_CN, rules.EPISODE_TOTAL, rules.EPISODE_PROGRESS,
)


def heading_title(h: Column, kind: Column) -> Column:
    """Title part of a heading: text before the first structural mark, then cleaned."""
    # A bracketed year outranks a free-standing one, and progress outranks a single episode.
    bracketed, progress = h.rlike(rules.BRACKETED_YEAR), h.rlike(rules.EPISODE_PROGRESS)
    # most headings have no sign of a collection, and its many forms are not tried at each of their places
    signed = h.rlike(rules.COLLECTION_HINT)
    cut_at = lambda *first: F.when(signed, cut_at_first(h, [*first, *_CUTS, rules.COLLECTION])).otherwise(cut_at_first(h, [*first, *_CUTS]))
    cut = (
        F.when(bracketed & progress, cut_at(rules.BRACKETED_YEAR))
        .when(bracketed, cut_at(rules.BRACKETED_YEAR, rules.EPISODE_SINGLE))
        .when(progress, cut_at(rules.YEAR))
        .otherwise(cut_at(rules.YEAR, rules.EPISODE_SINGLE))
    )
    edge = rules.EDGE + rules.BRACKETS + "✨"
    unnamed = F.lit(rules.PLACEHOLDER_TITLE)
    title = staged(
        cut,
        lambda t: or_else(strip_chars(drop_release_group(t), edge), unnamed),
        lambda t: or_else(strip_chars(first_line(t), edge), unnamed),
        lambda t: or_else(F.trim(F.regexp_replace(t, rules.CATEGORY_PREFIX, "")), unnamed),
        lambda t: or_else(strip_collection_marker(t), t),
        lambda t: or_else(F.trim(F.regexp_replace(t, "^《(.+)》$", "$1")), t),
        lambda t: or_else(F.trim(cut_unclosed(t)), t),
    )
    return let(title, lambda t: F.when(kind == "person", or_else(clean_person_name(t), t)).otherwise(t))


def episode_info(df: DataFrame, h: str) -> DataFrame:
    """Season, episode and range columns of the heading in column ``h``."""
    # most headings have no mark of a number of either kind, and are not looked at further
    df = df.withColumn("_t", F.when(F.col(h).rlike(rules.EPISODE_HINT), F.col(h)))
    t = F.col("_t")
    df = df.withColumns({"_sc_t": first_match(t, rules.SEASON_CN), "_own_t": first_match(t, rules.PROGRESS_OWNER)})
    i = {
        "_ep_s": first_int(t, rules.EPISODE, 1), "_ep_e": first_int(t, rules.EPISODE, 2),
        "_er_a": first_int(t, rules.EPISODE_RANGE, 1), "_er_b": first_int(t, rules.EPISODE_RANGE, 2),
        "_sr_a": first_int(t, rules.SEASON_RANGE, 1), "_sr_b": first_int(t, rules.SEASON_RANGE, 2),
        "_s": first_int(t, rules.SEASON), "_st": first_int(t, rules.SEASON_TOTAL),
        "_ss_a": first_int(t, rules.SEASON_SPAN, 1), "_ss_b": first_int(t, rules.SEASON_SPAN, 2),
        "_s1": first_int(t, rules.SEASON_SINGLE), "_sc": cjk_number(F.col("_sc_t")),
        "_es_a": first_int(t, rules.EPISODE_SPAN_CN, 1), "_es_b": first_int(t, rules.EPISODE_SPAN_CN, 2),
        "_et": first_int(t, rules.EPISODE_TOTAL), "_up": first_int(t, rules.EPISODE_PROGRESS),
        "_owner": number_or_cjk(F.col("_own_t")),
    }
    df = df.withColumns(i)
    df = df.withColumn("_e1", F.when(F.col("_up").isNull(), first_int(t, rules.EPISODE_SINGLE)))
    marked = F.coalesce("_ep_s", "_sr_a", "_s")
    season = (
        F.when(marked.isNotNull(), marked)
        .when(F.col("_ss_a").isNotNull(), F.col("_ss_a"))
        .when(F.col("_st").isNotNull(), F.lit(1))
        .when(F.col("_s1").isNotNull(), F.col("_s1"))
        .when(F.col("_sc").isNotNull(), F.col("_sc"))
        .when(F.col("_er_a").isNotNull(), F.lit(1))
    )
    season_end = (
        F.when(marked.isNotNull(), F.col("_sr_b"))
        .when(F.col("_ss_a").isNotNull(), F.col("_ss_b"))
        .when(F.col("_st") > 1, F.col("_st"))
    )
    df = df.withColumn("_season", season).withColumn("_season_end", season_end)
    explicit = F.coalesce("_ep_e", "_er_a", "_es_a", "_e1").isNotNull()
    target = F.coalesce(F.col("_season"), F.col("_owner"), F.lit(1))
    progress = F.col("_up").isNotNull() & F.col("_es_a").isNull() & F.col("_et").isNull()
    foreign = progress & F.col("_owner").isNotNull() & (F.col("_owner") != target)
    def span(a, b):
        return F.struct(a.alias("first"), b.alias("last"))

    found = (
        F.when(F.col("_er_a").isNotNull(), span(F.col("_er_a"), F.col("_er_b")))
        .when(progress, F.when(~foreign & (F.col("_up") > 1), span(F.lit(1), F.col("_up"))))
        .when(F.col("_es_a").isNotNull(), F.when(F.col("_es_b") > F.col("_es_a"), span(F.col("_es_a"), F.col("_es_b"))))
        .when(F.col("_e1").isNotNull(), F.lit(None).cast("struct<first:int,last:int>"))
        .when((F.col("_et") > 1) & ~explicit, span(F.lit(1), F.col("_et")))
    )
    df = df.withColumns({
        "_range": found,
        "_latest": F.when(foreign, F.struct(F.col("_owner").alias("season"), F.col("_up").alias("episode"))),
        "_single": F.when(F.col("_er_a").isNull() & ~progress & F.col("_es_a").isNull(), F.col("_e1")),
        "_total": F.when(explicit & (F.col("_et") > 1) & (F.col("_et") <= MAX_TOTAL), F.col("_et")),
    })
    from_range = F.when(F.col("_ep_e").isNull() & F.col("_er_a").isNull(), F.col("_range")["first"])
    episode = F.coalesce(F.col("_single"), from_range, F.col("_ep_e"), F.col("_er_a"))
    df = df.withColumns({
        "_episode": episode,
        "_season": F.coalesce("_season", F.when(progress & ~foreign & (F.col("_up") > 1), target), F.when(F.coalesce(F.col("_single"), from_range).isNotNull(), F.lit(1))),
    })
    # Last resort: a bare number range right behind the year.
    after = f"(?:{rules.BRACKETED_YEAR})"
    df = df.withColumn("_span_t", F.when(F.col("_episode").isNull() & t.rlike(rules.BARE_HINT), t)).withColumn("_bracketed", F.col("_span_t").rlike(rules.BRACKETED_YEAR))
    behind = lambda group: F.when(
        F.col("_bracketed"), F.regexp_extract("_span_t", after + rules.BARE_SPAN, group)
    ).otherwise(F.regexp_extract("_span_t", rules.FIRST_YEAR + rules.BARE_SPAN, group)).try_cast("int")
    df = df.withColumns({"_a": behind(2), "_b": behind(3)})
    a, b = F.col("_a"), F.col("_b")
    bare = a.isNotNull() & F.col("_episode").isNull() & F.col("_range").isNull() & F.col("_latest").isNull() & (a >= 1) & (b > a) & (b <= MAX_TOTAL)
    return df.withColumns({
        "episode_range": F.when(bare, span(a, b)).otherwise(F.col("_range")),
        "episode": F.when(bare, a).otherwise(F.col("_episode")),
        "season": F.when(bare, F.coalesce("_season", F.lit(1))).otherwise(F.col("_season")),
        "season_end": F.when(F.col("_season_end") > F.coalesce("_season", F.lit(0)), F.col("_season_end")),
        "episode_total": F.col("_total"), "latest_episode": F.col("_latest"),
    }).drop(*i, "_t", "_sc_t", "_own_t", "_span_t", "_bracketed", "_a", "_b", "_e1", "_season", "_season_end", "_range", "_latest", "_single", "_total", "_episode")


def parse_headings(df: DataFrame, column: str) -> DataFrame:
    """Add the typed attributes of the heading block in ``column`` to every row."""
    raw = F.regexp_replace(column, "^[﻿ \t]+", "")
    icon = F.regexp_extract(raw, rules.HEADING_ICON, 1)
    body = drop_icons(raw)
    labelled = let(body, lambda b: or_else(F.trim(F.regexp_replace(b, rules.LABEL_PREFIX, "")), b))
    out = df.withColumns({
        "resource_kind": F.when(icon == "👤", "person").when(icon == "🗂", "series").otherwise("media"),
        "_h": strip_trailing_date(labelled),
    })
    h, kind = F.col("_h"), F.col("resource_kind")
    out = episode_info(out.withColumn("title", heading_title(h, kind)), "_h")
    tech = F.regexp_extract(h, f"(?s)({rules.TECHNICAL}.*)", 1)
    media_info = F.nullif(strip_chars(first_line(tech), r" \t✨"), F.lit(""))
    out = out.withColumns({
        "year": F.when(kind != "person", F.coalesce(first_int(h, rules.BRACKETED_YEAR), first_int(h, rules.YEAR))),
        "is_collection": has_collection_marker(h),
        "media_info": media_info,
        "codec": codec_label(h), "hdr": hdr_tags(h), "audio": audio_label(h),
        "channel_fields": labelled_fields(F.col(column)),
    })
    out = technical_tags(out.withColumn("_marked", F.concat_ws(" ", h, "media_info")), "_marked", "quality_tags").drop("_marked")
    numbered = F.col("season").isNotNull() | F.col("episode").isNotNull()
    kind_type = F.when(kind != "media", "unknown").when(numbered, "tv").otherwise(infer_type(F.col("title"), h))
    out = out.withColumn("media_type", kind_type).withColumn("quality", quality_label(h, F.col("quality_tags")))
    return out.withColumn("season", F.coalesce("season", F.when(F.col("media_type") == "tv", F.lit(1)))).drop("_h")


def plain_body(text: Column) -> Column:
    """A one-line heading without icon, edges and trailing date."""
    body = strip_chars(drop_icons(F.regexp_replace(text, "^﻿+", "")), rules.EDGE)
    return strip_chars(F.regexp_replace(body, rules.TRAILING_DATE, ""), rules.EDGE)


def title_and_year(body: Column) -> tuple[Column, Column]:
    """Plain one-line form: text before the bracketed year, and that year, of a ``plain_body``, which is best a column of its own."""
    tail = first_int(body, rules.BRACKETED_YEAR + r"\s*$")
    year = F.coalesce(tail, first_int(body, rules.BRACKETED_YEAR))
    cut = F.when(tail.isNotNull(), F.regexp_replace(body, rules.BRACKETED_YEAR + r"\s*$", "")).otherwise(cut_at_first(body, [rules.BRACKETED_YEAR]))
    return or_else(F.regexp_replace(cut, f"[{rules.EDGE}]+$", ""), F.lit(rules.PLACEHOLDER_TITLE)), year


def strip_search_noise(text: Column, episodic: Column) -> Column:
    """Base title without progress, episode and quality tails, however many; null when nothing usable changes."""
    edge = rules.EDGE + rules.BRACKETS

    def without(pattern: str):
        return lambda t: or_else(strip_chars(F.regexp_replace(t, pattern, ""), edge), t)

    # a round that changes more than edges takes a digit or one of these words away
    rounds = F.regexp_count(text, F.lit(rules.NOISE_PIECE)) + 2
    base = settled(F.trim(text), lambda t: staged(t, *[without(p) for p in rules.NOISE_TAILS]), rounds)

    def without_number(t: Column) -> Column:
        number = first_int(t, r"\s*(\d{1,4})\s*$")
        head = strip_chars(F.regexp_replace(t, r"\s*\d{1,4}\s*$", ""), edge)
        return let(head, lambda h: F.when((F.length(h) >= 2) & number.isNotNull() & (episodic | (number >= 10)), h).otherwise(t))

    out = let(base, without_number)
    return F.when((out != F.trim(text)) & (F.length(out) >= 2) & is_search_title(out), out)


def split_episode_suffix(title: Column) -> Column:
    """Struct(base, episode) of a title with a glued episode number, else null."""
    text = strip_chars(title, rules.EDGE)
    least, most = rules.EPISODE_SUFFIX_RANGE
    episode = first_int(text, r"^.+?(\d{1,4})$")
    base = strip_chars(F.regexp_extract(text, r"^(.+?)\d{1,4}$", 1), rules.EDGE)
    barred = text.rlike(r"\+|更新至|更至|全|共") | text.rlike(
        r"(?iU)(?:S\d{1,2}\s*E\d{1,3}|EP\s*\d+|\bE\d{1,3}\b|第\s*\d+\s*[集话季])"
    ) | text.rlike(r"\d{1,4}\s*[-~至到]\s*\d{1,4}")
    fine = (
        ~barred & episode.between(least, most) & (F.length(base) >= 2) & base.rlike("[㐀-鿿]") & ~base.rlike("电影|剧场版")
    )
    return F.when(fine, F.struct(base.alias("base"), episode.alias("episode")))
