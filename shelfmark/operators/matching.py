"""Evidence, admissibility and disambiguation of candidates; guarded changes of works and resources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import clean_person_name, first_int, let, title_key, trim_unbalanced
from ..functions.urls import share_identity
from .resolve import EXACT_SCORE

# The second score's weights, its floor, and what a refuted rival keeps at most.
SIMPLE_WEIGHT, SAME_YEAR, NEAR_YEAR, FAR_YEAR, NO_YEAR, SIMPLE_FLOOR = 0.72, 0.20, 0.04, -0.08, 0.05, 0.45
REFUTED_SCORE = 0.79
RETRYABLE = ("invalid", "error", "pending_validation")


def simple_score(similarity: Column, query_year: Column, year: Column) -> Column:
    """Score of a directory's candidate: similarity, and years equal, one apart, further apart or not asked for."""
    dated = F.when(query_year == year, SAME_YEAR).when(F.abs(query_year - year) > 1, FAR_YEAR).otherwise(NEAR_YEAR)
    bonus = F.when(query_year.isNotNull() & year.isNotNull(), dated).when(query_year.isNull(), NO_YEAR).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(0.99), similarity * SIMPLE_WEIGHT + bonus))


def admissible(candidates: DataFrame) -> DataFrame:
    """Candidates that may be linked: dated, no resource conflict, another year only with an explicit id.

    Where a work has a localised exact title of a type and year that nothing blocks, plain Latin exact titles of that type and year go.
    Columns: work_id, media_type, title, year, score, exact, explicit, blocked, year_conflict, resource_conflict.
    """
    usable = candidates.filter(F.col("year").isNotNull() & ~F.col("resource_conflict") & (~F.col("year_conflict") | F.col("explicit")))
    title = F.coalesce(F.col("title"), F.lit(""))
    localised = (
        title.rlike(rules.CJK) & ~title.rlike(rules.KANA_OR_HANGUL) & F.col("exact") & (F.col("score") >= EXACT_SCORE)
        & F.col("media_type").isin("movie", "tv") & ~F.col("blocked")
    )
    latin = title.rlike("[A-Za-z]") & ~title.rlike(r"[\p{L}&&[^A-Za-z]]")
    # what a work's other candidates say is looked up in place: a join with them would make the candidates twice
    group = Window.partitionBy("work_id", "media_type", "year")
    marked = usable.withColumn("_localised", F.coalesce(F.bool_or(localised).over(group), F.lit(False)) & F.col("work_id").isNotNull())
    return marked.filter(~(latin & F.col("exact") & ~F.col("explicit") & F.col("_localised"))).drop("_localised")


def rival_status(coverage: DataFrame, rivals: DataFrame, seasons: DataFrame) -> DataFrame:
    """(work_id, catalogue_id, status): how each rival's seasons fit what the work has.

    ``coverage`` (work_id, season, first, last, episodes, contiguous), ``rivals`` (work_id, catalogue_id, total_episodes, total_seasons),
    ``seasons`` (catalogue_id, season, episode_count). conflict: a season goes beyond the rival's; unverified: a season is
    missing there or its totals disagree; exact: all seasons are whole; else compatible. The seasons of a work and of a rival
    are a list each, so each pair is one row, met with either once.
    """
    have = coverage.groupBy("work_id").agg(F.collect_list(F.struct("season", "first", "last", "episodes", "contiguous")).alias("_have"))
    known = seasons.groupBy("catalogue_id").agg(F.collect_list(F.struct("season", "episode_count")).alias("_known"), F.sum("episode_count").alias("_episodes"), F.count(F.lit(1)).alias("_seasons"))
    pairs = rivals.select("work_id", "catalogue_id", "total_episodes", "total_seasons").distinct().join(known, "catalogue_id", "left").join(have, "work_id")
    theirs = F.coalesce("_known", F.array().cast("array<struct<season:int,episode_count:int>>"))
    same = lambda h: F.filter(theirs, lambda s: s["season"] == h["season"])
    whole = lambda h, s: h["contiguous"] & (h["first"] == 1) & (h["episodes"] == s["episode_count"])
    missing = F.exists("_have", lambda h: let(same(h), lambda m: (F.size(m) == 0) | F.exists(m, lambda s: s["episode_count"].isNull())))
    beyond = F.exists("_have", lambda h: F.exists(same(h), lambda s: F.coalesce(h["last"] > s["episode_count"], F.lit(False))))
    all_whole = F.forall("_have", lambda h: F.forall(same(h), lambda s: F.coalesce(whole(h, s), F.lit(False))))
    consistent = F.coalesce((F.col("total_episodes") == F.col("_episodes")) & (F.col("total_seasons") == F.col("_seasons")), F.lit(False))
    status = F.when(missing, "unverified").when(beyond, "conflict").when(~consistent, "unverified").when(all_whole, "exact").otherwise("compatible")
    return pairs.select("work_id", "catalogue_id", status.alias("status"))


def disambiguated(rivals: DataFrame) -> DataFrame:
    """``rivals`` (work_id, catalogue_id, score, status) with the scores of those refuted capped.

    That is where of 2 to 12 rivals exactly one is exact and all others conflict.
    """
    work = Window.partitionBy("work_id")  # in place: a join with the counts would make the rivals twice
    counted = rivals.filter(F.col("work_id").isNotNull()).withColumns({
        "_n": F.count(F.lit(1)).over(work), "_exact": F.count(F.when(F.col("status") == "exact", 1)).over(work), "_conflict": F.count(F.when(F.col("status") == "conflict", 1)).over(work),
    })
    decided = (F.col("_n").between(2, 12)) & (F.col("_exact") == 1) & (F.col("_conflict") == F.col("_n") - 1)
    score = F.when(decided & (F.col("status") == "conflict"), F.least("score", F.lit(REFUTED_SCORE))).otherwise(F.col("score"))
    return counted.select("work_id", "catalogue_id", "status", score.alias("score"), (decided & (F.col("status") == "exact")).alias("season_match"))


def consistent_evidence(resources: DataFrame, links: DataFrame, evidence: DataFrame) -> DataFrame:
    """(work_id, title_key, year, season, resources) of works all of whose resources have evidence, and all of it the same.

    ``evidence`` (message_id, title_key, year, season): what messages state; messages without any are not in it.
    """
    said = links.select("source_key", "message_id").distinct().join(evidence, "message_id").groupBy("source_key").agg(
        F.min(F.struct("title_key", "year", "season")).alias("_low"), F.max(F.struct("title_key", "year", "season")).alias("_high")
    )
    works = resources.select("work_id", "source_key").join(said, "source_key", "left").groupBy("work_id").agg(
        F.count(F.lit(1)).alias("resources"), F.bool_and(F.col("_low").isNotNull()).alias("_all"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    return works.filter(F.col("_all") & (F.col("_low") == F.col("_high"))).select("work_id", "_low.*", "resources")


def _held_in(whole: DataFrame, part: DataFrame) -> DataFrame:
    """(collection_id, whole, part): different texts of a collection that hold another one, found by equal pieces.

    ``whole`` (collection_id, whole), ``part`` (collection_id, part). A text is cut into the pieces of as many characters as
    some part of its collection has, so only pieces that may be equal are made.
    """
    lengths = part.groupBy("collection_id").agg(F.collect_set(F.length("part")).alias("_lengths"))
    cut = whole.join(lengths, "collection_id").select("collection_id", "whole", F.explode("_lengths").alias("_n")).filter(F.length("whole") >= F.col("_n"))
    starts = cut.select("collection_id", "whole", "_n", F.explode(F.sequence(F.lit(1), F.length("whole") - F.col("_n") + 1)).alias("_i"))
    pieces = starts.select("collection_id", "whole", F.substring("whole", F.col("_i"), F.col("_n")).alias("part")).distinct()
    return pieces.join(part, ["collection_id", "part"])


def collection_part(asked: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, catalogue_id): the part of the asked title's collection whose title equals, contains or is contained in it; its year first, then the least id.

    ``asked`` (id, collection_id, title_key, year), ``parts`` (collection_id, catalogue_id, part_key, part_year). Different
    titles meet, each once; asked rows then meet the least ids that their title leads to.
    """
    ours = asked.filter(F.col("title_key") != "")
    least = parts.filter(F.col("part_key") != "").groupBy("collection_id", "part_key", "part_year").agg(F.min("catalogue_id").alias("_least"))
    titles, keys = ours.select("collection_id", "title_key").distinct(), least.select("collection_id", "part_key").distinct()
    inside = _held_in(titles.withColumnRenamed("title_key", "whole"), keys.withColumnRenamed("part_key", "part")).select("collection_id", F.col("whole").alias("title_key"), F.col("part").alias("part_key"))
    around = _held_in(keys.withColumnRenamed("part_key", "whole"), titles.withColumnRenamed("title_key", "part")).select("collection_id", F.col("part").alias("title_key"), F.col("whole").alias("part_key"))
    led = inside.union(around).join(least, ["collection_id", "part_key"]).groupBy("collection_id", "title_key", "part_year").agg(F.min("_least").alias("_least"))
    any_year = led.groupBy("collection_id", "title_key").agg(F.min("_least").alias("_any"))
    same_year = led.select("collection_id", "title_key", F.col("part_year").alias("year"), F.col("_least").alias("_same"))
    found = ours.join(any_year, ["collection_id", "title_key"]).join(same_year, ["collection_id", "title_key", "year"], "left")
    other = F.when(F.col("year").isNull() | F.col("_same").isNotNull(), 0).otherwise(1)
    return found.groupBy("id").agg(F.min(F.struct(other.alias("o"), F.coalesce("_same", "_any").alias("catalogue_id")))["catalogue_id"].alias("catalogue_id"))


def mutual_matches(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, xid): external ids that lead to one entry of one type which leads back to them.

    ``ours`` (id, xid), ``theirs`` (catalogue_id, xid, back_xid).
    """
    single = theirs.groupBy("xid").agg(F.min(F.struct("catalogue_id", "back_xid")).alias("_t"), F.count_distinct("catalogue_id").alias("_n")).filter("_n = 1")
    return ours.join(single, "xid").filter(F.col("_t.back_xid") == F.col("xid")).select("id", "xid", F.col("_t.catalogue_id").alias("catalogue_id"))


# Codes that say a share is gone, and those that only bar the way to it.
GONE_CODES, BARRED_CODES = (4100009, 4100010, 4100018), (4100008, 4100012)


def share_groups(resources: DataFrame) -> DataFrame:
    """``resources`` (id, url, ...) with ``share``: the identity that a link check is of. What is no share is its own."""
    own = F.concat(F.lit("invalid/"), F.col("id").cast("string"))
    share = let(share_identity(F.col("url")), lambda who: F.when(who.isNotNull(), F.concat_ws("/", who["provider"], who["code"], who["password"])).otherwise(own))
    return resources.withColumn("share", share)


def checked_resources(resources: DataFrame, probes: DataFrame) -> DataFrame:
    """(id, share, action): what one check of each share says of all its resources.

    ``probes`` (share, code): code null for a share that answers, else its error. ``available`` is written back, a share
    that is gone is to be ``remove``d, one that only bars the way is ``protected``, and any other answer says nothing.
    Shares without a probe are ``unchecked``.
    """
    one = probes.groupBy("share").agg(F.bool_or(F.col("code").isNull()).alias("_fine"), F.min("code").alias("_code"), F.lit(True).alias("_probed"))
    action = (
        F.when(F.col("_probed").isNull(), "unchecked").when(F.col("_fine"), "available").when(F.col("_code").isin(*GONE_CODES), "remove")
        .when(F.col("_code").isin(*BARRED_CODES), "protected").otherwise("unknown")
    )
    return share_groups(resources).join(one, "share", "left").select("id", "share", action.alias("action"))


def dead_resource_changes(resources: DataFrame, works: DataFrame, probes: DataFrame) -> DataFrame:
    """(work_id, removed, action): what removing dead resources does to works without a confirmed identity.

    A resource goes only if its URL and its metadata are still those that were checked, a null one included (``probes``: id,
    url, metadata, state). A work that keeps some is opened again, one that keeps none is dropped.
    """
    dead = probes.filter(F.col("state") == "invalid").select(F.col("id").alias("_id"), F.col("url").alias("_url"), F.col("metadata").alias("_metadata")).distinct()
    same = (F.col("id") == F.col("_id")) & (F.col("url") == F.col("_url")) & F.col("metadata").eqNullSafe(F.col("_metadata"))
    gone = resources.join(dead, same, "left")
    counts = gone.groupBy("work_id").agg(F.count("_id").alias("removed"), F.count(F.lit(1)).alias("_n")).filter("removed > 0")
    open_ = (F.col("status") != "matched") & F.col("catalogue_id").isNull()
    action = F.when(~open_, "keep").when(F.col("removed") == F.col("_n"), "drop").otherwise("reopen")
    return counts.join(works.select(F.col("id").alias("work_id"), "status", "catalogue_id"), "work_id").select("work_id", "removed", action.alias("action"))


def edited_works(works: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Works with the columns of manual edits over theirs; an edit's null leaves a column as it is."""
    over = edits.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = works.join(over, F.col("id") == F.col("_id"), "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop("_id", *[f"_{c}" for c in columns])


def not_rejected(candidates: DataFrame, rejected: DataFrame) -> DataFrame:
    """Candidates without those that were rejected for their work."""
    return candidates.join(rejected.select("work_id", "catalogue_id").distinct(), ["work_id", "catalogue_id"], "left_anti")


def replayable(messages: DataFrame, links: DataFrame) -> DataFrame:
    """Messages to run again: ignored ones and those with a link that no work owns."""
    orphaned = links.filter(F.col("work_id").isNull()).select(F.col("message_id").alias("id")).distinct().withColumn("_orphaned", F.lit(True))
    return messages.join(orphaned, "id", "left").filter((F.col("status") == "ignored") | F.col("_orphaned")).drop("_orphaned")


def reset_links(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(message_id, source_key, status, attempts): the unsuccessful links of failed messages, to be validated afresh."""
    failed = messages.filter(F.col("status") == "failed").select(F.col("id").alias("message_id"))
    return links.filter(F.col("status").isin(*RETRYABLE)).join(failed, "message_id", "left_semi").select(
        "message_id", "source_key", F.lit("pending_validation").alias("status"), F.lit(0).alias("attempts")
    )


def link_outcome(code: Column, message: Column) -> Column:
    """invalid for codes and messages that end it, gate for signs of risk control, else transient.

    A message that ends it outweighs a weak sign of risk, not a strong one.
    """
    text = F.coalesce(message, F.lit(""))
    ends, strong = text.rlike(rules.TERMINAL_MESSAGE), text.rlike(rules.STRONG_RISK)
    coded = F.coalesce(code.isin(*rules.TERMINAL_CODES), F.lit(False))
    risk = F.when(ends & ~strong, False).otherwise(strong | text.rlike(rules.WEAK_RISK))
    return F.when(~risk & (coded | ends), "invalid").when(risk, "gate").otherwise("transient")


def season_ranges(resources: DataFrame, context: str) -> DataFrame:
    """(id, season_end) of resources without one whose heading has a season range that goes up."""
    first, last = first_int(F.col(context), rules.SEASON_RANGE, 1), first_int(F.col(context), rules.SEASON_RANGE, 2)
    return resources.filter(F.col("season_end").isNull() & (last > first)).select("id", last.alias("season_end"))


def cleaned_persons(works: DataFrame) -> DataFrame:
    """(id, title, title_key) of persons, names cleaned; an empty one keeps its title. They have no year."""
    name = clean_person_name(F.col("title"))
    named = works.filter(F.col("resource_kind") == "person").withColumn("_name", name).withColumn("_key", title_key(F.col("_name")))
    some = F.col("_key") != ""
    return named.select("id", F.when(some, F.col("_name")).otherwise(F.col("title")).alias("title"), F.when(some, F.col("_key")).otherwise(F.col("title_key")).alias("title_key"))


def repaired_kinds(works: DataFrame, resources: DataFrame) -> DataFrame:
    """(id, resource_kind) of works whose kind their resources' headings change: person before series, else media where only stray icons spoke for it.

    ``resources``: work_id, kind (by the heading, null for none), stray (an icon elsewhere).
    """
    found = resources.groupBy("work_id").agg(
        F.bool_or(F.coalesce(F.col("kind") == "person", F.lit(False))).alias("_person"), F.bool_or(F.coalesce(F.col("kind") == "series", F.lit(False))).alias("_series"),
        F.bool_or(F.coalesce(F.col("stray") & (F.col("kind") == "media"), F.lit(False))).alias("_stray"),
    )
    expected = F.when(F.col("_person"), "person").when(F.col("_series"), "series").when(F.col("_stray"), "media")
    joined = works.join(found, works.id == found.work_id).withColumn("_kind", expected)
    return joined.filter(F.col("_kind").isNotNull() & (F.col("_kind") != F.col("resource_kind"))).select("id", F.col("_kind").alias("resource_kind"))


def dry_run_estimate(posts: DataFrame, direct: Column, page: Column, existing: Column) -> DataFrame:
    """One row: posts, those with direct links, with pages only, without either, and those that are there already."""
    count = lambda c: F.count(F.when(c, 1))
    fresh = ~existing
    return posts.agg(
        F.count(F.lit(1)).alias("posts"), count(existing).alias("existing"), count(fresh & direct).alias("direct"),
        count(fresh & ~direct & page).alias("page_only"), count(fresh & ~direct & ~page).alias("empty"),
    )


def episode_span(filename: Column) -> Column:
    """Struct(season, first, last) of a file name with exactly one explicit span within one season, else null."""

    def of(name: Column) -> Column:
        found = F.regexp_extract_all(name, F.lit(f"({rules.FILE_SPAN})"), F.lit(1))
        season, first = first_int(name, rules.FILE_SPAN, 1), first_int(name, rules.FILE_SPAN, 2)
        other, last = first_int(name, rules.FILE_SPAN, 3), F.coalesce(first_int(name, rules.FILE_SPAN, 4), first_int(name, rules.FILE_SPAN, 2))
        chained = name.rlike(f"(?>{rules.FILE_SPAN})" + r"[._\s]*[-~][._\s]*(?:S\d|E\d|\d)")
        fine = (F.size(found) == 1) & ~chained & (season >= 1) & (F.coalesce(other, season) == season) & first.between(1, 999) & (last >= first) & (last <= 999)
        return F.when(fine, F.struct(season.alias("season"), first.alias("first"), last.alias("last")))

    return let(F.element_at(F.split(filename, "/"), -1), of)


def title_variants(titles: DataFrame, key: str, title: str) -> DataFrame:
    """(key, ord, variant): ways to write a title, each once by its title key, in order.

    Bracketed parts, the parts on either side of where CJK text turns to Latin, the whole; each without its edition suffix, then with it.
    """
    edge = rules.EDGE + rules.BRACKETS
    strip = lambda c: F.regexp_replace(c, f"^[{edge}]+|[{edge}]+$", "")
    base = trim_unbalanced(F.regexp_replace(F.regexp_replace(title, r"\s+", " "), r"^[ \t\-–—|·\[\]【】]+|[ \t\-–—|·\[\]【】]+$", ""))
    rows = titles.select(key, base.alias("_base")).filter(F.col("_base") != "")
    parts = F.filter(F.transform(F.split("_base", r"[\]】]\s*"), strip), lambda p: p != "")
    rows = rows.withColumn("_parts", F.when(F.size(parts) > 1, parts).otherwise(F.array("_base")))
    split = F.flatten(F.transform("_parts", lambda p: F.split(p, rules.CJK_LATIN_BOUNDARY, 2)))
    both = lambda v: F.array(F.trim(F.regexp_replace(v, rules.EDITION_SUFFIX, "")), F.trim(v))
    options = rows.select(key, F.posexplode(F.flatten(F.transform(F.concat(split, F.array("_base")), both))).alias("ord", "variant"))
    keyed = options.withColumn("_key", title_key(F.col("variant"))).filter(
        (F.col("_key") != "") & (F.col("variant") != rules.PLACEHOLDER_TITLE) & ~F.col("_key").rlike(rules.TECHNICAL_TITLE)
    )
    return keyed.groupBy(key, "_key").agg(F.min_by("variant", "ord").alias("variant"), F.min("ord").alias("ord")).select(key, "ord", "variant")
