"""What messages state of a work, what speaks for and against a candidate, and which candidate a statement confirms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import first_int, first_match, strip_chars, title_key, title_keys, written_number
from ..functions.udfs import best_ratio
from .matching import admissible, consistent_evidence
from .resolve import auto_link, score

CJK = "[\\u3400-\\u9fff]"
LATIN = "[A-Za-z]"


def _without_noise(title: Column) -> Column:
    """The title before a year behind it, without remarks on the release."""
    dated = F.regexp_extract(title, r"^(.*?)" + rules.ANY_YEAR, 1)
    cut = F.when(F.trim(dated) != "", F.trim(dated)).otherwise(title)
    bare = reduce(lambda t, pattern: F.regexp_replace(t, pattern, ""), rules.STATED_NOISE, cut)
    edged = strip_chars(bare, r" \-_:：·")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(edged, "[（(]+$", "")), r"\s*(?:全|完)$", ""))


def stated(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``said``: struct(title, title_key, year, season, media_type) that a message states, else null.

    A message states a work by a labelled title with a year, or by an icon and a heading with one. The year is the
    labelled one, else the first in the title. Titles that name a kind of post, no work, do not count.
    """
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    field = F.trim(F.regexp_extract(body, rules.STATED_TITLE, 1))
    first = F.trim(F.regexp_extract(body, r"(?m)^\s*(\S.*)$", 1))
    rows = messages.withColumn("_field", field).withColumn("_raw", F.trim(F.regexp_replace(F.when(field != "", field).otherwise(first), rules.STATED_ICON, "")))
    rows = rows.withColumn("_title", _without_noise(F.col("_raw"))).withColumn("_raw_key", title_key(F.col("_raw")))
    rows = rows.withColumn("_key", title_key(F.col("_title")))
    labelled = first_int(body, rules.STATED_YEAR)
    year = F.coalesce(labelled, first_int(F.col("_raw"), rules.ANY_YEAR))
    season = F.coalesce(*[written_number(first_match(F.col("_raw"), p)) for p in rules.STATED_SEASON])
    kind = reduce(lambda c, t: c.when(body.rlike(t[1]), t[0]), rules.STATED_TYPES[1:], F.when(body.rlike(rules.STATED_TYPES[0][1]), rules.STATED_TYPES[0][0]))
    generic = F.col("_raw_key").isin(*rules.GENERIC_TITLES) | reduce(lambda a, b: a | b, [F.col("_raw_key").startswith(s) for s in rules.GENERIC_TITLE_STARTS])
    standard = (F.col("_field") != "") | F.trim(body).rlike(rules.STATED_ICON)
    usable = (F.col("_raw") != "") & (F.col("_title") != "") & ~generic & standard & year.isNotNull()
    said = F.struct(F.col("_title").alias("title"), F.col("_key").alias("title_key"), year.alias("year"), season.alias("season"), kind.alias("media_type"))
    return rows.withColumn("said", F.when(usable, said)).drop("_field", "_raw", "_title", "_raw_key", "_key")


SELECTED_BY = ("stated_type", "own_type", "any_type", "latin_alias")


def selected(evidence: DataFrame, candidates: DataFrame) -> DataFrame:
    """(work_id, catalogue_id, selected_by): the one candidate that what is said of a work confirms.

    ``evidence`` (work_id, title, title_key, year, season, stated_type, own_type); ``candidates`` (work_id, catalogue_id,
    title, title_key, year, media_type). Only candidates of the year count. In this order, the first kind that exactly one
    candidate is of selects it: the title and the type that is said; the title and the work's type; the title; a Latin
    title that the said one holds. Later seasons and titles that end in a remark on the edition select none.
    """
    last = reduce(lambda a, b: a | b, [F.col("_said").endswith(e) for e in rules.UNSAFE_TITLE_ENDS])
    e = evidence.select("work_id", F.col("title").alias("_said"), F.col("title_key").alias("_key"), "year", "season", "stated_type", "own_type")
    e = e.filter(F.col("year").isNotNull() & (F.coalesce("season", F.lit(1)) <= 1) & ~last)
    both = e.join(candidates.select("work_id", "catalogue_id", "title", "title_key", "year", "media_type"), ["work_id", "year"])
    exact = F.col("title_key") == F.col("_key")
    alias = F.coalesce(F.col("title").rlike(rules.LATIN_TITLE) & (F.col("title_key") != "") & F.contains("_key", "title_key"), F.lit(False))
    kinds = (exact & (F.col("media_type") == F.col("stated_type")), exact & (F.col("media_type") == F.col("own_type")), exact, alias)
    tiers = both.groupBy("work_id").agg(
        *[F.count(F.when(k, 1)).alias(f"_n{i}") for i, k in enumerate(kinds)], *[F.min(F.when(k, F.col("catalogue_id"))).alias(f"_c{i}") for i, k in enumerate(kinds)]
    )
    pick = F.coalesce(*[F.when(F.col(f"_n{i}") == 1, F.struct(F.col(f"_c{i}").alias("catalogue_id"), F.lit(by).alias("selected_by"))) for i, by in enumerate(SELECTED_BY)])
    return tiers.withColumn("_pick", pick).filter(F.col("_pick").isNotNull()).select("work_id", "_pick.*")


def confirmed(works: DataFrame, resources: DataFrame, links: DataFrame, messages: DataFrame, candidates: DataFrame) -> DataFrame:
    """(work_id, catalogue_id, selected_by, score) of works in review that their stored messages confirm a candidate of.

    All resources of the work must have a message that states a work, and all of these must state the same one, whose title
    holds the work's or is held by it. No candidate is made here. ``works`` (id, title_key, media_type, status), ``resources``
    (work_id, source_key), ``links`` (source_key, message_id), ``messages`` (id, text), ``candidates`` with score.
    """
    open_ = works.filter(F.col("status") == "review").select(F.col("id").alias("work_id"), F.col("title_key").alias("_own_key"), F.col("media_type").alias("own_type"))
    asked = resources.select("work_id", "source_key").join(open_.select("work_id"), "work_id", "left_semi").distinct()
    # only messages that a resource in question is from are read; as their text hangs on the join, no test of it comes before
    links = links.join(asked.select("source_key").distinct(), "source_key", "left_semi")
    used = links.groupBy(F.col("message_id").alias("id")).agg(F.count(F.lit(1)).alias("_links"))
    messages = messages.join(used, "id").select("id", F.when(F.col("_links") > 0, F.col("text")).alias("text"))
    said = stated(messages).filter(F.col("said").isNotNull()).select(F.col("id").alias("message_id"), "said.*")
    same = consistent_evidence(asked, links, said.select("message_id", "title_key", "year", "season"))
    told = links.select("source_key", "message_id").join(said, "message_id").join(asked, "source_key").groupBy("work_id").agg(
        F.min_by(F.struct("title", F.col("media_type").alias("stated_type")), F.struct("source_key", "message_id")).alias("_told")
    )
    evidence = same.join(told, "work_id").join(open_, "work_id")
    alike = (F.col("_own_key") != "") & (F.col("title_key") != "") & (F.contains("title_key", "_own_key") | F.contains("_own_key", "title_key"))
    chosen = selected(evidence.filter(alike).select("work_id", F.col("_told.title").alias("title"), "title_key", "year", "season", F.col("_told.stated_type").alias("stated_type"), "own_type"), candidates)
    return chosen.join(candidates.groupBy("work_id", "catalogue_id").agg(F.max("score").alias("score")), ["work_id", "catalogue_id"])


def script(text: Column) -> Column:
    """cjk, latin, mixed or other: which letters a title is written in."""
    cjk, latin = text.rlike(CJK), text.rlike(LATIN)
    return F.when(cjk & latin, "mixed").when(cjk, "cjk").when(latin, "latin").otherwise("other")


def plain_latin(text: Column) -> Column:
    return text.rlike(r"^[\x00-\x7F]*$") & text.rlike(LATIN)


def _flagged(candidates: DataFrame, works: DataFrame, titles: DataFrame, resource_titles: DataFrame) -> tuple[DataFrame, list[str]]:
    """``candidates`` with their flags, the names of these, and what they are of: ``_keys`` of the local titles, ``_theirs`` of the candidate's, ``_own_type``, ``years``.

    All meets by work, so rows are shuffled by it once. Keys are made of whole lists of titles, not of a row for each.
    """
    local = titles.filter(F.col("title").isNotNull()).groupBy("work_id").agg(F.collect_set("title").alias("_titles"))
    local = local.select("work_id", title_keys(F.col("_titles")).alias("_keys"), title_keys(F.filter("_titles", plain_latin)).alias("_latin_keys"))
    # resources of a work that name the same are one
    named = resource_titles.groupBy("work_id", "resource").agg(F.sort_array(F.collect_set("title")).alias("_named")).select("work_id", "_named").distinct()
    named = named.select("work_id", title_keys(F.col("_named")).alias("_k")).groupBy("work_id").agg(F.collect_set("_k").alias("_all_named"))
    own = works.select(
        "work_id", F.col("media_type").alias("_own_type"), "episodic", "years", "structured_type", "resource_kind", "resource_mixed",
        title_key(F.col("title")).alias("_own"), F.col("title").rlike(CJK).alias("_cjk"),
    )
    none = F.array().cast("array<string>")
    joined = candidates.withColumn("_t", title_keys(F.col("titles"))).join(own, "work_id").join(local, "work_id", "left").join(named, "work_id", "left")
    one = Window.partitionBy("work_id", "catalogue_id", "media_type")
    known = F.col("catalogue_id").isNotNull() & F.col("media_type").isNotNull()
    joined = joined.withColumn("_theirs", F.when(known, F.array_distinct(F.flatten(F.collect_set("_t").over(one)))))
    joined = joined.withColumns({c: F.coalesce(c, none) for c in ("_keys", "_latin_keys", "_theirs")})
    # a resource agrees if any of its titles does; all resources of a work have to
    joined = joined.withColumn("_resources_fit", F.when(known, F.forall("_all_named", lambda k: F.arrays_overlap(k, "_theirs"))))
    years = F.coalesce("years", F.array().cast("array<int>"))
    dated = F.size(years) > 0
    disagrees = F.coalesce(~F.col("_resources_fit"), F.lit(False))
    typed = F.coalesce(F.col("structured_type"), F.lit(False)) & F.col("_own_type").isin("movie", "tv")
    flags = {
        "primary_exact": F.array_contains("_theirs", F.col("_own")),
        "exact": F.array_contains("_theirs", F.col("_own")) | F.arrays_overlap("_keys", "_theirs"),
        "name_conflict": F.col("_cjk") & (F.size("_latin_keys") > 0) & F.col("latin_original") & ~F.arrays_overlap("_latin_keys", "_theirs"),
        "type_conflict": F.col("episodic") & (F.col("media_type") != "tv"),
        "type_mismatch": typed & (F.col("media_type") != F.col("_own_type")),
        "year_conflict": dated & F.col("year").isNotNull() & ~F.array_contains(years, F.col("year")),
        "year_unverified": dated & F.col("year").isNull(),
        "year_missing": ~dated,
        "derived_only": F.col("derived"),
        "resource_conflict": F.col("resource_mixed") | ((F.col("resource_kind") == "tv") & (F.col("media_type") != "tv")),
        "resource_name_conflict": disagrees & F.col("verified"),
        "resource_name_unverified": disagrees & ~F.col("verified"),
    }
    out = joined.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in flags.items()})
    # an unverified name matters only where the title would else be taken for the work's
    out = out.withColumn("resource_name_unverified", F.col("resource_name_unverified") & F.col("exact"))
    against = ("name_conflict", "type_conflict", "type_mismatch", "year_conflict", "year_unverified", "resource_conflict", "resource_name_conflict", "resource_name_unverified")
    return out.withColumn("blocked", reduce(lambda a, b: a | b, [F.col(a) for a in against])), [*flags, "blocked"]


def evidence_flags(candidates: DataFrame, works: DataFrame, titles: DataFrame, resource_titles: DataFrame) -> DataFrame:
    """``candidates`` with the flags that speak for and against each; what ``admissible`` and ``auto_link`` read.

    ``candidates``: work_id, catalogue_id, media_type, titles (all known ones, the original and verified ones included),
    latin_original (the original title or a verified one is plain Latin), year, explicit, derived (no hit but of derived
    terms), verified (further titles were asked for). ``works``: work_id, title, media_type, episodic, years (known ones),
    structured_type (its type has support of its own), resource_kind, resource_mixed. ``titles`` (work_id, title): all
    local titles. ``resource_titles`` (work_id, resource, title): the titles of each resource that names any.

    A name conflict: the work's title is Chinese, local titles and the candidate's are also Latin, and no Latin one agrees.
    """
    flagged, flags = _flagged(candidates, works, titles, resource_titles)
    return flagged.select(*candidates.columns, *flags)


def scored_candidates(candidates: DataFrame, works: DataFrame, titles: DataFrame, resource_titles: DataFrame) -> DataFrame:
    """``candidates`` with their flags (``evidence_flags``), ``similarity`` and ``score`` over all titles and all known years.

    ``candidates`` has popularity besides what the flags need. A name that conflicts scores 0. The similarity is the best
    matching-block ratio of the keys of any local title and any of the candidate's, 0 without any; equal ones need no comparison.
    """
    flagged, flags = _flagged(candidates.filter(F.col("catalogue_id").isNotNull() & F.col("media_type").isNotNull()), works, titles, resource_titles)
    unlike = ~F.arrays_overlap("_keys", "_theirs") & (F.size("_keys") > 0) & (F.size("_theirs") > 0)
    ratio = best_ratio(F.when(unlike, F.col("_keys")), F.when(unlike, F.col("_theirs")))
    similarity = F.when(unlike, ratio).when(F.arrays_overlap("_keys", "_theirs"), 1.0).otherwise(0.0)
    joined = flagged.withColumn("similarity", similarity).select(*candidates.columns, *flags, "similarity", "_own_type", "years")
    known = F.when(F.array_contains("years", F.col("year")), F.col("year")).otherwise(F.get("years", F.lit(0)))
    value = score(
        F.col("similarity"), F.col("primary_exact"), F.col("exact"), F.col("explicit"), F.when(F.size(F.coalesce("years", F.array().cast("array<int>"))) > 0, known), F.col("year"), F.col("_own_type"),
        F.col("media_type"), F.col("popularity"),
    )
    return joined.withColumn("score", F.when(F.col("name_conflict") | F.col("resource_name_conflict"), 0.0).otherwise(value)).drop("_own_type", "years")


def decisions(scored: DataFrame, sequel: Column) -> DataFrame:
    """(work_id, catalogue_id, leader, gap, decision) of works with an admissible candidate, by the flags of their candidates."""
    usable = admissible(scored.withColumn("title", F.get("titles", F.lit(0))))
    return auto_link(usable, F.col("blocked"), F.col("derived_only"), F.col("explicit"), sequel)
