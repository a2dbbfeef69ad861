"""Resolution of parsed rows to works, merging, candidates and linking decisions.

Rows that agree in all that a rule looks at are aggregated before they meet, so that a title that a third of all rows
share is one row on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp_score, count_where, popularity_bonus
from ..functions.text import blank_to_null, stable_code
from .keyed import top_per_key

# Thresholds of the score and of the decision.
TITLE_WEIGHT, CLOSE, CLOSE_BONUS = 0.78, 0.82, 0.04
PRIMARY_FLOOR, ALIAS_FLOOR, EXPLICIT_FLOORS = 0.88, 0.80, ((0.55, 0.86), (0.25, 0.74))
YEAR_BONUS, TYPE_BONUS, TYPE_PENALTY, EXPLICIT_BONUS = 0.14, 0.04, -0.08, 0.04
AUTO_SCORE, AUTO_MARGIN, EXACT_SCORE, EXACT_MARGIN = 0.90, 0.08, 0.88, 0.12


def coded_titles(rows: DataFrame, *texts: str) -> DataFrame:
    """A stable code in any of ``texts`` is the title, its type unknown and its collection none."""
    code = F.coalesce(*[stable_code(F.col(t)) for t in texts])
    return rows.withColumn("_code", code).withColumns({
        "title": F.coalesce("_code", "title"),
        "media_type": F.when(F.col("_code").isNotNull(), "unknown").otherwise(F.col("media_type")),
        "collection_id": F.when(F.col("_code").isNull(), F.col("collection_id")),
    }).drop("_code")


_ASKED = ["title_key", "year", "media_type", "resource_kind"]


def compatible_works(incoming: DataFrame, works: DataFrame) -> DataFrame:
    """``incoming`` with ``work_id`` of the stored work it belongs to, null for none.

    Title keys are equal. A person takes a person or series first, then the least id. Others take works of their year or without one,
    those with the year first; all if they have none: the first of their type, else of unknown type, else, if their own type is
    unknown, the only one.
    """
    titled = F.col("title_key").isNotNull() & (F.col("title_key") != "")
    asked = incoming.filter(titled).select(*[F.col(c).alias(f"_{c}") for c in _ASKED]).distinct()
    kinds = works.filter(titled).groupBy(*_ASKED).agg(F.min("id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    person = F.col("_resource_kind") == "person"
    fits = F.when(person, True).otherwise(F.col("_year").isNull() | F.col("year").isNull() | (F.col("_year") == F.col("year")))
    pairs = asked.join(kinds, F.col("_title_key") == F.col("title_key")).filter(fits)
    undated = F.when(F.col("_year").isNull(), False).otherwise(F.col("year").isNull())
    same = F.col("media_type") == F.col("_media_type")
    first = lambda when: F.min(F.when(when, F.struct(undated.alias("undated"), F.col("_id").alias("id"))))["id"]
    kept = ~F.col("resource_kind").isin("person", "series")
    best = pairs.groupBy(*[f"_{c}" for c in _ASKED]).agg(
        F.min(F.struct(kept.alias("other"), F.col("_id").alias("id")))["id"].alias("_person"),
        first(same).alias("_same"), first((F.col("media_type") == "unknown") & (F.col("_media_type") != "unknown")).alias("_unknown"),
        F.when((F.sum("_n") == 1) & (F.first("_media_type") == "unknown"), F.min("_id")).alias("_only"),
    )
    found = F.when(person, F.col("_person")).otherwise(F.coalesce("_same", "_unknown", "_only"))
    known = best.select(*[f"_{c}" for c in _ASKED], found.alias("work_id")).filter(F.col("work_id").isNotNull())
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ASKED]
    return incoming.join(known, on, "left").drop(*[f"_{c}" for c in _ASKED])


def work_changes(resolved: DataFrame, works: DataFrame) -> DataFrame:
    """What resolved rows (with ``work_id``) fill in of stored works: an unknown type, a missing year, a kind, the bundle flag."""
    typed = F.when(F.col("media_type") != "unknown", F.col("media_type"))
    special = F.when(F.col("resource_kind").isin("person", "series"), F.col("resource_kind"))
    given = resolved.filter(F.col("work_id").isNotNull()).groupBy("work_id").agg(
        F.min_by(typed, F.when(typed.isNotNull(), F.col("id"))).alias("_type"), F.min_by("year", F.when(F.col("year").isNotNull(), F.col("id"))).alias("_year"),
        F.min_by(special, F.when(special.isNotNull(), F.col("id"))).alias("_kind"), F.bool_or("is_bundle").alias("_bundle"),
    )
    kind = F.when(F.col("resource_kind") == "media", F.coalesce("_kind", "resource_kind")).otherwise(F.col("resource_kind"))
    return works.join(given, works.id == given.work_id).select(
        "id", F.when(F.col("media_type") == "unknown", F.coalesce("_type", "media_type")).otherwise(F.col("media_type")).alias("media_type"),
        F.when(kind != "person", F.coalesce("year", "_year")).alias("year"), kind.alias("resource_kind"), (F.col("is_bundle") | F.col("_bundle")).alias("is_bundle"),
    )


def new_works(resolved: DataFrame) -> DataFrame:
    """Works for rows without one: one for each title key, year (none for persons) and type."""
    year = F.when(F.col("resource_kind") != "person", F.col("year"))
    return resolved.filter(F.col("work_id").isNull() & (F.col("title_key") != "")).withColumn("year", year).groupBy("title_key", "year", "media_type").agg(
        F.min("id").alias("first_id"), F.count(F.lit(1)).alias("resources"), F.bool_or("is_bundle").alias("is_bundle")
    )


def attach_collections(titles: DataFrame, collections: DataFrame) -> DataFrame:
    """(title_key, collection_id, members) for each title: the stored collection of that title with the least id, null if it is to be made."""
    wanted = titles.filter(F.col("title_key") != "").groupBy("title_key").agg(F.count(F.lit(1)).alias("members"))
    stored = collections.groupBy("title_key").agg(F.min("id").alias("collection_id"))
    return wanted.join(stored, "title_key", "left")


def containers(works: DataFrame, resources: DataFrame, container_word: Column) -> DataFrame:
    """Unmatched works that are containers: all resources collections, one with a container word, a bundle or two resources at least."""
    each = resources.groupBy("work_id").agg(
        F.count(F.lit(1)).alias("resources"), F.bool_and(F.col("resource_class") == "collection").alias("_all"), F.bool_or(F.coalesce(container_word, F.lit(False))).alias("_word")
    )
    open_ = works.filter(F.col("status") != "matched").select("id", "is_bundle")
    return open_.join(each, open_.id == each.work_id).filter("_all and _word and (is_bundle or resources >= 2)").select("id", "resources")


def merge_map(works: DataFrame, *identity: str) -> DataFrame:
    """(id, kept_id, collection_id) of works that share their identity; the least id stays and inherits a collection where it has none."""
    known = works.filter(" and ".join(f"{c} is not null" for c in identity))
    groups = known.groupBy(*identity).agg(
        F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("_n"), F.min_by("collection_id", "id").alias("_own"),
        F.min_by("collection_id", F.when(F.col("collection_id").isNotNull(), F.col("id"))).alias("_inherited"),
    ).filter("_n > 1")
    return known.select("id", *identity).join(groups, list(identity)).select("id", "kept_id", F.coalesce("_own", "_inherited").alias("collection_id"))


def repointed(children: DataFrame, merged: DataFrame, owner: str = "work_id") -> DataFrame:
    """Children with the kept work as their owner."""
    ids = merged.select(F.col("id").alias("_old"), F.col("kept_id").alias("_kept"))
    return children.join(ids, F.col(owner) == F.col("_old"), "left").withColumn(owner, F.coalesce("_kept", owner)).drop("_old", "_kept")


def orphans(works: DataFrame, resources: DataFrame) -> DataFrame:
    """Works without a resource and without a confirmed identity."""
    return works.filter(F.col("status") != "matched").join(resources.select(F.col("work_id").alias("id")), "id", "left_anti")


def candidates(terms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(term_key, term_year, title_key, year, exact, shared) of catalogue titles that share a word with a term.

    Both sides are distinct (title, year) pairs, however many rows have them. A known term year is a hard filter. Titles meet
    on (word, year) or, where the term has none, on the word; equal titles are exact.
    """
    t = terms.select(F.col("title").alias("term_key"), F.col("year").alias("term_year")).filter(blank_to_null(F.col("term_key")).isNotNull()).distinct()
    c = catalogue.select(F.col("title").alias("title_key"), "year").filter(blank_to_null(F.col("title_key")).isNotNull()).distinct()
    word = lambda d, key: d.withColumn("word", F.explode(F.array_distinct(F.split(key, " +"))))
    tw, cw = word(t, "term_key"), word(c, "title_key")
    dated = tw.filter(F.col("term_year").isNotNull()).withColumn("_year", F.col("term_year")).join(cw.withColumn("_year", F.col("year")), ["word", "_year"]).drop("_year")
    undated = tw.filter(F.col("term_year").isNull()).join(cw, "word")
    return dated.unionByName(undated).groupBy("term_key", "term_year", "title_key", "year").agg(F.count(F.lit(1)).alias("shared")).withColumn(
        "exact", F.col("term_key") == F.col("title_key")
    )


def score(
    similarity: Column, primary_exact: Column, alias_exact: Column, explicit: Column, known_year: Column, candidate_year: Column,
    local_type: Column, candidate_type: Column, popularity: Column,
) -> Column:
    """Score of a candidate, 0 to 0.99: title, year, type, explicit id, popularity. 0 for no year or another one."""
    title = similarity * TITLE_WEIGHT + F.when(similarity >= CLOSE, CLOSE_BONUS).otherwise(0.0)
    title = F.when(primary_exact, F.greatest(title, F.lit(PRIMARY_FLOOR))).when(alias_exact, F.greatest(title, F.lit(ALIAS_FLOOR))).otherwise(title)
    floor = F.when(explicit & (similarity >= EXPLICIT_FLOORS[0][0]), EXPLICIT_FLOORS[0][1]).when(explicit & (similarity >= EXPLICIT_FLOORS[1][0]), EXPLICIT_FLOORS[1][1])
    total = (
        F.greatest(title, F.coalesce(floor, F.lit(0.0))) + F.when(known_year.isNotNull(), YEAR_BONUS).otherwise(0.0)
        + F.when(~local_type.isin("movie", "tv"), 0.0).when(local_type == candidate_type, TYPE_BONUS).otherwise(TYPE_PENALTY)
        + F.when(explicit, EXPLICIT_BONUS).otherwise(0.0) + popularity_bonus(popularity)
    )
    wrong = candidate_year.isNull() | (known_year.isNotNull() & (known_year != candidate_year))
    return F.when(wrong, 0.0).otherwise(clamp_score(total))


def auto_link(candidates: DataFrame, blocked: Column, derived_only: Column, explicit: Column, sequel: Column) -> DataFrame:
    """(work_id, leader, gap, decision): link, or review, by the best candidate of each work and its lead.

    ``candidates``: work_id, catalogue_id, score, primary_exact, exact, year_missing. The conditions are of the best candidate.
    """
    marked = candidates.withColumns({"_blocked": blocked, "_derived": derived_only, "_explicit": explicit, "_sequel": sequel})
    top = F.struct("score", -F.col("catalogue_id"))
    best = F.max_by(F.struct("catalogue_id", "score", "primary_exact", "exact", "year_missing", "_blocked", "_derived", "_explicit", "_sequel"), top)
    each = marked.groupBy("work_id", "score").agg(F.count(F.lit(1)).alias("_n"), best.alias("_best"))
    two = top_per_key(each, ["work_id"], [F.desc("score")], 2).groupBy("work_id").agg(
        F.max_by("_best", "score").alias("b"), F.max_by("_n", "score").alias("_tied"), F.max("score").alias("leader"),
        F.when(F.count(F.lit(1)) > 1, F.min("score")).otherwise(0.0).alias("_second"), F.sum("_n").alias("_n"),
    )
    runner = F.when(F.col("_tied") > 1, F.col("leader")).otherwise(F.col("_second"))
    led = two.withColumn("gap", F.round(F.col("leader") - runner, 4))
    close = (F.col("leader") >= EXACT_SCORE) & (F.col("gap") >= EXACT_MARGIN) & F.col("b.year_missing")
    link = ~F.col("b._blocked") & ~(F.col("b._derived") & ~F.col("b.exact")) & (
        F.col("b._explicit") | ((F.col("leader") >= AUTO_SCORE) & (F.col("gap") >= AUTO_MARGIN)) | (close & F.col("b.primary_exact"))
        | (~F.col("b._sequel") & (F.col("_n") == 1) & close & F.col("b.exact") & ~F.col("b._derived"))
    )
    return led.select("work_id", F.col("b.catalogue_id").alias("catalogue_id"), "leader", "gap", F.when(link, "link").otherwise("review").alias("decision"))


def not_yet_delivered(posts: DataFrame, messages: DataFrame, keys: list[str]) -> DataFrame:
    """Posts that no message with an outcome has; queued ones are half done and do not count."""
    return posts.join(messages.filter(F.col("status") != "queued").select(*keys).distinct(), keys, "left_anti")


def covering_year(undated: DataFrame, siblings: DataFrame) -> DataFrame:
    """(id, year): the one year of the siblings of equal title whose episodes cover the work's first or last one.

    ``undated`` (id, title, first, last); ``siblings`` (title, year, first, last), of which equal ones count once.
    """
    s = siblings.select("title", "year", F.col("first").alias("_a"), F.col("last").alias("_b")).distinct()
    covers = F.col("first").between(F.col("_a"), F.col("_b")) | F.col("last").between(F.col("_a"), F.col("_b"))
    return undated.join(s, "title").filter(covers).groupBy("id").agg(F.min("year").alias("year"), F.max("year").alias("_last")).filter("year = _last").drop("_last")


def contained_works(works: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, collection_id): works without a collection whose catalogue id is a part of one; the least collection."""
    first = parts.groupBy("catalogue_id").agg(F.min("collection_id").alias("collection_id"))
    return works.filter("collection_id is null and catalogue_id is not null").select("id", "catalogue_id").join(first, "catalogue_id").select("id", "collection_id")


def backfilled_channels(posts: DataFrame) -> DataFrame:
    """Posts whose missing channel_id is the newest one known by username, else by name."""

    def newest(by: str) -> DataFrame:
        known = posts.filter(F.col("channel_id").isNotNull() & F.col(by).isNotNull())
        return known.groupBy(by).agg(F.max_by("channel_id", F.struct("received_at", "id")).alias(f"_by_{by}"))

    joined = posts.join(newest("channel_username"), "channel_username", "left").join(newest("channel_name"), "channel_name", "left")
    return joined.withColumn("channel_id", F.coalesce("channel_id", "_by_channel_username", "_by_channel_name")).drop("_by_channel_username", "_by_channel_name")


def rolled_up_status(links: DataFrame) -> DataFrame:
    """(message_id, status, links): a message's outcome by its links'."""
    s = F.col("status")
    counts = links.groupBy("message_id").agg(
        F.count(F.lit(1)).alias("links"), *[count_where(s == n).alias(n) for n in ("pending_validation", "invalid", "inserted", "duplicate", "error")],
        count_where(F.col("work_id").isNotNull()).alias("_owned"),
    )
    valid = F.col("inserted") + F.col("duplicate")
    status = (
        F.when(F.col("pending_validation") > 0, "pending_validation")
        .when(((valid > 0) | (F.col("_owned") > 0)) & (F.col("invalid") == 0), F.when(F.col("error") > 0, "failed").when(F.col("inserted") > 0, "imported").otherwise("duplicate"))
        .when(valid > 0, "imported").otherwise("failed")
    )
    return counts.select("message_id", status.alias("status"), "links")


def newest_processing(resources: DataFrame, links: DataFrame) -> DataFrame:
    """(id, availability, checked_at): accepted links make a resource of unknown availability available, when last processed."""
    accepted = links.filter(F.col("status").isin("inserted", "duplicate")).groupBy("source_key").agg(F.max("processed_at").alias("checked_at"))
    return resources.filter(F.col("availability") == "unknown").join(accepted, "source_key").select("id", F.lit("available").alias("availability"), "checked_at")
