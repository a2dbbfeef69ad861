"""What identifies a work when the first catalogue finds nothing, and what a confirmed identity changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .resolve import merge_map

# Years that count, how many names are asked for, and how sure a sibling is.
FIRST_YEAR, LAST_YEAR = 1870, 2100
MOST_NAMES = 4
SIBLING_SCORE = 0.95


def second_catalogue(works: DataFrame, candidates: DataFrame, second: DataFrame, mapping: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(work_id, status, xid, media_type, catalogue_id, year_override) of each work without a candidate: what a second catalogue says.

    ``works`` (work_id, years, names, collection, episodic): known years, name keys to ask for in order, whether the title
    is of a collection; ``candidates`` (work_id); ``second`` (xid, name_key, year, media_type); ``mapping`` (xid, media_type,
    catalogue_id): what an entry leads to; ``catalogue`` (catalogue_id, media_type, xid, year): what leads back. Only one
    known year, one entry of that year and one of the first names, one mapping of the same type that leads back with a
    year is located; any other case says in ``status`` where it ended.
    """
    open_ = works.join(candidates.select("work_id").distinct(), "work_id", "left_anti").withColumn("_year", F.when(F.size("years") == 1, F.get("years", F.lit(0))))
    asked = open_.filter(F.col("_year").between(FIRST_YEAR, LAST_YEAR) & ~F.col("collection")).select("work_id", F.col("_year").alias("year"), "episodic", F.explode(F.slice(F.array_distinct("names"), 1, MOST_NAMES)).alias("name_key"))
    # many works ask for the same name and year, which many entries have: of these the ends tell none, one and several apart
    entry, series = F.struct("xid", F.col("media_type").alias("kind")), F.col("media_type") == "tv"
    ends = lambda of: F.struct(F.min(F.when(of, F.col("xid"))).alias("low"), F.max(F.when(of, F.col("xid"))).alias("high"), F.min(F.when(of, entry)).alias("hit"))
    entries = second.groupBy("name_key", "year").agg(ends(F.lit(True)).alias("_all"), ends(series).alias("_series"))
    hits = asked.filter(F.col("name_key") != "").join(entries, ["name_key", "year"]).select("work_id", F.when(F.col("episodic"), F.col("_series")).otherwise(F.col("_all")).alias("_e")).filter(F.col("_e.hit").isNotNull())
    one = hits.groupBy("work_id").agg(F.min("_e.low").alias("_low"), F.max("_e.high").alias("_high"), F.min("_e.hit").alias("_hit")).select(
        "work_id", "_hit", F.when(F.col("_low").isNull(), 0).when(F.col("_low") == F.col("_high"), 1).otherwise(2).alias("_hits")
    )
    led = mapping.groupBy("xid").agg(F.count_distinct("media_type", "catalogue_id").alias("_mapped"), F.min(F.struct("media_type", "catalogue_id")).alias("_to"))
    back = catalogue.select(F.col("catalogue_id").alias("_id"), F.col("media_type").alias("_type"), F.col("xid").alias("_back"), F.col("year").alias("_their_year")).dropDuplicates(["_id", "_type"])
    found = open_.select("work_id", "_year", "years", "collection").join(one, "work_id", "left").withColumn("xid", F.col("_hit.xid")).join(led, "xid", "left")
    found = found.join(back, (F.col("_to.catalogue_id") == F.col("_id")) & (F.col("_to.media_type") == F.col("_type")), "left")
    status = (
        F.when(F.size("years") == 0, "missing_year").when(F.size("years") > 1, "conflicting_years").when(F.col("collection"), "collection")
        .when(F.col("_hits").isNull(), "no_exact_match").when(F.col("_hits") > 1, "ambiguous_second").when(F.col("_mapped").isNull(), "no_mapping").when(F.col("_mapped") > 1, "ambiguous_first")
        .when(F.col("_to.media_type") != F.col("_hit.kind"), "type_conflict").when(F.col("_back").isNull() | (F.col("_back") != F.col("xid")), "external_id_mismatch")
        .when(F.col("_their_year").isNull(), "first_missing_year").when(F.col("_their_year") != F.col("_year"), "located_second_year").otherwise("located")
    )
    placed = found.withColumn("status", status)
    located = F.col("status").startswith("located")
    return placed.select(
        "work_id", "status", F.when(F.col("_hits") == 1, F.col("xid")).alias("xid"), F.when(located, F.col("_to.media_type")).alias("media_type"),
        F.when(located, F.col("_to.catalogue_id")).alias("catalogue_id"), F.when(located, F.col("_their_year") != F.col("_year")).alias("year_override"),
    )


def sibling_seasons(works: DataFrame, seasons: DataFrame) -> DataFrame:
    """(work_id, catalogue_id, score, season_year) of series with a year that are a season of a matched work of the same title.

    All matched series of the title have to be one catalogue entry. The year is that of the matched work with the least id, or
    one in which a season of it was first shown (``seasons``: catalogue_id, air_year). ``works`` (id, title_key, year,
    media_type, status, catalogue_id); works that are matched ask for nothing.
    """
    series = works.filter((F.col("media_type") == "tv") & (F.col("title_key") != ""))
    anchors = series.filter((F.col("status") == "matched") & F.col("catalogue_id").isNotNull()).groupBy("title_key").agg(
        F.min("catalogue_id").alias("_low"), F.max("catalogue_id").alias("_high"), F.min_by(F.struct("year"), "id").alias("_anchor")
    ).filter("_low = _high").select("title_key", F.col("_low").alias("catalogue_id"), F.col("_anchor.year").alias("_year"))
    asked = series.filter((F.col("status") != "matched") & F.col("year").isNotNull()).select(F.col("id").alias("work_id"), "title_key", "year")
    shown = seasons.select("catalogue_id", F.col("air_year").alias("year")).distinct().withColumn("_shown", F.lit(True))
    fits = asked.join(anchors, "title_key").join(shown, ["catalogue_id", "year"], "left")
    own = F.coalesce(F.col("year") == F.col("_year"), F.lit(False))
    return fits.filter(own | F.col("_shown")).select("work_id", "catalogue_id", F.lit(SIBLING_SCORE).alias("score"), (~own).alias("season_year"))


def applied_links(decisions: DataFrame, works: DataFrame, resources: DataFrame, candidates: DataFrame, catalogue: DataFrame, fields: list[str]) -> dict[str, DataFrame]:
    """The change set of confirmed identities.

    ``decisions`` (work_id, catalogue_id, media_type, confidence, method); of several for a work the surest counts, then the
    least id. ``catalogue`` (catalogue_id, media_type, seasons, ``fields``): what is copied; ``seasons`` holds the episodes of
    each season, kept for series only. Works that then share an identity are one: the least id stays, takes the fields, and
    inherits a collection. Resources of series without any number are of season 1.

    Gives ``works`` (id, catalogue_id, media_type, status, confidence, method, collection_id, seasons, fields), ``merged``
    (id, kept_id), ``resources`` (id, work_id, season), ``candidates`` (work_id, catalogue_id) that go.
    """
    chosen = decisions.groupBy("work_id").agg(F.max_by(F.struct("catalogue_id", "media_type", "confidence", "method"), F.struct("confidence", -F.col("catalogue_id"))).alias("_d")).select("work_id", "_d.*")
    linked = works.join(chosen.select(F.col("work_id").alias("id"), F.col("catalogue_id").alias("_catalogue"), F.col("media_type").alias("_type"), "confidence", "method"), "id", "left")
    linked = linked.withColumns({"catalogue_id": F.coalesce("_catalogue", "catalogue_id"), "catalogue_type": F.coalesce("_type", "catalogue_type"), "_new": F.col("_catalogue").isNotNull()})
    same = merge_map(linked, "catalogue_type", "catalogue_id").select("id", "kept_id", F.col("collection_id").alias("_collection"))
    placed = linked.join(same, "id", "left").withColumn("kept_id", F.coalesce("kept_id", "id"))
    # a work that stays changes if it, or one that goes into it, was decided on
    touched = placed.filter("_new").groupBy("kept_id", "catalogue_id", "catalogue_type").agg(F.max_by(F.struct("confidence", "method"), F.struct("confidence", -F.col("id"))).alias("_d"))
    kept = touched.join(placed.select(F.col("id").alias("kept_id"), F.coalesce("collection_id", "_collection").alias("collection_id")), "kept_id")
    details = catalogue.select("catalogue_id", F.col("media_type").alias("catalogue_type"), "seasons", *fields)
    filled = kept.join(details, ["catalogue_id", "catalogue_type"], "left")
    out = filled.select(
        F.col("kept_id").alias("id"), "catalogue_id", F.col("catalogue_type").alias("media_type"), F.lit("matched").alias("status"), F.col("_d.confidence").alias("confidence"), F.col("_d.method").alias("method"),
        "collection_id", F.when(F.col("catalogue_type") == "tv", F.col("seasons")).alias("seasons"), *fields,
    )
    owners = placed.join(touched.select("kept_id"), "kept_id", "left_semi").select(F.col("id").alias("_old"), "kept_id", (F.col("catalogue_type") == "tv").alias("_tv"))
    moved = resources.join(owners, F.col("work_id") == F.col("_old")).select(
        F.col("id"), F.col("kept_id").alias("work_id"), F.when(F.col("_tv") & F.col("season").isNull() & F.col("episode").isNull(), 1).otherwise(F.col("season")).alias("season")
    )
    gone = candidates.join(owners.select(F.col("_old").alias("work_id")), "work_id", "left_semi").select("work_id", "catalogue_id")
    return {"works": out, "merged": placed.filter("id <> kept_id").join(touched.select("kept_id"), "kept_id", "left_semi").select("id", "kept_id"), "resources": moved, "candidates": gone}


DETAIL = (
    "id long, title string, name string, original_title string, original_name string, release_date string, first_air_date string, overview string, vote_average double, "
    "origin_country array<string>, production_countries array<struct<iso_3166_1 string>>, seasons array<struct<season_number int, episode_count int, air_date string>>, "
    "alternative_titles struct<titles array<struct<title string>>, results array<struct<title string>>>, translations struct<translations array<struct<data struct<title string, name string>>>>"
)


def normalised_catalogue(raw: DataFrame) -> dict[str, DataFrame]:
    """``works``, ``titles`` and ``seasons`` of raw detail records (media_type, payload: JSON).

    Titles are the shown one, the original, alternative and translated ones, each once, the first place counts. Seasons from 1
    with an episode, by number; of one number twice the greater count. Countries are those of origin, else of production.
    What is no JSON, or has no id, is left out.
    """
    d = raw.select("media_type", F.from_json("payload", DETAIL).alias("d")).filter(F.col("d.id").isNotNull())
    none = F.array().cast("array<string>")
    lists = [F.coalesce(F.transform(F.col(p), lambda t: t["title"]), none) for p in ("d.alternative_titles.titles", "d.alternative_titles.results")]
    translated = F.flatten(F.coalesce(F.transform("d.translations.translations", lambda t: F.array(t["data"]["title"], t["data"]["name"])), F.array().cast("array<array<string>>")))
    title = F.coalesce("d.title", "d.name")
    every = F.concat(F.array(title, F.coalesce("d.original_title", "d.original_name")), *lists, translated)
    kept = F.array_distinct(F.filter(F.transform(every, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != "")))
    date = F.coalesce(F.nullif("d.release_date", F.lit("")), F.nullif("d.first_air_date", F.lit("")))
    countries = F.when(F.size(F.coalesce("d.origin_country", none)) > 0, F.col("d.origin_country")).otherwise(F.transform("d.production_countries", lambda c: c["iso_3166_1"]))
    each = d.select(F.col("d.id").alias("catalogue_id"), "media_type", title.alias("title"), date.alias("release_date"), F.col("d.overview").alias("overview"), F.col("d.vote_average").alias("vote"), F.coalesce(countries, none).alias("countries"), kept.alias("_titles"), F.col("d.seasons").alias("_seasons"))
    seasons = each.select("catalogue_id", "media_type", F.explode("_seasons").alias("s")).select("catalogue_id", "media_type", F.col("s.season_number").alias("season"), F.col("s.episode_count").alias("episodes"), year_of(F.col("s.air_date")).alias("air_year"))
    return {
        "works": each.drop("_titles", "_seasons").withColumn("year", year_of(F.col("release_date"))),
        "titles": each.select("catalogue_id", "media_type", F.posexplode("_titles").alias("place", "title")).groupBy("catalogue_id", "media_type", "title").agg(F.min("place").alias("place")),
        "seasons": seasons.filter("season >= 1 and episodes > 0").groupBy("catalogue_id", "media_type", "season").agg(F.max("episodes").alias("episodes"), F.min("air_year").alias("air_year")),
    }


def year_of(date: Column) -> Column:
    """The year that a date begins with, of 19xx or 20xx."""
    return F.when(date.rlike("^(?:19|20)[0-9]{2}"), F.substring(date, 1, 4).cast("int"))
