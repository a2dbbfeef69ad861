"""Identity of files by their names, their directory and what is known of its other files."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.text import first_int, first_match, written_number

#: Files of a directory whose order is worked out together.
BLOCK = 65_536


@dataclass(frozen=True)
class EpisodeRule:
    """A user's rule: a pattern, and which groups have the season and the episode.

    Without ``season_group`` the season is ``default_season``.
    """

    pattern: str
    episode_group: int = 1
    season_group: int | None = None
    default_season: int = 1
    enabled: bool = True


def _numbered(season: Column, episode: Column, *tags: str) -> Column:
    return F.struct(season.cast("int").alias("season"), episode.cast("int").alias("episode"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("evidence"))


def ruled_episode(text: Column, user_rules: Sequence[EpisodeRule]) -> Column:
    """Struct(season, episode, evidence) by the first enabled rule whose pattern is found and whose groups are numbers, else null.

    The rules become one expression; their order is that of the sequence.
    """
    hits = []
    for rule in user_rules:
        if not rule.enabled:
            continue
        number = lambda group: first_int(text, rule.pattern, group)  # noqa: B023, E731
        episode = number(rule.episode_group)
        season = F.lit(rule.default_season) if rule.season_group is None else number(rule.season_group)
        hits.append(F.when(text.rlike(rule.pattern) & (season >= 0) & (episode >= 0), _numbered(season, episode, "episode_regex")))
    return F.coalesce(*hits) if hits else F.lit(None).cast("struct<season:int,episode:int,evidence:array<string>>")


def built_in_episode(text: Column) -> Column:
    """Struct(season, episode, evidence) by the built-in forms; nulls and no evidence where none is found.

    ``S01E02`` and ``1x02`` say all. Else season and episode are looked for apart: words, written numbers, dates as
    episodes, special ones (season 0); an episode without a season is of the first.
    """
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("/"))
    bare = first_int(F.trim(t), rules.BARE_SEASON)
    season_word, season_zh = first_int(t, rules.SEASON_WORD), written_number(first_match(t, rules.SEASON_ZH))
    date = F.coalesce(*[F.nullif(F.concat(*[F.regexp_extract(t, p, k) for k in (1, 2, 3)]), F.lit("")) for p in rules.DATE_EPISODES]).try_cast("int")
    forms = [(first_int(t, rules.EPISODE_WORD), "episode_word"), (first_int(t, rules.EPISODE_E), "episode_e"), (written_number(first_match(t, rules.EPISODE_ZH)), "episode_zh"), (date, "episode_date")]
    special = t.rlike(rules.SPECIAL_WORD) | t.rlike(rules.SPECIAL_ZH)
    code = first_int(t, rules.SPECIAL_CODE)
    plain = F.coalesce(*[c for c, _ in forms])
    episode = F.coalesce(plain, code)
    season = F.coalesce(season_word, season_zh, F.when(special, F.lit(0)), F.when(episode.isNotNull() & t.rlike(rules.FIRST_SEASON_FLAG), F.lit(1)))
    said = F.array(
        F.when(season_word.isNotNull(), F.lit("season_word")).when(season_zh.isNotNull(), F.lit("season_zh")),
        F.coalesce(*[F.when(c.isNotNull(), F.lit(tag)) for c, tag in forms]),
        F.when(special | (plain.isNull() & code.isNotNull()), F.lit("special")),
        F.when(plain.isNull() & code.isNotNull(), F.lit("episode_special_code")),
    )
    apart = F.struct(season.cast("int").alias("season"), episode.cast("int").alias("episode"), F.array_compact(said).alias("evidence"))
    both = first_int(t, rules.SEASON_EPISODE, 1), first_int(t, rules.SEASON_EPISODE, 2)
    crossed = first_int(t, rules.SEASON_X_EPISODE, 1), first_int(t, rules.SEASON_X_EPISODE, 2)
    return F.coalesce(
        F.when(both[0].isNotNull(), _numbered(*both, "sxe")), F.when(crossed[0].isNotNull(), _numbered(*crossed, "season_episode_x")),
        F.when(bare.isNotNull(), _numbered(bare, F.lit(None), "season_word")), apart,
    )


def structured_episode(text: Column, user_rules: Sequence[EpisodeRule] = ()) -> Column:
    """A user's rules first, in their order, then the built-in forms."""
    return F.coalesce(ruled_episode(text, user_rules), built_in_episode(text))


def running_last(df: DataFrame, keys: list[str], order: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """``df`` with the last value that is not null before each row of its group.

    ``order`` numbers the rows of a group. Groups are cut into blocks of ``block`` numbers, so that a group with a third of
    all rows is no single task's; what one block hands on to the next is a row.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / block))
    here = Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    handed = cut.groupBy(*keys, "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_value"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    handed = handed.withColumn("_handed", F.last("_value", ignorenulls=True).over(before)).drop("_value")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    handed = handed.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_b"), "_handed")
    joined = cut.withColumn("_here", F.last(value, ignorenulls=True).over(here)).join(handed, on, "left")
    return joined.withColumn(out, F.coalesce("_here", "_handed")).drop("_block", "_b", "_here", "_handed", *[f"_{k}" for k in keys])


# How sure each tier is.
EXPLICIT_SURE, PART_SURE = 0.99, 0.97
TIERS = ("explicit", "series_batch_identity", "official_collection_part", "variants")


def cascade(files: DataFrame, parts: DataFrame, hits: DataFrame, floor: float, margin: float, block: int = BLOCK) -> DataFrame:
    """(id, catalogue_id, tier, confidence, status) of each file by the first tier that says something.

    ``files`` (id, ord, directory, year, media_type, explicit_id): an explicit id; else, of tv files, what an earlier file
    of the same directory and year was matched with; else ``parts`` (id, catalogue_id), its part of a collection; else
    the best of ``hits`` (id, catalogue_id, confidence, exact), exact ones first, then the least id. ``ord`` numbers the
    files of a directory (``block``: see ``running_last``). A file is matched if its identity is of ``floor`` at least and ``margin`` above the next hit;
    only those are handed on. Files without any identity are unmatched.
    """
    # a hit is kept as three values until all of its file's are there
    each = hits.groupBy("id").agg(F.collect_list(F.struct("exact", "confidence", (-F.col("catalogue_id")).alias("order"))).alias("_hits"))
    top, sure = F.array_max("_hits"), F.transform("_hits", lambda h: h["confidence"])
    best = each.select(
        "id", F.struct((-top["order"]).alias("catalogue_id"), top["confidence"].alias("confidence")).alias("_best"),
        F.slice(F.sort_array(F.array_compact(sure), asc=False), 1, 2).alias("_two"), F.size("_hits").alias("_n"),
    )
    part = parts.groupBy("id").agg(F.min("catalogue_id").alias("_part"))
    known = files.join(part, "id", "left").join(best, "id", "left")
    told = lambda i, tier, sure: F.struct(i.cast("long").alias("catalogue_id"), F.lit(tier).alias("tier"), sure.alias("confidence"))
    next_ = F.when(F.col("_n") < 2, None).when(F.get("_two", F.lit(0)) > F.col("_best.confidence"), F.get("_two", F.lit(0))).otherwise(F.get("_two", F.lit(1)))
    explicit = F.when(F.col("explicit_id").isNotNull(), told(F.col("explicit_id"), TIERS[0], F.lit(EXPLICIT_SURE)))
    own = F.coalesce(
        explicit, F.when(F.col("_part").isNotNull(), told(F.col("_part"), TIERS[2], F.lit(PART_SURE))),
        F.when(F.col("_best").isNotNull(), told(F.col("_best.catalogue_id"), TIERS[3], F.col("_best.confidence"))),
    )
    alone = own["tier"] != TIERS[3]
    sure = (own["confidence"] >= floor) & (alone | next_.isNull() | (own["confidence"] - next_ >= margin))
    rows = known.withColumn("_own", own).withColumn("_matched", F.coalesce(sure, F.lit(False)))
    shares = (F.col("media_type") == "tv") & F.col("directory").isNotNull()
    # the first matched file founds a directory's identity; after it only explicit ids change it
    founds = rows.filter(F.col("_matched") & shares).groupBy("directory", "year").agg(F.min("ord").alias("_founder"))
    on = F.col("directory").eqNullSafe(F.col("_directory")) & F.col("year").eqNullSafe(F.col("_year"))
    rows = rows.join(founds.select(F.col("directory").alias("_directory"), F.col("year").alias("_year"), "_founder"), on, "left").drop("_directory", "_year")
    hands = F.when(shares & ((F.col("ord") == F.col("_founder")) | (F.col("explicit_id").isNotNull() & F.col("_matched"))), F.struct(F.col("_own.catalogue_id").alias("i"), F.col("_own.confidence").alias("c")))
    rows = running_last(rows.withColumn("_hands", hands), ["directory", "year"], "ord", "_hands", "_held", block)
    shared = F.when(shares & explicit.isNull() & F.col("_held").isNotNull(), told(F.col("_held.i"), TIERS[1], F.col("_held.c")))
    final = F.coalesce(shared, F.col("_own"))
    status = F.when(shared.isNotNull() | F.col("_matched"), "matched").when(F.col("_own").isNotNull(), "review").otherwise("unmatched")
    return rows.withColumn("_final", final).select("id", "_final.*", status.alias("status"))
