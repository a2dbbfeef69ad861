"""Episode coverage: spans, contiguity, run labels, grids, dominant names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions.numeric import count_where
from ..functions.text import episode_label, padded, range_label, title_key
from .keyed import runs

def coverage(spans: DataFrame, keys: list[str]) -> DataFrame:
    """First, last and distinct episodes per key, and whether nothing is missing between.

    From (keys, first, last) spans of any length: what a span adds is what it has beyond all spans that begin before
    it, so no span is ever spread out.
    """
    before = Window.partitionBy(*keys).orderBy("first", "last").rowsBetween(Window.unboundedPreceding, -1)
    seen = spans.filter(F.col("last") >= F.col("first")).select(*keys, "first", "last").distinct().withColumn("_reach", F.max("last").over(before))
    added = F.greatest(F.lit(0), F.col("last") - F.greatest("first", F.coalesce(F.col("_reach") + 1, "first")) + 1)
    return seen.groupBy(*keys).agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.sum(added).alias("episodes")
    ).withColumn("contiguous", F.col("last") - F.col("first") + 1 == F.col("episodes"))


def run_labels(df: DataFrame, keys: list[str], number: str, prefix: str, pad: bool, out: str) -> DataFrame:
    """``E01-E05 E07`` per key from a set of numbers."""
    islands = runs(df, keys, number)
    entry = F.struct(F.col("first"), range_label(prefix, F.col("first"), F.col("last"), pad).alias("text"))
    return islands.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), " ").alias(out)
    )


def episode_labels(resources: DataFrame) -> DataFrame:
    """Label of every resource from its season, season range and episode range."""
    return resources.withColumn(
        "episode_label", episode_label(F.col("season"), F.col("season_end"), F.col("episode"), F.col("episode_end"))
    )


def owner_labels(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, labels): what the rows of each key are of, in one line.

    ``rows``: season, season_end, episode, episode_end. Episode ranges, single episodes, season ranges and runs of whole seasons, each sorted;
    a whole season that a range covers, or of which there are episodes, has no label. Rows are distinct before any list is made.
    """
    d = rows.select(*keys, "season", "season_end", "episode", "episode_end").distinct()
    numbered = d.filter(F.col("season").isNotNull() & F.col("episode").isNotNull())
    ranged = F.col("episode_end") > F.col("episode")
    each = padded("S", F.col("season")), padded("E", F.col("episode"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    label = lambda rank, a, b, c, text: F.struct(F.lit(rank).alias("rank"), number(a).alias("a"), number(b).alias("b"), number(c).alias("c"), text.alias("text"))
    s, e, none = F.col("season"), F.col("episode"), F.lit(0)
    episodes = numbered.select(
        *keys, F.when(ranged, label(0, s, e, F.col("episode_end"), F.concat(*each, F.lit("-"), padded("E", F.col("episode_end"))))).otherwise(label(1, s, e, none, F.concat(*each))).alias("_l")
    )
    plain = lambda c: F.concat(F.lit("S"), c.cast("string"))
    spans = d.filter(F.col("season_end") > s).select(*keys, s.alias("_a"), F.col("season_end").alias("_b")).distinct()
    seasons = spans.select(*keys, label(2, F.col("_a"), F.col("_b"), none, F.concat(plain(F.col("_a")), F.lit("-"), plain(F.col("_b")))).alias("_l"))
    covered = spans.select(*keys, F.explode(F.sequence("_a", "_b")).alias("season")).unionByName(numbered.select(*keys, "season")).distinct()
    whole = d.filter(s.isNotNull() & e.isNull()).select(*keys, "season").distinct()
    conditions = [*[whole[k].eqNullSafe(covered[k]) for k in keys], whole.season == covered.season]
    alone = runs(whole.join(covered, conditions, "left_anti"), keys, "season")
    islands = alone.select(
        *keys, label(3, F.col("first"), none, none, F.when(F.col("first") == F.col("last"), plain(F.col("first"))).otherwise(F.concat(plain(F.col("first")), F.lit("-"), plain(F.col("last"))))).alias("_l")
    )
    every = episodes.unionByName(seasons).unionByName(islands).distinct()
    return every.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_l")), lambda x: x["text"]), " · ").alias("labels"))


def capped_labels(resources: DataFrame, keep: int = 6) -> DataFrame:
    """The number of a work's labels and the line that shows them.

    Single episodes and ranges (``episode`` to ``episode_end``, if that is later) are shown up to ``keep``, with the
    total behind; all whole-season labels are shown, but only where no resource has an episode.
    """
    end = F.greatest("episode", "episode_end")
    tail = F.when(end > F.col("episode"), F.concat(F.lit("-"), padded("E", end))).otherwise(F.lit(""))
    label = F.when(
        F.col("episode").isNotNull(), F.concat(padded("S", F.coalesce("season", F.lit(1))), padded("E", F.col("episode")), tail)
    ).when(F.col("season").isNotNull(), F.concat(padded("S", F.col("season")), F.lit(rules.WHOLE_SEASON)))
    each = resources.select("work_id", F.col("episode").isNotNull().alias("_single"), label.alias("_label")).distinct()
    work = Window.partitionBy("work_id")
    ranked = each.withColumns({
        "_numbered": F.max("_single").over(work),
        "_rank": F.row_number().over(Window.partitionBy("work_id", "_single").orderBy("_label")),
        "_count": F.count("_label").over(Window.partitionBy("work_id", "_single")),
    }).filter((F.col("_single") == F.col("_numbered")) & (~F.col("_single") | (F.col("_rank") <= keep)))
    found = ranked.groupBy("work_id").agg(
        F.max("_count").alias("labels"), F.max("_single").alias("_single"),
        F.array_join(F.array_sort(F.collect_list("_label")), rules.LABEL_SEPARATOR).alias("_shown"),
    )
    more = F.format_string(rules.LABEL_TOTAL, F.col("labels"))
    shown = F.when(F.col("_single") & (F.col("labels") > keep), F.concat("_shown", more)).when(F.col("labels") == 0, rules.NO_LABEL).otherwise(F.col("_shown"))
    return found.select("work_id", "labels", shown.alias("shown"))


def season_grid(spans: DataFrame, packs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Every episode 1..max(baseline, owned) of a season and how it is owned.

    ``spans`` (work_id, season, first, last), ``packs`` (work_id, season) whole-season
    resources, ``baseline`` (work_id, season, episode_count). A span that ends before it begins is its first
    episode. A pack covers the baseline where one is known, else everything.
    """
    keys = ["work_id", "season"]
    owned = spans.filter(F.col("first").isNotNull()).select(
        *keys, "first", F.greatest("first", "last").alias("last"), F.when(F.col("last") > F.col("first"), 2).otherwise(1).alias("_how")
    ).distinct()
    each = owned.select(*keys, F.explode(F.sequence("first", "last")).alias("episode"), "_how").groupBy(*keys, "episode").agg(F.min("_how").alias("_how"))
    longest = owned.groupBy(*keys).agg(F.max("last").alias("_owned"))
    pack = packs.select(*keys).distinct().withColumn("_pack", F.lit(True))
    known = baseline.select(*keys, F.nullif(F.col("episode_count").cast("int"), F.lit(0)).alias("_known"))
    seasons = longest.join(known, keys, "full").join(pack, keys, "left")
    end = F.greatest(F.coalesce("_known", F.lit(0)), F.coalesce("_owned", F.lit(0)))
    cells = seasons.filter(end > 0).select(*keys, "_pack", "_known", F.explode(F.sequence(F.lit(1), end)).alias("episode"))
    packed = F.col("_pack") & (F.col("_known").isNull() | (F.col("episode") <= F.col("_known")))
    state = F.when(F.col("_how") == 1, "single").when(F.col("_how") == 2, "range").when(packed, "pack").otherwise("missing")
    return cells.join(each, [*keys, "episode"], "left").select(*keys, "episode", state.alias("state"))


def dominant_names(files: DataFrame, group: str, name: Column, least: int = 2, share: float = 0.5) -> DataFrame:
    """Names that make up at least half of a group and occur at least twice."""
    counted = (
        files.select(group, title_key(name).alias("name_key"), name.alias("name"))
        .filter(F.col("name_key") != "")
        .groupBy(group, "name_key").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    )
    total = counted.groupBy(group).agg(F.sum("n").alias("total"))
    return counted.join(total, group).filter((F.col("n") >= least) & (F.col("n") >= F.col("total") * share))


def group_examples(df: DataFrame, label: Column, example: Column, keep: int = 5) -> DataFrame:
    """Group counts with at most ``keep`` smallest examples each."""
    rows = df.select(label.alias("label"), example.alias("example"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("example"))
    head = rows.withColumn("_k", rank).filter(F.col("_k") <= keep).groupBy("label").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("example")), lambda x: x.cast("string")), ",").alias("examples")
    )
    return counts.join(head, "label")


def run_status(outcomes: DataFrame) -> DataFrame:
    """Totals of a matching run, one row."""
    s = F.col("status")
    return outcomes.agg(
        F.count(F.lit(1)).alias("processed"),
        *[count_where(s == n).alias(n) for n in ("matched", "review", "not_found", "error")],
    )
