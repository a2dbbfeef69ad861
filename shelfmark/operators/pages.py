"""Expansion of messages by the pages that they link to, and the pages those link to.

The pages of all messages are followed together, a level at a time: each level joins what the last one found to the
page table and leaves out what a message has seen. A page is found by its shortest way, of these by the first links,
which is the order of a queue for each message.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import blank_to_null
from ..session import cut_lineage

#: Levels after which a chain of pages without end is given up with an error, not cut.
MOST_LEVELS = 1_000


def page_links(text: Column, hosts: tuple[str, ...] = rules.PAGE_HOSTS) -> Column:
    """The addresses of pages on allowed hosts that a text mentions, in order, each once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rules.PAGE_LINK), F.lit(0)), lambda u: F.regexp_replace(u, rules.PAGE_LINK_END, ""))
    allowed = F.filter(found, lambda u: F.lower(u).startswith("https://") & F.coalesce(urls.host(u).isin(*hosts), F.lit(False)) & u.rlike("^[^:]+://[^/?#]+/"))
    return F.array_distinct(allowed)


def source_lines(lines: Column) -> Column:
    """Lines that begin with a share or a hash link."""
    return F.filter(lines, lambda x: x.rlike(f"^(?:{rules.SHARE_LINK})") | x.rlike(rules.HASH_START))


def reached(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, url, way) of every page that a message leads to, over any number of links.

    ``starts`` (id, ord, url): the links of messages in order. ``pages`` (url, links): rows with one url are one page with
    all their links. ``way``: the places of the links that lead there. Links to pages that are not in the
    table are reached and lead nowhere. Cycles end where a message has seen a page.
    """
    link = pages.select(F.col("url").alias("_from"), F.posexplode("links").alias("_place", "_to")).filter(F.col("_to").isNotNull())
    link = cut_lineage(link.groupBy("_from", "_to").agg(F.min("_place").alias("_place")))
    first = starts.filter(F.col("url").isNotNull()).groupBy("id", "url").agg(F.min(F.array(F.col("ord").cast("int"))).alias("way"))
    levels = [cut_lineage(first)]
    while not levels[-1].isEmpty():
        if len(levels) > MOST_LEVELS:
            raise RuntimeError(f"pages lead on after {MOST_LEVELS} links")
        step = levels[-1].join(link, F.col("url") == F.col("_from")).select("id", F.col("_to").alias("url"), F.concat("way", F.array("_place")).alias("way"))
        seen = reduce(DataFrame.unionAll, levels).select("id", "url")
        levels.append(cut_lineage(step.groupBy("id", "url").agg(F.min("way").alias("way")).join(seen, ["id", "url"], "left_anti")))
    return reduce(DataFrame.unionAll, levels)


def sections(messages: DataFrame, pages: DataFrame, reach: DataFrame) -> DataFrame:
    """(id, url, way, heading, lines): what each page adds to a message.

    ``messages`` (id, text, inherited): a heading that a message hands on goes before a page's title; a page without
    either takes the last heading above its link, of a page that others lead to the last one of the text. ``pages``
    (url, title, lines). Pages without source lines stay if they lead to further ones.
    """
    leads = reach.filter(F.size("way") > 1).select("id", F.slice("way", F.lit(1), F.size("way") - 1).alias("way")).distinct().withColumn("_leads", F.lit(True))
    one = pages.groupBy("url").agg(F.min(F.struct("title", "lines")).alias("_p")).select("url", "_p.*")
    text = F.coalesce("text", F.lit(""))
    joined = reach.join(one, "url").join(leads, ["id", "way"], "left").join(messages.select("id", "text", "inherited"), "id")
    place = F.instr(text, F.col("url"))
    above = F.when(place > 0, F.substring(text, F.lit(1), place - 1)).otherwise(text)
    heading = F.trim(F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(above, F.lit(rules.PAGE_HEADING), F.lit(1))), -1))
    titled = F.regexp_replace(F.trim("title"), rules.PAGE_TITLE_END, "")
    iconed = F.when(urls.host(F.col("url")).isin(*rules.ICON_PAGE_HOSTS), F.concat(F.lit("📺 "), titled)).otherwise(titled)
    shown = joined.withColumns({
        "heading": F.coalesce(blank_to_null(F.col("inherited")), F.when(titled != "", iconed), heading), "lines": source_lines(F.coalesce("lines", F.array().cast("array<string>"))),
    })
    return shown.filter((F.size("lines") > 0) | F.col("_leads")).select("id", "url", "way", "heading", "lines")


def expanded(messages: DataFrame, pages: DataFrame, hosts: tuple[str, ...] = rules.PAGE_HOSTS) -> DataFrame:
    """``messages`` (id, text, inherited) with ``expanded``: the text, then each page's heading and source lines.

    ``pages`` (url, title, links, lines); a page leads to the links on allowed hosts. A message is bounded at intake,
    and so is what one leads to in practice: its sections are put together in one row.
    """
    starts = messages.select("id", F.posexplode(page_links(F.col("text"), hosts)).alias("ord", "url"))
    kept = pages.withColumn("links", F.array_distinct(F.flatten(F.transform("links", lambda u: page_links(u, hosts)))))
    added = sections(messages, pages, reached(starts, kept))
    body = F.concat_ws("\n", "heading", F.array_join("lines", "\n"))
    whole = added.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.size("way").alias("n"), "way", body.alias("body")))).alias("_s"))
    joined = messages.join(whole, "id", "left")
    return joined.withColumn("expanded", F.concat_ws("\n", F.concat(F.array(F.coalesce("text", F.lit(""))), F.coalesce(F.transform("_s", lambda s: s["body"]), F.array().cast("array<string>"))))).drop("_s")
