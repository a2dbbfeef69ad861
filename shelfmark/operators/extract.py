"""From messages to link rows: lines, headings, access codes, keys, labelled fields, ids.

A message is bounded (512 KiB at intake), so its lines are handled as an array inside its own
row: no shuffle is needed to find the heading above a link. Only the small structs built from
the array are exploded, never the array itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import rules
from ..functions import urls
from ..functions.text import blank_to_null, channel_identity, clean_person_name, let, title_key

FIRST_CLASS = ("share", "ed2k", "mixed", "unknown")


def lines_of(text: Column) -> Column:
    return F.split(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n")


def explode_lines(messages: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Ordered lines: (key, line_no, line)."""
    return messages.select(key, F.posexplode(lines_of(F.col(text))).alias("line_no", "line"))


def message_kind(text: Column) -> Column:
    share, hashed = text.rlike(rules.SHARE_LINK), text.rlike(rules.HASH_LINK)
    return F.when(share & hashed, "mixed").when(share, "share").when(hashed, "ed2k").otherwise("unknown")


def is_generic_label(label: Column) -> Column:
    """A link's own label says nothing: empty, an arrow, a 'click here'."""
    compact = F.regexp_replace(F.regexp_replace(F.trim(label), r"(?U)[\s:：|→>\-]+", ""), "🔗", "")
    head = F.ltrim(label)
    return (
        compact.isin("", *rules.GENERIC_LABELS)
        | head.startswith(rules.GENERIC_PREFIXES[0]) | head.startswith(rules.GENERIC_PREFIXES[1])
        | F.contains(label, F.lit(rules.GENERIC_PHRASE))
    )


def is_metadata_line(line: Column) -> Column:
    return line.rlike("^(?:" + "|".join(rules.METADATA_PREFIXES) + ")")


def is_heading_line(line: Column) -> Column:
    return line.rlike(rules.LINE_ICON) & ~line.rlike(rules.CATEGORY_LINE) & ~is_metadata_line(line)


def nearest_heading(lines: DataFrame, keys: list[str], order: str, line: str, heading: Column) -> DataFrame:
    """Window form for line tables: last heading above each line, and the line below it."""
    w = Window.partitionBy(*keys).orderBy(order)
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumns({
        "heading": F.last(F.when(heading, F.col(line)), ignorenulls=True).over(above),
        "next_line": F.lead(line).over(w),
    })


def _below(positions: Column, limit: Column) -> Column:
    return F.array_max(F.filter(positions, lambda p: p < limit))


def _block(lines: Column, start: Column, stop: Column) -> Column:
    """Non-empty trimmed lines from ``start`` up to before ``stop`` (0-based)."""
    part = F.filter(F.transform(F.slice(lines, start + 1, stop - start), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(start.isNotNull(), F.array_join(part, "\n"))


def link_lines(messages: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per link with its line, label, heading block and next line.

    ``channel_specific`` (boolean) and ``person_context`` (string) columns are honoured when
    present: the first skips a channel's attribute lines, the second replaces the heading.
    """
    specific = F.col("channel_specific") if "channel_specific" in messages.columns else F.lit(False)
    person = F.col("person_context") if "person_context" in messages.columns else F.lit(None).cast("string")
    # what a text does not hold is not looked for in its lines
    told = messages.withColumns({"_shared": F.col(text).rlike(rules.SHARE_LINK), "_hashed": F.col(text).rlike(rules.HASH_LINK)})
    numbered = told.filter("_shared or _hashed").select(
        *keep, lines_of(F.col(text)).alias("_lines"), specific.alias("_specific"), person.alias("_person"), "_shared", "_hashed"
    )
    trimmed = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("t")))

    def positions(test):
        return F.transform(F.filter("_trimmed", test), lambda e: e["i"])

    marked = numbered.withColumn("_trimmed", trimmed).withColumn("_headings", positions(
        lambda e: F.col("_shared") & is_heading_line(e["t"]) & ~(F.col("_specific") & e["t"].rlike(rules.CHANNEL_ATTRIBUTE))
    )).select(
        *keep, "_lines", "_person", "_specific", "_shared", "_hashed", "_headings",
        # a heading in the first line is above every other line, whatever else could be used
        F.when(F.coalesce(F.get("_headings", F.lit(0)) != 0, F.lit(True)), positions(
            lambda e: F.col("_shared") & (e["t"] != "") & ~is_metadata_line(e["t"]) & ~e["t"].rlike(rules.SHARE_LINK)
        )).alias("_usable"),
        positions(lambda e: F.col("_hashed") & (e["t"] != "") & ~F.lower(e["t"]).startswith("ed2k://")).alias("_solid"),
    )
    indexed = F.transform("_lines", lambda x, i: F.struct(i.alias("i"), x.alias("line")))

    def share(e):
        link = F.regexp_extract(e["line"], f"({rules.SHARE_LINK})", 1)
        label = F.trim(F.split_part(F.regexp_replace(F.regexp_extract(e["line"], f"^(.*?){rules.SHARE_LINK}", 1), "^[﻿ \t]+", ""), F.lit("\t"), F.lit(1)))
        suffix = F.trim(F.regexp_extract(e["line"], f"{rules.SHARE_LINK}(.*)$", 1))
        first = F.when(F.get(F.col("_usable"), F.lit(0)) < e["i"], F.get(F.col("_usable"), F.lit(0)))
        block = let(F.coalesce(_below(F.col("_headings"), e["i"]), first), lambda start: _block(F.col("_lines"), start, e["i"]))

        def of(own):
            label, suffix = own["label"], own["suffix"]
            context = F.coalesce(F.col("_person"), F.when(is_generic_label(label) | F.col("_specific"), block))
            return F.struct(
                e["i"].alias("line_no"), F.lit(0).alias("pos"), F.lit("share").alias("link_kind"), e["line"].alias("line"), link.alias("link"),
                F.when(label == "", suffix).otherwise(label).alias("label"), context.alias("context"), suffix.alias("suffix"),
                F.get(F.col("_lines"), e["i"] + 1).alias("next_line"),
            )

        return let(F.struct(label.alias("label"), suffix.alias("suffix")), of)

    def hashed(e):
        line = F.trim(F.get(F.col("_lines"), _below(F.col("_solid"), e["i"])))
        heading = let(line, lambda above: F.coalesce(F.col("_person"), F.when(above.rlike(r"^[📺🎥👤🗂]"), above)))
        return let(heading, lambda context: F.transform(
            F.regexp_extract_all(e["line"], F.lit(f"({rules.HASH_LINK})"), F.lit(1)),
            lambda link, k: F.struct(
                e["i"].alias("line_no"), k.alias("pos"), F.lit("ed2k").alias("link_kind"), e["line"].alias("line"), link.alias("link"),
                F.lit("").alias("label"), context.alias("context"), F.lit("").alias("suffix"), F.lit(None).cast("string").alias("next_line"),
            ),
        ))

    shares = F.transform(F.filter(indexed, lambda e: F.col("_shared") & e["line"].rlike(rules.SHARE_LINK)), share)
    hashes = F.flatten(F.transform(F.filter(indexed, lambda e: F.col("_hashed") & e["line"].rlike(rules.HASH_LINK)), hashed))
    rows = marked.select(*keep, F.concat(shares, hashes).alias("_links"))
    # outer, as a plain explode of a column makes Spark test its size first, for which it makes all links of each message twice
    return rows.select(*keep, F.explode_outer("_links").alias("_l")).filter(F.col("_l").isNotNull()).select(*keep, "_l.*")


def link_heading(label: Column, context: Column, specific: Column | None = None, person: Column | None = None) -> Column:
    """The block a link's attributes are read from, null when its own label serves."""
    specific = F.lit(False) if specific is None else specific
    person = F.lit(None).cast("string") if person is None else person
    use = context.isNotNull() & (person.isNotNull() | is_generic_label(label))
    attribute = specific & F.coalesce(context, F.lit("")).rlike(rules.CHANNEL_ATTRIBUTE)
    return F.when(use & ~attribute, context)


def with_keys(links: DataFrame) -> DataFrame:
    """Canonical URL, provider and key of every link row.

    The access code may stand in the line, in the heading block, or on the next line.
    """
    near = F.when(F.col("next_line").rlike(rules.ACCESS_CODE), F.col("next_line"))
    haystack = F.concat_ws("\n", "line", "context", near)
    links = links.withColumns({"_code": F.regexp_extract(haystack, rules.ACCESS_CODE, 1), "_bare": F.regexp_replace("link", "[，。；;）)]+$", "")})
    url = F.when(F.col("link_kind") == "ed2k", F.col("link")).otherwise(
        urls.drop_empty_fragment(urls.with_access_code(F.col("_bare"), F.nullif(F.col("_code"), F.lit(""))))
    )
    parts = F.split("link", r"\|")
    hashed = F.upper(F.get(parts, F.lit(4)))
    out = links.withColumn("url", url).drop("_code", "_bare").withColumn("provider", F.when(F.col("link_kind") == "ed2k", "ed2k").otherwise(urls.provider_of(F.col("url"))))
    return out.withColumns({
        "source_key": F.when(F.col("link_kind") == "ed2k", F.concat(F.lit("ed2k:"), hashed)).otherwise(F.concat_ws(":", "provider", "url")),
        "filename": F.when(F.col("link_kind") == "ed2k", urls.decoded(F.get(parts, F.lit(2)))),
        "file_size": F.when(F.col("link_kind") == "ed2k", F.get(parts, F.lit(3)).try_cast("bigint")),
        "file_hash": F.when(F.col("link_kind") == "ed2k", hashed),
    })


def extract_links(messages: DataFrame, text: str = "text", keep: tuple[str, ...] = ("id",), columns: tuple[str, ...] | None = None) -> DataFrame:
    """Link rows with canonical keys; within a message the first occurrence of a key wins. ``columns``: those to carry, else all."""
    keyed = with_keys(link_lines(messages, text, keep))
    first = F.min_by(F.struct(*(columns or [c for c in keyed.columns if c not in (*keep, "source_key")])), F.struct("line_no", "pos"))
    return keyed.groupBy(*keep, "source_key").agg(first.alias("_f")).select(*keep, "source_key", "_f.*")


def channel_specific(messages: DataFrame, channel_rules: DataFrame) -> DataFrame:
    """Flag messages of channels that own a rule: by username, by name, or by URL path.

    ``channel_rules`` (identity, rule) is a small table of configured channels.
    """
    r = channel_rules.select(channel_identity(F.col("identity")).alias("_identity"), "rule").dropDuplicates(["_identity"])
    by_path = F.get(urls.path_parts(F.col("message_url")), F.lit(0))
    out = messages
    for name, column in (("_u", F.col("channel_username")), ("_n", F.col("channel_name")), ("_p", by_path)):
        hit = r.select(F.col("_identity").alias(f"{name}_id"), F.col("rule").alias(f"{name}_rule"))
        out = out.join(hit, channel_identity(column) == F.col(f"{name}_id"), "left").drop(f"{name}_id")
    return out.withColumn("rule", F.coalesce("_u_rule", "_n_rule", "_p_rule")).drop("_u_rule", "_n_rule", "_p_rule")


# Icons that end the name in a one-line profile, and its three fields.
PROFILE_MARKERS = "🎂🏠📚🔖🤖🔍✈️📎🍿🍄"
PROFILE_FIELDS = (("生日", "🎂"), ("出生地", "🏠"), ("代表作", "📚"))


def person_context(text: Column) -> Column:
    """Heading of a profile message: the cleaned name and its labelled fields, else null."""
    profile = F.regexp_extract(text, r"(?m)^\s*👤\s*(.+?)\s*$", 1)
    name = clean_person_name(F.regexp_replace(profile, rf"\s*[{PROFILE_MARKERS}](?s:.*)", ""))
    fields = []
    for label, icon in PROFILE_FIELDS:
        value = F.trim(F.regexp_extract(text, rf"(?s)(?:{icon}\s*)?{label}\s*[：:]\s*(.*?)(?=\s*[{PROFILE_MARKERS}]|\z)", 1))
        fields.append(F.when(value != "", F.concat(F.lit(f"{icon} {label}："), value)))
    return F.when((profile != "") & (name != ""), F.concat_ws("\n", F.concat(F.lit("👤 "), name), *fields))


def labelled_fields(text: Column) -> Column:
    """Map of ``label: value`` lines; known labels renamed, repeats joined by a newline."""
    known = F.create_map(*[F.lit(x) for pair in rules.LABELS.items() for x in pair])
    pattern = r"(?U)^\s*[^\w一-鿿]*([^：:]{1,12})\s*[：:]\s*(.*?)\s*$"

    def entry(line):
        label = F.trim(F.regexp_extract(line, pattern, 1))
        named = F.coalesce(F.try_element_at(known, label), F.concat(F.lit("label_"), title_key(label, exact=False)))
        return F.struct(named.alias("key"), F.trim(F.regexp_extract(line, pattern, 2)).alias("value"))

    entries = F.filter(F.transform(lines_of(text), lambda x: entry(F.trim(x))), lambda e: e["value"] != "")
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    joined = F.transform(
        keys, lambda k: F.array_join(F.transform(F.filter(entries, lambda e: e["key"] == k), lambda e: e["value"]), "\n")
    )
    return F.map_from_arrays(keys, joined)


def explicit_ids(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Explicit catalogue ids in order of position; a typed mention beats an untyped one.

    The text is cut into the pieces between mentions by one alternation, which keeps the
    order of mentions without positions.
    """
    body = urls.decoded(F.col(text))
    mention = F.regexp_extract_all(body, F.lit(f"({rules.TYPED_ID}|{rules.URL_ID}|{rules.PLAIN_ID})"), F.lit(1))

    def target(m):
        kind = F.lower(F.coalesce(
            F.nullif(F.regexp_extract(m, rules.TYPED_ID, 1), F.lit("")), F.nullif(F.regexp_extract(m, rules.URL_ID, 1), F.lit(""))
        ))
        return F.struct(
            F.regexp_extract(m, r"(\d+)\s*\}?$", 1).try_cast("bigint").alias("catalogue_id"),
            F.when(kind.isin("tv", "剧集"), "tv").when(kind.isNotNull(), "movie").alias("media_type"),
        )

    rows = df.filter(body.rlike(f"{rules.URL_ID}|{rules.PLAIN_ID}")).select(*keys, F.posexplode(F.transform(mention, target)).alias("pos", "t"))
    rows = rows.select(*keys, "pos", "t.*").filter(F.col("catalogue_id").isNotNull())
    return rows.groupBy(*keys, "catalogue_id").agg(
        F.min("pos").alias("pos"),
        F.max_by("media_type", F.when(F.col("media_type").isNotNull(), F.col("pos"))).alias("media_type"),
    )


def usable_buttons(buttons: Column) -> Column:
    """Button links worth keeping: share and hash links and plain https pages."""
    return F.filter(buttons, lambda b: b.rlike(rules.SHARE_LINK) | b.rlike(rules.HASH_LINK) | b.rlike(r"(?i)^https://\S+$"))


def build_messages(exported: DataFrame, service: str, post_url: str) -> DataFrame:
    """Exported posts as deliverable messages with stable event ids and button links appended.

    ``post_url``: what a post's address begins with, before the channel's name.
    """
    links = usable_buttons(F.coalesce(F.col("buttons"), F.array().cast("array<string>")))
    text = F.concat_ws("\n", blank_to_null(F.rtrim("text")), blank_to_null(F.array_join(links, "\n")))
    channel = F.coalesce("channel_id", "channel_username")
    return exported.select(
        F.concat_ws(":", F.lit(service), channel, F.col("message_id").cast("string"), F.lit("v1")).alias("event_id"),
        F.lit(service).alias("service"), channel.alias("channel_id"), "channel_name", "channel_username",
        F.col("message_id").cast("string").alias("message_id"),
        F.when(F.col("channel_username").isNotNull(), F.concat(F.lit(post_url), "channel_username", F.lit("/"), F.col("message_id").cast("string"))).alias("message_url"),
        "published_at", text.alias("text"),
    )
