"""Change sets that move resources to other works: profiles of persons, and headings that are parsed anew.

A change set is a table for each table that changes, of whole new values; nothing is written here. Works that a move
leaves without a resource go, and what hangs on them, unless their identity is confirmed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_person_name, title_key
from .resolve import compatible_works


def confirmed_identity(status: str = "status", catalogue_id: str = "catalogue_id") -> Column:
    return F.col(catalogue_id).isNotNull() | (F.col(status) == "matched")


def new_id(*identity: Column) -> Column:
    """The id of a work that is made here: the same for the same identity in every run."""
    return F.xxhash64(*identity)


def left_empty(works: DataFrame, resources: DataFrame, moved: DataFrame) -> DataFrame:
    """(id) of works without a confirmed identity all of whose resources are moved elsewhere.

    ``moved`` (id, work_id): resources and their new owners; they take none from a work that also gets some.
    """
    counts = resources.groupBy("work_id").agg(F.count(F.lit(1)).alias("_n"))
    gone = resources.join(moved.select("id", F.col("work_id").alias("_to")), "id").filter(F.col("work_id") != F.col("_to")).groupBy("work_id").agg(F.count(F.lit(1)).alias("_gone"))
    emptied = counts.join(gone, "work_id").filter("_n = _gone").select(F.col("work_id").alias("id"))
    return works.filter(~confirmed_identity()).join(emptied, "id", "left_semi").join(moved.select(F.col("work_id").alias("id")), "id", "left_anti").select("id")


def cascaded(removed: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """What hangs on removed works: for each table (work_id, ...) its rows that go."""
    owners = removed.select(F.col("id").alias("work_id"))
    return {name: rows.join(owners, "work_id", "left_semi") for name, rows in children.items()}


def person_attribution(messages: DataFrame, links: DataFrame, resources: DataFrame, works: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """The change set that gives the resources of a person's profile messages to that person.

    ``messages`` (id, received_at, profile): the heading of a profile message, null for others; ``links`` (message_id,
    source_key); ``resources`` (id, source_key, work_id); ``works`` (id, title_key, resource_kind, status, catalogue_id).
    A message with a resource of another work whose identity is confirmed changes nothing. Of several messages with a resource
    the last one wins. The person is the stored one of that name with the least id; else the work that has all resources of
    the message and no others, which becomes the person; else a new one.

    Gives ``resources`` (id, work_id), ``links`` (message_id, source_key, work_id), ``promoted`` (id, title, title_key),
    ``created`` (id, title, title_key), ``removed`` (id), and for each of ``children`` (work_id, ...) what goes with these.
    """
    name = clean_person_name(F.col("profile"))
    profiles = messages.filter(F.col("profile").isNotNull()).select("id", "received_at", name.alias("name")).withColumn("person_key", title_key(F.col("name")))
    profiles = profiles.filter(F.col("person_key") != "").select(F.col("id").alias("message_id"), "received_at", "name", "person_key")
    persons = works.filter((F.col("resource_kind") == "person") & (F.col("title_key") != "")).groupBy(F.col("title_key").alias("person_key")).agg(F.min("id").alias("_person"))
    held = links.select("message_id", "source_key").distinct().join(profiles, "message_id").join(persons, "person_key", "left")
    owned = held.join(resources.select(F.col("id").alias("resource_id"), "source_key", "work_id"), "source_key")
    state = works.select(F.col("id").alias("work_id"), confirmed_identity().alias("_confirmed"))
    counts = resources.groupBy("work_id").agg(F.count(F.lit(1)).alias("_total"))
    owned = owned.join(state, "work_id", "left").join(counts, "work_id")
    others = F.coalesce(F.col("work_id") != F.col("_person"), F.lit(True)) & F.coalesce("_confirmed", F.lit(False))
    each = owned.groupBy("message_id", "received_at", "name", "person_key", "_person").agg(
        F.bool_or(others).alias("_barred"), F.min("work_id").alias("_low"), F.max("work_id").alias("_high"), F.min("_total").alias("_total"), F.count(F.lit(1)).alias("_n")
    ).filter(~F.col("_barred"))
    sole = F.when((F.col("_low") == F.col("_high")) & (F.col("_total") == F.col("_n")), F.col("_low"))
    # of the messages of one person all lead to one work: the stored one, the least that is the person's alone, a new one
    each = each.withColumn("_sole", sole)
    person = each.groupBy("person_key").agg(
        F.coalesce(F.min("_person"), F.min("_sole"), new_id(F.lit("person"), F.first("person_key"))).alias("person_id"),
        F.max_by("name", F.struct("received_at", "message_id")).alias("name"), F.min("_person").isNull().alias("_unstored"), F.min("_sole").isNotNull().alias("_had"),
    )
    decided = each.select("message_id", "received_at", "person_key").join(person.select("person_key", "person_id"), "person_key")
    last = owned.select("message_id", "resource_id", "source_key").join(decided, "message_id").groupBy("resource_id", "source_key").agg(
        F.max_by("person_id", F.struct("received_at", "message_id")).alias("work_id")
    )
    moved = last.select(F.col("resource_id").alias("id"), "work_id")
    removed = left_empty(works, resources, moved)
    return {
        "resources": moved,
        "links": links.select("message_id", "source_key").join(last.select("source_key", "work_id").distinct(), "source_key"),
        "promoted": person.filter(F.col("_unstored") & F.col("_had")).select(F.col("person_id").alias("id"), F.col("name").alias("title"), F.col("person_key").alias("title_key")),
        "created": person.filter(F.col("_unstored") & ~F.col("_had")).select(F.col("person_id").alias("id"), F.col("name").alias("title"), F.col("person_key").alias("title_key")),
        "removed": removed,
        **cascaded(removed, **children),
    }


def refreshed(parsed: DataFrame, resources: DataFrame, works: DataFrame, links: DataFrame, fields: list[str], **children: DataFrame) -> dict[str, DataFrame]:
    """The change set of known resources whose headings are parsed anew.

    ``parsed`` (source_key, title, title_key, year, media_type, resource_kind, ``fields``): one row for each key; of several
    the least counts. ``resources`` (id, source_key, work_id, resource_class, ``fields``). Every known resource takes the new
    fields, a null one included. It moves only if its work has no confirmed identity and is of unknown type, or the new
    heading is a person's: to the work that fits (``compatible_works``), else to a new one. Persons have no year.

    Gives ``resources`` (id, work_id, parsed_year, resource_class, fields), ``links`` (message_id, source_key, work_id) of
    moved ones, ``created`` (id, title, title_key, year, media_type, resource_kind), ``removed`` (id), and for each of
    ``children`` (work_id, ...) what goes with these.
    """
    year = F.when(F.col("resource_kind") != "person", F.col("year"))
    own = ["title", "title_key", "year", "media_type", "resource_kind", *fields]
    one = parsed.withColumn("year", year).groupBy("source_key").agg(F.min(F.struct(*own)).alias("_p")).select("source_key", "_p.*")
    state = works.select(F.col("id").alias("_from"), F.col("media_type").alias("_old_type"), confirmed_identity().alias("_confirmed"))
    known = resources.select("id", "source_key", F.col("work_id").alias("_from"), "resource_class").join(one, "source_key").join(state, "_from")
    moves = ~F.col("_confirmed") & ((F.col("_old_type") == "unknown") | (F.col("resource_kind") == "person"))
    known = compatible_works(known.withColumn("_moves", moves), works)
    fresh = new_id(F.lit("work"), "title_key", F.coalesce("year", F.lit(0)), "media_type", (F.col("resource_kind") == "person").cast("string"))
    target = F.when(F.col("_moves") & (F.col("title_key") != ""), F.coalesce("work_id", fresh)).otherwise(F.col("_from"))
    placed = known.withColumn("_made", F.col("_moves") & F.col("work_id").isNull() & (F.col("title_key") != "")).withColumn("work_id", target)
    moved = placed.filter(F.col("work_id") != F.col("_from"))
    removed = left_empty(works, resources, moved.select("id", "work_id"))
    return {
        "resources": placed.select(
            "id", "work_id", F.col("year").alias("parsed_year"), F.when(F.col("resource_kind") == "person", "person").otherwise(F.col("resource_class")).alias("resource_class"), *fields
        ),
        "links": links.select("message_id", "source_key").join(moved.select("source_key", "work_id").distinct(), "source_key"),
        "created": placed.filter("_made").groupBy(F.col("work_id").alias("id")).agg(F.min(F.struct("title", "title_key", "year", "media_type", "resource_kind")).alias("_w")).select("id", "_w.*"),
        "removed": removed,
        **cascaded(removed, **children),
    }


