"""The chain of micro-batches from delivered messages to resources: take in, extract, validate, store, match.

A chain lives in a folder. Each micro-batch writes its rows to folders of its own number and, last of all, its entry in
the manifest, which says what folders hold everything so far. What is not in the manifest does not count: a batch that
failed half-way is written anew, one that is run again after its entry stands changes nothing. So a chain that is
started again with its folder goes on where it stopped, and its tables are those of a run without a stop.

Stored keys are dealt to buckets, and a batch reads the buckets of its own keys alone. Every MERGED batches their
folders are put together into one, so that each row is written twice at most and folders stay few.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import blank_to_null, first_line, title_key
from ..operators import extract, headings, resolve
from ..session import shared_folder, written
from ..sources.intake import MAX_EVENT_ID, MAX_TEXT_BYTES

BUCKETS = 32
#: Batches whose folders are put together.
MERGED = 16
KEYS = ("service", "event_id")
#: (service, event_id, deliveries in the batch, status of the first one ever, whether that one is in this batch)
RECEIPTS = "service string, event_id string, deliveries long, status string, first boolean"
#: ``deliveries`` in the batch that brought the key first
DELIVERIES = "service string, event_id string, received_at timestamp, text string, status string, deliveries long"
LINKS = "service string, event_id string, source_key string, provider string, url string, status string, work_id long"
RESOURCES = "source_key string, provider string, url string, service string, event_id string, title string, title_key string, year int, work_id long"
_MANIFEST = "number long, folders array<string>, merged array<string>"


def folder_of(spark: SparkSession, name: str) -> str:
    """The folder of a chain: the same for the same name, wherever ``spark.checkpoint.dir`` is the same."""
    return f"{shared_folder(spark).rsplit('/', 1)[0]}/chains/{name}"


def bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Store:
    """The tables of a chain. ``keys``: table to (schema, key columns)."""

    base: str
    tables: dict[str, tuple[str, list[str]]]
    buckets: int = BUCKETS
    merged: int = MERGED

    def manifest(self, spark: SparkSession) -> tuple[int, list[str], list[str]]:
        """(last number, folders that are not merged yet, merged ones); -1 before the first batch."""
        try:
            last = spark.read.schema(_MANIFEST).json(f"{self.base}/manifest").orderBy(F.desc("number")).first()
        except AnalysisException as absent:
            if absent.getCondition() != "PATH_NOT_FOUND":
                raise
            last = None
        return (last["number"], last["folders"], last["merged"]) if last else (-1, [], [])

    def read(self, spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
        schema, _ = self.tables[table]
        if not folders:
            # known to be empty before it runs, so that joins with it are left out
            return spark.createDataFrame([], StructType.fromDDL(schema)).withColumn("bucket", F.lit(0)).filter(F.lit(False))
        place = f"{self.base}/{table}"
        rows = spark.read.schema(f"{schema}, folder string, bucket int").option("basePath", place)
        return rows.parquet(*[f"{place}/folder={f}" for f in folders]).drop("folder")

    def known(self, table: str, asked: DataFrame, folders: list[str]) -> DataFrame:
        """Stored rows of a table in the buckets of the asked keys."""
        if not folders:
            return self.read(asked.sparkSession, table, folders).drop("bucket")
        _, keys = self.tables[table]
        # as many numbers as there are buckets
        hit = [r[0] for r in asked.select(bucket(keys, self.buckets)).distinct().collect()]
        return self.read(asked.sparkSession, table, folders).filter(F.col("bucket").isin(hit)).drop("bucket")

    def write(self, df: DataFrame, table: str, folder: str) -> DataFrame:
        """Write rows to a folder of a table, over what a failed run has left there, and read them back."""
        schema, keys = self.tables[table]
        names = StructType.fromDDL(schema).names
        rows = df.select(*names, bucket(keys, self.buckets).alias("bucket"))
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{table}/folder={folder}")
        return self.read(df.sparkSession, table, [folder]).drop("bucket")

    def commit(self, spark: SparkSession, number: int, folders: list[str], merged: list[str]) -> None:
        folders = [*folders, f"batch-{number}"]
        if len(folders) >= self.merged:
            name = f"upto-{number}"
            for table in self.tables:
                self.write(self.read(spark, table, folders), table, name)
            folders, merged = [], [*merged, name]
        entry = spark.createDataFrame([(number, folders, merged)], _MANIFEST)
        entry.coalesce(1).write.mode("overwrite").json(f"{self.base}/manifest/batch={number}")

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """All rows of a table that count."""
        _, folders, merged = self.manifest(spark)
        return self.read(spark, name, [*merged, *folders]).drop("bucket")


def store(base: str, buckets: int = BUCKETS, merged: int = MERGED) -> Store:
    return Store(base, {
        "deliveries": (DELIVERIES, list(KEYS)), "receipts": (RECEIPTS, list(KEYS)), "links": (LINKS, list(KEYS)), "resources": (RESOURCES, ["source_key"]),
    }, buckets, merged)


def accepted(messages: DataFrame) -> Column:
    text = F.coalesce("text", F.lit(""))
    return F.coalesce(F.length("event_id").between(1, MAX_EVENT_ID), F.lit(False)) & (F.octet_length(text) <= MAX_TEXT_BYTES)


def first_of_each(messages: DataFrame) -> DataFrame:
    """(KEYS, received_at, text, deliveries): the earliest delivery of each key, of those of one time the least text."""
    first = F.min(F.struct(F.col("received_at").isNull().alias("n"), "received_at", "text"))
    return messages.groupBy(*KEYS).agg(first.alias("_f"), F.count(F.lit(1)).alias("deliveries")).select(*KEYS, "_f.received_at", "_f.text", "deliveries")


def validated(links: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``links`` with ``state``: valid, invalid or pending. Hash links need no check; a link without an outcome waits for one.

    ``outcomes`` (source_key, outcome) of probes so far; of several a final one counts, invalid before valid.
    """
    invalid = F.bool_or(F.col("outcome") == "invalid").alias("_invalid")
    final = outcomes.filter(F.col("outcome").isin("valid", "invalid")).groupBy("source_key").agg(invalid)
    state = F.when((F.col("provider") == "ed2k") | ~F.col("_invalid"), "valid").when(F.col("_invalid"), "invalid").otherwise("pending")
    return links.join(final, "source_key", "left").withColumn("state", state).drop("_invalid")


def new_resources(links: DataFrame, stored: DataFrame, works: DataFrame) -> DataFrame:
    """Resources that valid links (with their ``heading``) add to the stored ones, each owned by the first message that has it, with its work.

    The work is the stored one that title and year fit (``resolve.compatible_works``), else a new one, known by both.
    """
    title, year = headings.title_and_year(F.col("_body"))
    first = links.filter(F.col("state") == "valid").groupBy("source_key").agg(
        F.min_by(F.struct("provider", "url", "heading", *KEYS), F.struct("received_at", *KEYS, "line_no")).alias("_f")
    ).select("source_key", "_f.*").join(stored.select("source_key"), "source_key", "left_anti")
    bodies = first.select("source_key", "provider", "url", *KEYS, headings.plain_body(F.col("heading")).alias("_body"))
    titled = bodies.withColumns({"title": title, "year": year}).drop("_body").withColumn("title_key", title_key(F.col("title")))
    # stored, as titles are looked up and joined, and would else be made for each
    asked = written(titled, "titled").withColumns({"media_type": F.lit("unknown"), "resource_kind": F.lit("media")})
    resolved = resolve.compatible_works(asked, works)
    return resolved.withColumn("work_id", F.coalesce("work_id", F.xxhash64("title_key", F.coalesce("year", F.lit(0)))))


def run_batch(chain: Store, batch: DataFrame, number: int, outcomes: DataFrame, works: DataFrame) -> None:
    """Take in one micro-batch of messages (service, event_id, received_at, text), unless the manifest has it."""
    spark = batch.sparkSession
    last, folders, merged = chain.manifest(spark)
    if number <= last:
        return
    before, here = [*merged, *folders], f"batch-{number}"
    messages = batch.select(F.coalesce("service", F.lit("unknown")).alias("service"), "event_id", "received_at", F.coalesce("text", F.lit("")).alias("text"))
    given = written(first_of_each(messages.filter(accepted(messages))), "given")
    refused = messages.filter(~accepted(messages)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("deliveries"))
    earlier = chain.known("deliveries", given, before).join(given.select(*KEYS), list(KEYS), "left_semi").select(*KEYS, "status")
    new = given.join(earlier, list(KEYS), "left_anti")

    # dealt by message before its links are made, so that they need not be dealt again to find the first of each key
    links = extract.extract_links(new.repartition(*KEYS), "text", (*KEYS, "received_at"), ("line_no", "provider", "url", "label", "context"))
    heading = first_line(F.coalesce(blank_to_null(F.col("context")), F.col("label")))
    states = written(validated(links.withColumn("heading", heading).drop("context", "label"), outcomes), "states")
    stored = chain.known("resources", states, before)
    added = chain.write(new_resources(states, stored, works), "resources", here)
    owners = stored.select("source_key", "work_id", F.lit(None).cast("string").alias("_service"), F.lit(None).cast("string").alias("_event_id")).unionByName(
        added.select("source_key", "work_id", F.col("service").alias("_service"), F.col("event_id").alias("_event_id"))
    )
    own = (F.col("service") == F.col("_service")) & (F.col("event_id") == F.col("_event_id"))
    status = F.when(F.col("state") == "pending", "pending_validation").when(F.col("state") == "invalid", "invalid").when(F.coalesce(own, F.lit(False)), "inserted").otherwise("duplicate")
    linked = chain.write(states.join(owners, "source_key", "left").withColumn("status", status), "links", here)

    rolled = resolve.rolled_up_status(linked.withColumn("message_id", F.struct(*KEYS))).select("message_id.*", F.col("status").alias("_status"))
    final = new.join(rolled, list(KEYS), "left").withColumn("status", F.coalesce("_status", F.lit("ignored")))
    done = chain.write(final, "deliveries", here).select(*KEYS, "deliveries", "status", F.lit(True).alias("first"))
    again = given.select(*KEYS, "deliveries").join(earlier, list(KEYS)).withColumn("first", F.lit(False))
    receipts = done.unionByName(again).unionByName(refused.withColumns({"status": F.lit("rejected"), "first": F.lit(False)}))
    chain.write(receipts, "receipts", here)
    chain.commit(spark, number, folders, merged)


def run(stream: DataFrame, chain: Store, outcomes: Callable[[], DataFrame], works: DataFrame) -> Store:
    """Run the chain over all that is there now; started again with the same folder, over what has come since.

    ``outcomes`` gives the probes' outcomes as they are when a batch starts.
    """
    def step(batch: DataFrame, number: int) -> None:
        run_batch(chain, batch, number, outcomes(), works)

    stream.writeStream.option("checkpointLocation", f"{chain.base}/checkpoint").foreachBatch(step).trigger(availableNow=True).start().awaitTermination()
    return chain
